"""Token-ID output: shards of ids, compressed by Re-Pair grammars, with random access.

Texts are encoded by a public tokenizer and an end id is appended. Documents go to shards in ascending
doc_id order. A shard's ids are compressed by a grammar: again and again the frequent pairs of ids are
replaced by nonterminals, until no pair occurs ``LEAST`` times. The file keeps the rules, the remaining sequence and, for random access, how
many ids every ``STRIDE`` symbols expand to, besides the place and length of each document.

A shard is one binary value in a Parquet table, written by Spark's committer, so a lost executor's
attempt leaves nothing behind; file format of the value: see ``pack``.

Defined cases: a null text is empty and gives the end id alone; a very long text is encoded whole and lies in one shard; rows with the same doc_id follow one
another in order of their text; a null doc_id comes first; an empty table makes no shard; further
columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranges, shared_folder, slices, texts

#: How often a pair must occur to be replaced: a rule takes 8 bytes, and each replacement saves a symbol of 2 bytes or more.
LEAST = 5
#: Symbols between two entries of the random-access index; ids of a shard, whose tables of pairs fit a core's cache; text bytes of a task.
STRIDE, SHARD_IDS, PART_BYTES = 1024, 1 << 19, 16 << 20
MAGIC = b"RPID0001"


# -- encoding


class Encoder:
    """A tokenizers file behind a cache of words.

    The file's pre-tokenizer cuts before a space between two other characters, and at a line break
    between two others; so do we, and encode each distinct piece once. Texts with white space side by side, with
    other white space, or with the control character that marks the cuts, are encoded whole.
    """

    SIDE = ["  ", "\n\n", " \n", "\n ", *map(chr, [1, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
    #: A word and the marks after it, which the pre-tokenizer always parts.
    MARKED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!#-&(-/:-@\[-^{-~]+)")
    SINGLE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[!#-&(-/:-@\[-^{-~]+")
    #: Pieces that are kept, about 120 MB: the first that come, so all frequent ones.
    LIMIT = 600_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # what comes here is new: our cache holds the rest
        self.model = self.tokenizer.model
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.bytes = dict(zip((b for b in range(256) if b not in plain), range(256, 512)))
        # Strings of special tokens stand for themselves only in whole texts.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def encode(self, documents: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each document."""
        flat: list[str] = []
        spans, whole = [], []
        for d in documents:
            pieces = self._pieces(d)
            if pieces is None:
                whole.append(d)
                spans.append(None)
            else:
                spans.append((len(flat), len(flat) + len(pieces)))
                flat += pieces
        found = list(map(self.known.get, flat))
        holes = [i for i, v in enumerate(found) if v is None]
        new = self._learned({flat[i] for i in holes})
        for i in holes:
            found[i] = new[flat[i]]
        ids = iter(self._ids(whole))
        return [b"".join(found[s[0] : s[1]]) if s else next(ids) for s in spans]

    def _learned(self, missed: set[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't known: of a word and its marks, or from the library. They are kept while there is room."""
        known, new, fresh, halves = self.known, {}, set(), []
        for x in missed:
            if match := self.MARKED.fullmatch(x):
                halves.append((x, *match.groups()))
            else:
                fresh.add(x)
        for _, *pair in halves:
            fresh.update(half for half in pair if half not in known)
        rest = []
        for x in fresh:
            if self.SINGLE.fullmatch(x):
                new[x] = self._single(x)
            else:
                rest.append(x)
        new.update(zip(rest, self._ids(rest)))
        for x, word, marks in halves:
            new[x] = (known.get(word) or new[word]) + (known.get(marks) or new[marks])
        if len(known) < self.LIMIT:
            known.update(new)
        return new

    def _pieces(self, d: str) -> list[str] | None:
        if any(x in d for x in self.SIDE) or any(t in d for t in self.special):
            return None
        return d.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def _single(self, x: str) -> bytes:
        """Ids of what the pre-tokenizer leaves in one piece: straight from the library's model."""
        x = x.replace(" ", "Ġ") if x.isascii() else x.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(x)]).tobytes()

    def _ids(self, strings: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker, so that its cache serves task after task."""
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


# -- Re-Pair


def counted(seq: np.ndarray, least: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that occur ``least`` times or more at the places ``where``, how often; the places where they do, the
    pair's number at each, and whether the place counts: of a pair of equal symbols, which may overlap itself, every other one.

    A table of hashed slots leaves out the places whose slot is rarer; those that are left are counted by the pairs themselves.
    """
    # Pairs of 16-bit symbols are kept in 32 bits, others in 64.
    half, kind, factor = (16, np.uint32, 0x9E3779B1) if int(seq.max()) < 1 << 16 else (32, np.uint64, 0x9E3779B97F4A7C15)
    left, right = seq[where], seq[where + 1]
    pairs = left.astype(kind) << kind(half) | right
    width = max(12, len(where).bit_length() - 1)
    slot = (pairs * kind(factor) >> kind(2 * half - width)).astype(np.int32)
    counts = np.ones(len(where), bool)
    same = np.flatnonzero(left == right)
    if len(same):
        head = np.concatenate(([True], where[same[1:]] != where[same[:-1]] + 1))
        start = np.maximum.accumulate(np.where(head, np.arange(len(same)), 0))
        counts[same[(np.arange(len(same)) - start) % 2 == 1]] = False
    some = np.flatnonzero((np.bincount(slot, minlength=1 << width) >= least)[slot])
    pairs, slot, counts = pairs[some], slot[some], counts[some]
    ordered = np.sort(pairs[counts])
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])
    n = np.diff(np.append(heads, len(ordered)))
    own, n = ordered[heads[n >= least]], n[n >= least]
    # A place finds its pair by its slot; those that share their slot with another frequent pair look it up.
    table = np.full(1 << width, -1, np.int32)
    table[(own * kind(factor) >> kind(2 * half - width)).astype(np.int64)] = np.arange(len(own))
    number = table[slot]
    if len(own):
        other = np.flatnonzero((number >= 0) & (own[number] != pairs))
        found = np.minimum(np.searchsorted(own, pairs[other]), len(own) - 1)
        number[other] = np.where(own[found] == pairs[other], found, -1)
    kept = number >= 0
    wide = own.astype(np.uint64)
    return wide >> np.uint64(half) << np.uint64(32) | wide & np.uint64((1 << half) - 1), n, where[some[kept]], number[kept], counts[kept]


def replaced(seq: np.ndarray, first_new: int, least: int = LEAST, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: the sequence with frequent pairs replaced, the pairs of the new symbols, two columns, and where to look next.

    Where pairs overlap, the more frequent one is replaced; the most frequent of all keeps its places, so rounds come to
    an end. A pair that is left with fewer than ``least`` places by that waits for a later round, where it is counted anew.
    Pairs that are frequent in the next round have a new symbol or have waited: only their places are looked at.
    """
    none = np.zeros((0, 2), np.uint32)
    where = np.arange(len(seq) - 1) if where is None else where
    if not len(where):
        return seq, none, where
    pairs, n, places, number, counts = counted(seq, least, where)
    if not len(pairs):
        return seq, none, places
    rank = np.empty(len(pairs), np.int64)
    rank[np.lexsort((pairs, -n))] = np.arange(len(pairs))
    at, number = places[counts], number[counts]
    own = rank[number]
    beside = at[1:] == at[:-1] + 1
    wins = np.ones(len(at), bool)
    wins[1:] &= ~beside | (own[1:] < own[:-1])
    wins[:-1] &= ~beside | (own[:-1] < own[1:])
    at, number = at[wins], number[wins]
    kept = np.bincount(number, minlength=len(pairs)) >= least
    at, number = at[kept[number]], number[kept[number]]
    out = seq.copy()
    out[at] = (first_new + np.cumsum(kept) - 1).astype(np.uint32)[number]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    look = np.zeros(len(seq), bool)
    look[places] = True
    look[at] = True
    look[np.maximum(at - 1, 0)] = True
    pair = pairs[kept]
    look = np.flatnonzero(look[keep][:-1])
    return out[keep], np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32), look


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray]:
    """First nonterminal, rules (two symbols each, made of earlier ones) and the sequence that remains when no pair is frequent."""
    first = int(ids.max()) + 1 if len(ids) else 0
    rules, seq, where = [np.zeros((0, 2), np.uint32)], ids.astype(np.uint32), None
    n = 0
    while True:
        seq, more, where = replaced(seq, first + n, least, where)
        if not len(more):
            return first, np.concatenate(rules), seq
        rules.append(more)
        n += len(more)


class Expansion:
    """What each symbol stands for: lengths and, laid end to end, the ids of the nonterminals."""

    def __init__(self, first: int, rules: np.ndarray) -> None:
        self.first, self.rules = first, rules.astype(np.int64)
        # Nonterminals by level: those of a level are made of ids and of lower ones.
        lengths, self.levels = np.zeros(len(rules), np.int64), []
        inner = self.rules >= first
        child = np.where(inner, self.rules - first, 0)
        left = np.arange(len(rules))
        while len(left):
            sizes = np.where(inner[left], lengths[child[left]], 1)
            ready = (sizes > 0).all(1)
            if not ready.any():
                raise ValueError("a rule is made of itself")
            self.levels.append(left[ready])
            lengths[left[ready]] = sizes[ready].sum(1)
            left = left[~ready]
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths

    @functools.cached_property
    def ids(self) -> np.ndarray:
        out = np.empty(int(self.lengths.sum()), np.uint32)
        for level in self.levels:
            at = self.starts[level]
            for symbols in self.rules[level].T:
                small = symbols < self.first
                out[at[small]] = symbols[small]
                child = symbols[~small] - self.first
                size = self.lengths[child]
                out[ranges(at[~small], size)] = out[ranges(self.starts[child], size)]
                at = at + np.where(small, 1, self.lengths[np.where(small, 0, symbols - self.first)])
        return out

    def sizes(self, seq: np.ndarray) -> np.ndarray:
        out = np.ones(len(seq), np.int64)
        big = seq >= self.first
        out[big] = self.lengths[seq[big] - self.first]
        return out

    def expand(self, seq: np.ndarray) -> np.ndarray:
        sizes = self.sizes(seq)
        begin = np.cumsum(sizes) - sizes
        small = seq < self.first
        # Ids come from the nonterminals', laid end to end, or from the symbols that are ids themselves, laid after them.
        source = np.empty(len(seq), np.int64)
        source[small] = len(self.ids) + np.arange(np.count_nonzero(small))
        source[~small] = self.starts[seq[~small] - self.first]
        total = int(sizes.sum())
        kind = np.int32 if len(self.ids) + total < 1 << 31 else np.int64
        return np.concatenate((self.ids, seq[small].astype(np.uint32)))[np.repeat((source - begin).astype(kind), sizes) + np.arange(total, dtype=kind)]


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A shard as bytes, all numbers little-endian.

    Magic; then as 64-bit numbers: ids, documents, first nonterminal, rules, symbols, bytes a symbol (2 or 4);
    documents' lengths (32-bit); rules (pairs of 32-bit); ids before every STRIDE-th symbol (64-bit); symbols.
    """
    first, rules, seq = compress(ids)
    wide = 2 if first + len(rules) <= 1 << 16 else 4
    sizes = Expansion(first, rules).sizes(seq)
    before = np.concatenate(([0], np.cumsum(sizes)))[: len(seq) : STRIDE] if len(seq) else np.zeros(0)
    head = np.array([len(ids), len(lengths), first, len(rules), len(seq), wide], "<i8")
    return b"".join([MAGIC, head.tobytes(), lengths.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), before.astype("<i8").tobytes(), seq.astype(f"<u{wide}").tobytes()])


class Shard:
    """A packed shard, opened for reading."""

    def __init__(self, value: bytes) -> None:
        if value[:8] != MAGIC:
            raise ValueError("not a shard of ids")
        self.n_ids, n_docs, first, n_rules, n_symbols, wide = np.frombuffer(value, "<i8", 6, 8).tolist()
        at = 56
        self.lengths = np.frombuffer(value, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        rules = np.frombuffer(value, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.before = np.frombuffer(value, "<i8", -(-n_symbols // STRIDE), at)
        self.symbols = np.frombuffer(value, f"<u{wide}", n_symbols, at + 8 * len(self.before))
        self.grammar = Expansion(first, rules)

    def all(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end``; only the symbols around them are expanded."""
        if end <= start:
            return np.zeros(0, np.uint32)
        low = int(np.searchsorted(self.before, start, side="right")) - 1
        high = int(np.searchsorted(self.before, end, side="left"))
        ids = self.grammar.expand(self.symbols[low * STRIDE : high * STRIDE])
        return ids[start - self.before[low] : end - self.before[low]]

    def document(self, nth: int) -> np.ndarray:
        start = int(self.lengths[:nth].sum())
        return self.slice(start, start + int(self.lengths[nth]))


# -- files


def write(docs: DataFrame, folder: str, path: str, end: int, shard_ids: int = SHARD_IDS) -> None:
    """Write the documents' ids to ``folder`` as a table: shard, n_ids, doc_ids, body.

    Texts are ranged by doc_id, so that a task sees a range of documents in order; each task encodes its
    range and cuts it into shards.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    first = F.col("doc_id").asc_nulls_first()
    ranged = docs.repartitionByRange(max(1, -(-total // PART_BYTES)), first).sortWithinPartitions(first, "text")
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; a shard ends at ``shard_ids`` ids or with the task. Its number rises with its doc_ids."""
        part, nth, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids])
            body = pack(np.frombuffer(b"".join(ids), "<u4"), lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + nth]), pa.array([int(lengths.sum())]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([body], pa.binary())],
                names=["shard", "n_ids", "doc_ids", "body"],
            )

        for batch in slices(batches, "text", 2 << 20):
            coded = encoder(path).encode([t.decode("utf-8", "replace") for t in texts(batch.column("text"))])
            for d, x in zip(batch.column("doc_id").to_pylist(), coded):
                doc_ids.append(d)
                ids.append(x + stop)
                size += len(x) // 4 + 1
                if size >= shard_ids:
                    yield shard()
                    doc_ids, ids, size, nth = [], [], 0, nth + 1
        if doc_ids:
            yield shard()

    shards = ranged.mapInArrow(run, "shard long, n_ids long, doc_ids array<long>, body binary")
    shards.write.option("compression", "zstd").parquet(folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in ``folder`` with ``start``, the ids of all shards before."""
    out = spark.read.parquet(folder)
    starts = out.select("shard", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return out.join(starts.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")), "shard")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, in the order of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, body in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "body"))):
                opened = Shard(body)
                flat = opened.all().astype("<u4").tobytes()
                ends = np.cumsum(opened.lengths)
                begins = ends - opened.lengths
                # Rows of about 4 MB at a time.
                cuts = [0, *(np.flatnonzero(np.diff(ends // (1 << 20))) + 1).tolist(), len(ends)]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        rows = [flat[4 * x : 4 * y] for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids[a:b], pa.int64()), pa.array(begins[a:b] + start), pa.array(opened.lengths[a:b]), pa.array(rows, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    return shards(spark, folder).select("start", "doc_ids", "body").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def stored(docs: DataFrame, path: str, end: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ``docs`` to a new folder among the shared ones and read it back."""
    folder = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write(docs, folder, path, end, shard_ids)
    return read(docs.sparkSession, folder)

