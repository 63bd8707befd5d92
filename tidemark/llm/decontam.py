"""Benchmark decontamination by a generalised suffix automaton over words.

The normalised test items are put into one automaton; the words of each document are streamed through
it, tracking the length of the longest match that ends at each word. Where that length reaches a
window, the words of the window are hit. An item's windows are its runs of ``window`` words, or the
whole item where it is shorter.

The items are cut into shards of at most ``SHARD_WORDS`` words, whatever their number. Tasks build the automata, each of
bounded size, and all tasks get them. A task reads its documents once, in stretches of bounded size, and takes one
automaton after the other over a stretch: a block of queries against all rows, with one automaton in memory.

Defined cases: null texts have no words; very long texts are matched whole; items without words have no window; rows with
one item_id count as one item, and a null item_id is listed as empty text, like an empty one; an empty benchmark hits
nothing; empty documents give an empty result; rows with the same doc_id are separate documents; further columns are kept,
but for those added.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, utf8, written

#: Words in one automaton at most, but for a longer item: its states, about 400 bytes a word, fit a task.
SHARD_WORDS = 200_000
#: Text bytes that an automaton goes over at a time.
STRETCH = 16 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of letters, digits and anything beyond ASCII."""
    return text.translate(_LETTERS).split()


class Automaton:
    """A generalised suffix automaton; states know the items whose windows end in them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        ends: list[tuple[int, int, int]] = []  # state of a window's end, its length, its item
        index: dict[str, int] = {}
        for name, item in items:
            n = index.setdefault(name, len(index))
            if n == len(self.names):
                self.names.append(name)
            last, size = 0, min(window, len(item))
            for k, word in enumerate(item):
                last = self._add(last, self.ids.setdefault(word, len(self.ids) + 1))
                if k + 1 >= size:
                    ends.append((last, size, n))
        self.least = min((size for _, size, _ in ends), default=0)
        # A window is the text of one length in one state: go up from where it ended.
        marks: dict[int, dict[int, set[int]]] = {}
        for state, size, n in ends:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            marks.setdefault(state, {}).setdefault(size, set()).add(n)
        self.marks = {s: sorted((k, tuple(v)) for k, v in m.items()) for s, m in marks.items()}
        # The next state with marks on the way up, or -1.
        self.up = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.up[s] = self.link[s] if self.link[s] in self.marks else self.up[self.link[s]]

    def _clone(self, p: int, c: int) -> int:
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _add(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._clone(last, c)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._clone(p, c)
        return new

    def match(self, document: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal hit spans (start, end) of the document's words, and the items with windows in it."""
        least = self.least
        if not least or len(document) < least:
            return [], set()
        ids = np.fromiter(map(self.ids.get, document, repeat(0)), np.int32, len(document))
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))  # starts and ends of runs that the items' words make
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < least:
                continue
            state = size = 0
            for at, c in enumerate(ids[a:b].tolist(), a + 1):
                while c not in self.next[state]:
                    state = self.link[state]
                    if state < 0:
                        break
                    size = self.length[state]
                if state < 0:
                    state = size = 0
                    continue
                state, size = self.next[state][c], size + 1
                if size < least:
                    continue
                top, s, longest = size, state, 0
                while s > 0:
                    for k, items in self.marks.get(s, ()):
                        if k <= top:
                            longest = max(longest, k)
                            found.update(items)
                    s = self.up[s]
                    top = self.length[s] if s > 0 else 0
                if longest:
                    start = at - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at))
        return spans, found


def shards(items: DataFrame, size: int = SHARD_WORDS) -> DataFrame:
    """Adds ``shard``: items in shards of about ``size`` words or less."""
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    total = items.agg(F.sum(n)).first()[0] or 0
    return items.withColumn("shard", F.expr(f"pmod(xxhash64(item_id, text), {max(1, -(-2 * total // size) if total > size else 1)})"))


SCHEMA = "n_words long, spans array<struct<start: int, end: int>>, items array<string>"


def automata(items: DataFrame, window: int) -> list[Broadcast]:
    """The automaton of each shard, built in a task and sent pickled; the driver holds one at a time, of bounded size."""

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip((i or "" for i in table.column("item_id").to_pylist()), ((t or "").encode("utf-8", "replace") for t in table.column("text").to_pylist())))
        made = Automaton([(name, w) for name, text in rows if (w := words(text))], window)
        return pa.table({"body": pa.array([pickle.dumps(made, protocol=5)], pa.binary())})

    made = items.select("shard", F.col("item_id").cast("string").alias("item_id"), "text").groupBy("shard").applyInArrow(build, "body binary")
    return [items.sparkSession.sparkContext.broadcast(bytes(r["body"])) for r in written(made, "automata").toLocalIterator()]


def spans(docs: DataFrame, items: DataFrame, window: int = 13, size: int = SHARD_WORDS) -> DataFrame:
    """Adds to ``docs``: n_words, spans (maximal hit runs of words) and items (sorted ids of the items found)."""
    sent = automata(shards(items.select("item_id", "text"), size), window)
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), SCHEMA])

    def opened() -> Iterator[Automaton]:
        for one in sent:
            yield pickle.loads(one.value)
            one.__dict__.pop("_value", None)  # read anew where it is needed next, so that one is in memory at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of about ``STRETCH`` text bytes at a time; each automaton goes over a stretch before the next is opened."""
        only = next(opened()) if len(sent) == 1 else None
        stretch = 2 << 20 if only else STRETCH  # nothing is opened again for a stretch where there is one automaton
        for batch in gathered(slices(batches, "text", stretch), stretch):
            documents = texts(batch.column("text"))
            counts, hits, names = [0] * len(documents), [[] for _ in documents], [set() for _ in documents]
            for automaton in [only] if only else opened():
                for k, text in enumerate(documents):
                    document = words(text)
                    runs, found = automaton.match(document)
                    counts[k] = len(document)
                    hits[k] += runs
                    names[k].update(automaton.names[i] for i in found)
            if not sent:
                counts = [len(words(text)) for text in documents]
            arrays = [batch.column(c) for c in kept] + [
                pa.array(counts, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in joined(sorted(runs))] for runs in hits], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted(found) for found in names], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "n_words", "spans", "items"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring record batches as one of about ``most`` text bytes."""
    held, size = [], 0
    for batch in batches:
        _, starts, ends = utf8(batch.column("text"))
        held.append(batch)
        size += int((ends - starts).sum())
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(found: DataFrame, coverage: float = 0.05) -> DataFrame:
    """Adds n_hit, n_items and contaminated (hit words are at least ``coverage`` of all) to the result of ``spans``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= coverage * F.col("n_words"))
    )


def without_spans(found: DataFrame, longest: int | None = None) -> DataFrame:
    """``clean_text``: the text without its hit spans of at least ``longest`` words (all, if not given); other text stays as it is."""
    least = longest or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(texts(batch.column("text")), batch.column("spans").to_pylist()):
                flat = np.frombuffer(text.translate(_LETTERS), np.uint8) != 32
                edges = np.flatnonzero(np.diff(np.concatenate(([0], flat, [0]))))
                parts, at = [], 0
                for r in runs or []:
                    if r["end"] - r["start"] >= least:
                        parts.append(text[at : int(edges[2 * r["start"]])])
                        at = int(edges[2 * r["end"] - 1])
                out.append(b"".join([*parts, text[at:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "clean_text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema), "clean_text string"])
    return found.mapInArrow(run, schema)


def digest_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
