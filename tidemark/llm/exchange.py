"""Questions and answers between chunks of documents and shards of keys.

Duplicate passages are found in three steps, all dealt out by Spark's shuffle: documents are grouped
into chunks of bounded size; each chunk sends the keys of its passages, as compact sorted arrays, to
shards of the key space; each shard answers every chunk that asked. A key that occurs very often is
sent once by a chunk, so a shard's work is bounded by the number of chunks, not of occurrences. A
message holds all that a chunk has for a shard: there are never more messages than keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Text bytes in a chunk and in a block, the unit of work inside a chunk.
CHUNK_BYTES, BLOCK_BYTES = 8 << 20, 1 << 19
#: Cells of a shard of a sketch, and keys of a shard of exact keys, about.
CELLS, KEYS = 1 << 24, 1 << 20

U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_OTHER = 0xD6E8FEB86659FD93 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; in place."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


class Rolling:
    """Hashes of any slice of a sequence, from prefix sums modulo 2**64 of terms times powers of an odd radix.

    They only bring together what may be equal; what is equal is decided by the bytes or words themselves.
    """

    def __init__(self, radix: int, seed: int) -> None:
        self.radix, self.inverse = U(radix), U(pow(radix, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, U)
        self.of_byte = mixed(np.arange(1, 257, dtype=U) * U(seed | 1))

    def _grow(self, n: int) -> None:
        while len(self.powers) < n + 1:
            for name, factor in (("powers", self.radix), ("inverses", self.inverse)):
                have = getattr(self, name)
                setattr(self, name, np.concatenate((have, have * (have[-1:] * factor))))

    def sums(self, terms: np.ndarray) -> np.ndarray:
        """``terms``: bytes, or 64-bit values."""
        n = len(terms)
        self._grow(n)
        out = np.zeros(n + 1, U)
        if terms.dtype == np.uint8:
            terms = self.of_byte[terms]
        np.multiply(terms, self.powers[:n], out=out[1:])
        np.cumsum(out, out=out)
        return out

    def slices(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts])


FIRST = Rolling(_RADIX, 0x2545F4914F6CDD1D)


def sliding(terms: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` neighbouring 64-bit terms."""
    size = max(len(terms) - n + 1, 0)
    out = np.zeros(size, U)
    for k in range(n):
        out *= U(_RADIX)
        out += terms[k : k + size]
    return mixed(out)


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbouring values."""
    if len(values) < n:
        return values[:0]
    out, span = values, 1
    while 2 * span <= n:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[: len(out) - (n - span)], out[n - span :]) if n > span else out


def chunks(docs: DataFrame, size: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """``docs`` with ``chunk``, the number of chunks, and the text bytes of all."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // size))
    return docs.select("doc_id", "text", F.expr(f"cast(pmod(xxhash64(doc_id, text), {n}) as int)").alias("chunk")), n, total


def loaded(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The doc_ids of a chunk, in order (a null comes first, ties go by text), and their texts as bytes."""
    ids = table.column("doc_id").combine_chunks()
    ids = np.asarray(ids.fill_null(np.iinfo(np.int64).min), dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
    found: list[np.ndarray] = []
    for part in table.column("text").chunks:
        data, starts, ends = utf8(part)
        found += [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    for a, b in _runs(ids):  # so that each step sees a chunk in the same order
        if b - a > 1:
            order[a:b] = sorted(order[a:b].tolist(), key=lambda i: found[i].tobytes())
    return ids, [found[i] for i in order.tolist()]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))[: len(values)].tolist()
    return list(zip(heads, [*heads[1:], len(values)]))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.num, a.nbytes))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.int16, np.uint16, np.int32, np.uint32, np.int64, np.uint64)}


def unpacked(value: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    for kind, size in zip(head[::2].tolist(), head[1::2].tolist()):
        out.append(np.frombuffer(data, _TYPES[kind], size // _TYPES[kind].itemsize, at))
        at += size
    return out


MAIL = "shard int, chunk int, body binary"


def mail(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    shard, chunk, body = zip(*rows) if rows else ((), (), ())
    return pa.table({"shard": pa.array(shard, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "body": pa.array(body, pa.binary())})


def opened(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """Mail in order of shard and chunk."""
    return sorted(zip(*(table.column(c).to_pylist() for c in ("shard", "chunk", "body"))), key=lambda r: r[:2])


def narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned values in the narrowest type that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32)


def divided(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; it rises with the key."""
    return ((keys >> U(32)) * U(shards) >> U(32)).astype(np.int64)


class Sketch:
    """A count-min sketch whose cells are dealt out to shards.

    A chunk's own sketch is the sorted cells that its keys fall into, with how many do. Merging adds them
    up, so the merged count of a key is never less than its occurrences. The answer to a chunk is a level
    for each of its cells: 0 for a count of 1, 1 for more, 2 for more than ``hot``.
    """

    def __init__(self, keys: int, rows: int, cells_a_key: int = 4, hot: int = 1 << 40) -> None:
        self.rows, self.hot, self.shards = rows, hot, max(1, -(-keys * cells_a_key // CELLS))

    def _cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        x = mixed(keys * U(_OTHER + 2 * row * 0x9E3779B9))
        return divided(x, self.shards) * CELLS + (x & U(CELLS - 1)).astype(np.int64)

    def _bounds(self, own: np.ndarray) -> list[tuple[int, int, int]]:
        bounds = np.searchsorted(own, np.arange(self.shards + 1) * CELLS).tolist()
        return [(s, a, b) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]

    def ask(self, chunk: int, keys: np.ndarray) -> list[tuple[int, int, bytes]]:
        out = []
        for row in range(self.rows):
            cells = np.sort(self._cells(keys, row))
            at = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))[: len(cells)])
            own, counts = cells[at], np.diff(np.append(at, len(cells)))
            for s, a, b in self._bounds(own):
                gaps = np.diff(own[a:b], prepend=s * CELLS)
                out.append((row * self.shards + s, chunk, packed(narrow(gaps), narrow(counts[a:b]))))
        return out

    def answer(self, table: pa.Table) -> pa.Table:
        """Merge a shard's sketches; tell each chunk the levels of its cells."""
        counts = np.zeros(CELLS, np.uint32)
        asked = opened(table)
        for _, _, body in asked:
            gaps, n = unpacked(body)
            counts[np.cumsum(gaps, dtype=np.int64)] += n
        out = []
        for shard, chunk, body in asked:
            n = counts[np.cumsum(unpacked(body)[0], dtype=np.int64)]
            out.append((shard, chunk, packed(np.packbits(n > 1), np.packbits(n > self.hot))))
        return mail(out)

    def levels(self, keys: np.ndarray, answers: pa.Table) -> np.ndarray:
        """The level of each of a chunk's keys."""
        bits = {shard: unpacked(body) for shard, _, body in opened(answers)}
        out = np.full(len(keys), 2, np.uint8)
        for row in range(self.rows):
            cells = self._cells(keys, row)
            order = np.argsort(cells)
            c = cells[order]
            first = np.concatenate(([True], c[1:] != c[:-1]))[: len(c)]
            found = [np.zeros(0, np.uint8)]
            for s, a, b in self._bounds(c[first]):
                more, hot = (np.unpackbits(x, count=b - a) for x in bits[row * self.shards + s])
                found.append(more + hot)
            level = np.concatenate(found)[np.cumsum(first) - 1] if len(c) else found[0]
            out[order] = np.minimum(out[order], level)
        return out


class Met:
    """Which 64-bit keys several chunks have: chunks send their distinct keys to shards of the key space."""

    def __init__(self, keys: int) -> None:
        self.shards = max(1, -(-keys // KEYS))

    def ask(self, chunk: int, keys: np.ndarray) -> list[tuple[int, int, bytes]]:
        keys = np.unique(keys)
        bounds = np.searchsorted(divided(keys, self.shards), np.arange(self.shards + 1)).tolist()
        return [(s, chunk, packed(np.diff(keys[a:b], prepend=U(0)))) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]

    @staticmethod
    def answer(table: pa.Table) -> pa.Table:
        """Tell each chunk which of its keys others have too."""
        asked = [(shard, chunk, np.cumsum(unpacked(body)[0], dtype=U)) for shard, chunk, body in opened(table)]
        keys = np.sort(np.concatenate([k for _, _, k in asked]))
        shared = np.unique(keys[1:][keys[1:] == keys[:-1]])
        if not len(shared):
            return mail([])
        out = []
        for shard, chunk, own in asked:
            own = own[shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own]
            if len(own):
                out.append((shard, chunk, packed(np.diff(own, prepend=U(0)))))
        return mail(out)

    @staticmethod
    def shared(keys: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Which of a chunk's keys others have too."""
        told = [np.cumsum(unpacked(body)[0], dtype=U) for _, _, body in opened(answers)]
        if not told:
            return np.zeros(len(keys), bool)
        told = np.sort(np.concatenate(told))
        return told[np.minimum(np.searchsorted(told, keys), len(told) - 1)] == keys
