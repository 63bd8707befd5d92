"""SimHash near-dedup by a generalised pigeonhole search.

The 64 bits are grouped into partitions, correlated bits together, and a threshold is allocated to each
by dynamic programming: if the thresholds ``t_i`` of the partitions satisfy ``sum(t_i + 1) = distance + 1``,
then two fingerprints within ``distance`` bits are within ``t_i`` bits of one another in some partition
``i``. The allocation, and the number of partitions, minimise the estimated work: probes, from the number
of values within a threshold, and candidates, from the bits' statistics over all fingerprints. Each
distinct fingerprint is posted under its value in each partition, probes all values within the
threshold, and is verified against what it meets. Links of longer lists are reduced to a spanning forest where they are
found; connected components follow by star contraction.

Copies share a fingerprint and are searched once. A posting list of more than ``LIST`` fingerprints is
cut into blocks, and each pair of blocks is verified by itself.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a very long text is taken whole; fewer words than
a shingle make one shingle of all of them; a null doc_id is no component's name unless all are null;
rows with the same doc_id are separate documents; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices, texts, written
from .exchange import mixed

BITS = 64
#: Fingerprints in a block of a posting list, a few MB; pairs of a list that are simply compared.
LIST, SHORT = 16384, 256
#: Work of comparing a pair (4 ns measured) as a part of that of dealing out a row (10 us measured).
PAIR = 0.0004
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, shingle: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` words, lower-cased; of all words, where they are fewer."""
    words = text.translate(_LOWER).split()
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        raw = digest(line, 42) if words else b""
    else:
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1, initial=-1))[1:]
        starts = [0, *(e + 1 for e in ends)]
        raw = b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])])
    return np.frombuffer(raw, ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without any."""
    rows = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), 1 << 14):
        counts += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes())


def fingerprints(docs: DataFrame, shingle: int = 4, wide: int = 0) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and more: ``wide`` further fingerprints, of hashes mixed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            fps = np.zeros((batch.num_rows, 1 + wide), np.uint64)
            for row, text in zip(fps, texts(batch.column("text"))):
                hashes = shingle_hashes(text, shingle).astype(np.uint64)
                row[0] = fingerprint(hashes)
                for k in range(wide):
                    hashes = mixed(hashes * np.uint64(0x9E3779B97F4A7C15))
                    row[k + 1] = fingerprint(hashes)
            fps = fps.view(np.int64)
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * wide, pa.int32()), pa.array(fps[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps[:, 0].copy()), more], names=["doc_id", "fp", "more"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long, more array<long>")


# -- partitions and thresholds


def statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of distinct fingerprints, and how often each two bits are set together: 64 rows of 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = unfolded(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            sums += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS + 1), pa.int32()), pa.array([*sums.tolist(), [n] * BITS], pa.list_(pa.int64()))], names=["bit", "sums"])

    each = fps.select("fp").mapInArrow(run, "bit int, sums array<long>").select("bit", F.posexplode("sums").alias("other", "n"))
    out = np.zeros((BITS + 1, BITS), np.int64)
    for r in each.groupBy("bit", "other").agg(F.sum("n").alias("n")).collect():  # 65 x 64 rows
        out[r["bit"], r["other"]] = r["n"]
    return int(out[BITS, 0]), out[:BITS]


def unfolded(fps: np.ndarray) -> np.ndarray:
    """Bits of fingerprints, the highest first."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def grouped(n: int, sums: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` groups of nearly equal size, correlated bits together: each group grows
    from the free bit nearest to even odds by the free bit that is most correlated with it."""
    p = np.diag(sums) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(sums / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev)
    free, out = set(range(BITS)), []
    for size in (BITS // parts + (i < BITS % parts) for i in range(parts)):
        group = [min(free, key=lambda b: (abs(p[b] - 0.5), b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocated(n: int, sums: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated work, by dynamic programming; -1 leaves a partition out."""
    p = np.diag(sums) / max(n, 1)

    def work(group: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        near = np.zeros(t + 1)  # chance that two fingerprints differ in 0..t bits of the group
        near[0] = 1.0
        for q in (2 * p[group] * (1 - p[group])).tolist():
            near[1:] = near[1:] * (1 - q) + near[:-1] * q
            near[0] *= 1 - q
        probes = sum(math.comb(len(group), k) for k in range(t + 1))
        some = max(n, 1)  # without fingerprints a plan is made all the same: the one with the fewest probes
        return some * (1.0 + probes) + PAIR * float(some) * some * float(near.sum())

    best = {0: (0.0, [])}  # sum of (t + 1) so far: work, thresholds
    for group in groups:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, distance + 1 - used):
                found = (cost + work(group, t), [*ts, t])
                if used + t + 1 not in after or found < after[used + t + 1]:
                    after[used + t + 1] = found
        best = after
    return best[distance + 1]


def planned(n: int, sums: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Bits and threshold of each partition that is used."""
    plans = []
    for parts in range(1, distance + 2):
        groups = grouped(n, sums, parts)
        cost, ts = allocated(n, sums, groups, distance)
        plans.append((cost, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(plans)[1]


# -- links


def links(fps: DataFrame, distance: int, whole: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes of ``fps`` (fp, more, node) that join all that are linked, directly or by others.

    Two are linked if their fp differ in ``distance`` bits at most and, where ``whole`` is given, fp and more
    together in ``whole`` bits at most.
    """
    plan = planned(*statistics(fps), distance)
    masks = [sum(1 << (BITS - 1 - b) for b in bits) for bits, _ in plan]
    flips = [[sum(1 << (BITS - 1 - b) for b in c) for k in range(t + 1) for c in itertools.combinations(bits, k)] for bits, t in plan]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    # Posting lists that are too long for one task, with their number of blocks.
    posts = fps.select("fp", "more", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("part", "value"))
    long = posts.groupBy("part", "value").count().where(F.col("count") > LIST)
    long = written(long.select("part", "value", F.ceil(F.col("count") / LIST).cast("int").alias("blocks")), "long-lists")
    blocks = F.coalesce("blocks", F.lit(1))
    every, own = F.explode(F.sequence(F.lit(0), blocks - 1)), F.pmod(F.xxhash64("fp"), blocks).cast("int")
    posts = posts.join(long, ["part", "value"], "left")
    posts = posts.select("fp", "more", "node", "part", "value", F.lit(True).alias("posted"), own.alias("block"), every.alias("other"))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for part, (mask, values) in enumerate(zip(masks, flips)):
                turn = np.array([signed(v) for v in values], np.int64)
                step = max(1, (1 << 16) // len(values))
                for at in range(0, len(fp), step):
                    value = (fp[at : at + step] & np.int64(signed(mask)))[:, None] ^ turn[None, :]
                    rows = batch.take(pa.array(np.repeat(np.arange(at, at + len(value)), len(values))))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(value.size, part, np.int32)), pa.array(value.ravel())], names=[*rows.schema.names, "part", "value"])

    asked = fps.select("fp", "more", "node").mapInArrow(probes, "fp long, more array<long>, node long, part int, value long")
    asked = asked.join(long, ["part", "value"], "left")
    asked = asked.select("fp", "more", "node", "part", "value", F.lit(False).alias("posted"), every.alias("block"), own.alias("other"))
    key = ["part", "value", "block", "other"]
    met = posts.unionByName(asked).repartition(*key).sortWithinPartitions(*key)
    return met.select(*key, "posted", "node", "fp", "more").mapInArrow(_verify(distance, whole), "a long, b long")


def _verify(distance: int, whole: int | None):
    def rows_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "block", "other", "posted", "node", "fp")]
        out[4] = out[4].astype(bool)
        more = batch.column("more").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return [*out[:6], np.concatenate((out[6][:, None], more), 1).view(np.uint64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive in order of their list; a list may go on in the next batch."""
        rest: list[np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            rows = rest if batch is None else rows_of(batch)
            if rows is None:
                return
            if batch is not None and rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            step = np.any([x[1:] != x[:-1] for x in rows[:4]], axis=0)
            heads = np.concatenate(([0], np.flatnonzero(step) + 1))
            done = len(rows[0]) if batch is None else int(heads[-1])  # the last list may not be complete
            rest = [x[done:] for x in rows]
            if done:
                heads = heads[heads < done]
                a, b = _forest(heads, np.append(heads[1:], done), *(x[:done] for x in rows[4:]), distance, whole)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _near(f: np.ndarray, g: np.ndarray, distance: int, whole: int | None) -> np.ndarray:
    """Whether fingerprints, with words along the last axis, are linked."""
    out = np.bitwise_count(f[..., 0] ^ g[..., 0]) <= distance
    if whole is not None and out.any():
        at = np.nonzero(out)
        f, g = (np.broadcast_to(x, (*out.shape, x.shape[-1]))[at] for x in (f, g))
        out[at] = np.bitwise_count(f ^ g).sum(-1, dtype=np.int64) <= whole
    return out


def _forest(heads, ends, posted, node, fp, distance, whole) -> tuple[np.ndarray, np.ndarray]:
    """Links between those posted and those that probe, list by list: all of short lists, a spanning forest of others."""
    n_posted = np.add.reduceat(posted.astype(np.int64), heads)
    n_probes = ends - heads - n_posted
    order = np.argsort(np.repeat(np.arange(len(heads)), ends - heads) * 2 + ~posted, kind="stable")  # those posted come first
    fp, node = fp[order], node[order]
    short = (n_posted * n_probes > 1) & (n_posted * n_probes <= SHORT)
    first, many, few = heads[short], n_posted[short], n_probes[short]
    x = np.repeat(ranges(first + many, few), np.repeat(many, few))
    y = ranges(np.repeat(first, few), np.repeat(many, few))
    near = node[x] > node[y]
    x, y = x[near], y[near]
    near = _near(fp[x], fp[y], distance, whole)
    a, b = [node[x[near]]], [node[y[near]]]
    large = n_posted * n_probes > SHORT
    for h, n, e in zip(heads[large].tolist(), n_posted[large].tolist(), ends[large].tolist()):
        own = node[h : h + n]
        label = dict(zip(node[h:e].tolist(), node[h:e].tolist()))
        roots = lambda nodes: np.array([_root(label, k) for k in nodes.tolist()])  # noqa: E731, B023
        step = max(1, (1 << 18) // n)
        for at in range(h + n, e, step):
            to = min(e, at + step)
            near = _near(fp[at:to, None], fp[None, h : h + n], distance, whole)
            near &= node[at:to, None] != own[None, :]
            some, of = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            near = near[np.ix_(some, of)]
            while len(some):  # join each probe to one more component, until no link goes between two
                near &= roots(node[at + some])[:, None] != roots(own[of])[None, :]
                some, near = some[left := near.any(1)], near[left]
                for p, q in zip(node[at + some].tolist(), own[of[near.argmax(1)]].tolist() if len(some) else []):
                    p, q = _root(label, p), _root(label, q)
                    label[max(p, q)] = min(p, q)
        keys = np.array(list(label))
        top = roots(keys)
        a.append(keys[keys != top])
        b.append(top[keys != top])
    return np.concatenate(a), np.concatenate(b)


def _root(label: dict, k: int) -> int:
    while label[k] != k:
        label[k] = label[label[k]]
        k = label[k]
    return k


# -- components


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of its component) for all nodes that an edge (a, b) names.

    Star contraction: in turn, each node's larger neighbours, then its smaller ones and itself, are joined
    to its least neighbour, until nothing changes. Only least neighbours are gathered, never all of one node's.
    """
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    edges = written(edges.where("a != b").select(high, low).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, wide: int = 0, whole: int | None = None) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable by links).

    With ``wide`` further fingerprints, links are verified by ``whole`` bits over all, which tells similarities apart more finely.
    """
    prints = written(fingerprints(docs, shingle, wide), "fingerprints")
    # A fingerprint's node is its least doc_id; one that only null doc_ids have gets a name of its own.
    known = prints.groupBy("fp", "more").agg(F.min("doc_id").alias("least"))
    known = known.withColumn("node", F.coalesce("least", F.expr("-1 - pmod(xxhash64(fp, more), 9000000000000000000)")))
    known = written(known, "distinct-fingerprints")
    found = components(links(known.select("fp", "more", "node"), distance, whole if wide else None))
    # Names that aren't doc_ids give way to the least doc_id among the others.
    root = known.join(found, "node", "left").select("fp", "more", "least", F.coalesce("component", "node").alias("root"))
    name = root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = root.join(name, "root").select("fp", "more", "component_id")
    return prints.join(by_fp, ["fp", "more"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
