"""Near copies: SimHash search as in ``simhash``, decided by the exact Jaccard similarity of sets of shingle hashes.

1. Documents of one set are one node; the rest is done once a node.
2. Nodes whose fingerprints are within ``DISTANCE`` bits are candidates: partitions and thresholds by ``simhash.planned``,
   probe and verify. Most sets of a similarity near the bound are further apart.
3. So that these are found too, min-hashes of a set make ``BANDS`` keys of ``ROWS`` each. Two sets of similarity 0.8 share a
   key but for a chance of (1 - 0.8 ** ROWS) ** BANDS, 3 in a million; nodes that share a key are candidates as well.
4. Candidates are linked if ``DOWN`` times the common shingles are ``UP`` times those of either at least. Of keys that
   few nodes have, distinct pairs are joined to the sets; those of others are compared in blocks, each pair of blocks by
   itself, and only where no link joins them yet.

Defined cases: a null or empty text has the empty set, which is only similar to itself; a very long text is taken whole; fewer words than a shingle make
one shingle of all of them; a null doc_id is no component's name unless all are null; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices, texts, written
from .exchange import U, mixed
from .simhash import components, fingerprint, shingle_hashes
from .simhash import links as within

#: The least similarity of a link.
UP, DOWN = 4, 5
#: Bits in which the fingerprints of candidates differ at most.
DISTANCE = 4
#: Min-hashes in a key, and keys of a set.
ROWS, BANDS = 5, 32
#: Nodes with a key of which all pairs are listed; shingles in a block of others.
SHORT, BLOCK = 16, 1 << 18
_TURNS = mixed(np.arange(1, ROWS * BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle).astype(U))


def name(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def keys(own: np.ndarray) -> np.ndarray:
    """A key for each band."""
    low = np.full(ROWS * BANDS, U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), 1 << 10):
        np.minimum(low, (own[None, at : at + (1 << 10)] * _TURNS[:, None]).min(1), out=low)
    low = (mixed(low) * _TURNS).reshape(BANDS, ROWS).sum(1, dtype=U)
    return mixed(low + np.arange(BANDS, dtype=U)).view(np.int64)


def _lists(found: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat))


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node (a hash of the set), n (its size), fp (its fingerprint) and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = [shingles(t, shingle) for t in texts(batch.column("text"))]
            nodes, sizes, fps = [name(s) for s in sets], [len(s) for s in sets], np.array([fingerprint(s) for s in sets], U).view(np.int64)
            columns = [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps), _lists([keys(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node long, n long, fp long, keys array<long>")


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node and hashes of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = [shingles(t, shingle) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([name(s) for s in found], pa.int64()), _lists(found)], names=["node", "hashes"])

    return docs.select("text").mapInArrow(run, "node long, hashes array<long>")


def forest(node: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all similar ones of some sets, directly or by others. ``values``: the sorted sets, one after another."""
    begins, label, place = np.cumsum(sizes) - sizes, np.arange(len(node)), np.arange(len(node))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, (begin, n) in enumerate(zip(begins.tolist(), sizes.tolist())):
        able = DOWN * np.minimum(sizes, n) >= UP * np.maximum(sizes, n)
        others = np.flatnonzero(able & (label != label[p]) & (place > p))
        if not n or not len(others):
            continue
        own, some = values[begin : begin + n], values[ranges(begins[others], sizes[others])]
        common = own[np.minimum(np.searchsorted(own, some), n - 1)] == some
        common = np.add.reduceat(common.astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        near = others[(UP + DOWN) * common >= UP * (n + sizes[others])]
        a.append(np.full(len(near), node[p]))
        b.append(node[near])
        label[np.isin(label, label[near])] = label[p]
    return np.concatenate(a), np.concatenate(b)


def _compare(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    hashes = table.column("hashes").combine_chunks()
    hashes = hashes.chunk(0) if isinstance(hashes, pa.ChunkedArray) else hashes
    sizes = np.diff(hashes.offsets.to_numpy())
    a, b = forest(table.column("node").to_numpy(), hashes.flatten().to_numpy().view(U), sizes.astype(np.int64))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def searched(known: DataFrame) -> DataFrame:
    """Pairs (a < b) that the search by fingerprint finds; of longer lists those that join all within ``DISTANCE``, directly or by others."""
    found = within(known.select("fp", F.array().cast("array<long>").alias("more"), "node"), DISTANCE)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")


def links(docs: DataFrame, known: DataFrame, shingle: int) -> DataFrame:
    """Edges (a, b) between nodes of ``known`` (node, least, n, fp, keys) that join all similar ones, directly or by others."""
    posts = known.select("node", "n", F.explode("keys").alias("key"))
    # Joined by merging at any size: a table that is broadcast only while it is small makes the work a row uneven.
    shared = posts.groupBy("key").agg(F.count("*").alias("have"), F.sum("n").alias("total")).where("have > 1")
    posts = written(posts.join(shared.hint("merge"), "key"), "shared-keys")

    few = posts.where(F.col("have") <= SHORT).groupBy("key").agg(F.collect_list(F.struct("node", "n")).alias("x"))
    few = few.select(F.explode("x").alias("x"), F.col("x").alias("all")).select("x", F.explode("all").alias("y")).where("x.node < y.node")
    able = DOWN * F.least("x.n", "y.n") >= UP * F.greatest("x.n", "y.n")
    few = few.where(able).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = written(searched(known).union(few).distinct(), "pairs")

    blocks = F.ceil(F.col("total") / BLOCK)
    many = posts.where(F.col("have") > SHORT).withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    many = many.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node")

    # Sets are made anew, of one document of each candidate.
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(many.select("node")).distinct()
    nodes = written(known.select("node", "least").join(nodes.hint("merge"), "node", "left_semi"), "candidates")
    some = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    some = some.join(nodes.select("least").distinct().hint("merge"), some["id"].eqNullSafe(F.col("least")), "left_semi")
    own = written(sets(some, shingle).dropDuplicates(["node"]).join(nodes.select("node").hint("merge"), "node", "left_semi"), "sets")

    x, y = (own.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")).hint("merge") for c in "ab")
    met = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    met = met.where((UP + DOWN) * F.col("common") >= UP * (F.size("of_a") + F.size("of_b"))).select("a", "b")
    rest = many.join(own.hint("merge"), "node").groupBy("key", "low", "high").applyInArrow(_compare, "a long, b long")
    return met.union(rest)


def near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Per document: doc_id and component_id, the least doc_id reachable by links."""
    each = written(prints(docs, shingle), "prints")
    known = each.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    known = written(known, "distinct-sets")
    found = components(links(docs, known, shingle))
    root = known.select("node", "least").join(found.hint("merge"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    names = root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = root.join(names, "root").select("node", "component_id")
    return each.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")
