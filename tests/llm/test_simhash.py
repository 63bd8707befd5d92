"""SimHash near-dedup against plain Python."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    out = 0
    for bit in range(64):
        n = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (2 * n > len(shingles)) << bit
    return out


def brute_components(rows, distance=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def documents(seed):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(40, 120))] for _ in range(20)]
    out = []
    for i in range(300):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 9)}"
        out.append((5000 - i * 7, " ".join(words).title()))
    out += [(9, None), (8, ""), (10, " \n"), (11, "one"), (12, "ONE"), (13, "é one"), (None, out[0][1]), (None, "alone at last here now"), (14, out[3][1]), (14, out[3][1])]
    return out + [(6000, "long " * 100_000)]


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 3)])
def test_near_duplicates_equal_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", block)
    rows = documents(seed)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, node string")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == brute_components(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def cluster(rnd, n):
    base = int(rnd.integers(0, 1 << 62))
    return [base ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 4), replace=False)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_every_link_is_found(spark, seed):
    rnd = np.random.default_rng(seed)
    fps = sorted({f for _ in range(12) for f in cluster(rnd, 40)} | {int(x) for x in rnd.integers(0, 1 << 62, 200)})
    known = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long").withColumn("more", F.expr("cast(array() as array<long>)"))
    edges = [(r[0], r[1]) for r in simhash.links(known, 4).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 64 for a, b in edges)
    label = {r["node"]: r["component"] for r in simhash.components(simhash.links(known, 4)).collect()}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert all(label.get(i, i) == root(i) for i in range(len(fps)))


def test_similar_documents_are_found_by_wide_fingerprints(spark):
    rnd = random.Random(4)
    base = [[f"w{rnd.randint(0, 10**6)}" for _ in range(300)] for _ in range(40)]
    rows, want = [], {}
    for i, words in enumerate(base):
        rows.append((3 * i, " ".join(words)))
        near, far = list(words), list(words)
        for k in rnd.sample(range(300), 3):  # similarity over 0.9
            near[k] = "changed"
        for k in range(0, 300, 8):  # below 0.3
            far[k] = "changed"
        rows += [(3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
        want |= {3 * i: 3 * i, 3 * i + 1: 3 * i, 3 * i + 2: 3 * i + 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 11, 5, wide=3, whole=40).collect()}
    assert sum(got[k] == want[k] for k in want) >= len(want) - 2 and all(got[k] == k for k in want if want[k] == k)


def test_thresholds_cover_every_way_to_differ():
    rnd = np.random.default_rng(1)
    bits = (rnd.random((500, 64)) < rnd.random(64)).astype(np.int64)
    for n in (1, 1000, 10**6, 10**10):
        plan = simhash.planned(n, bits.T @ bits * max(1, n // 500), 4)
        assert sum(t + 1 for _, t in plan) == 5
        used = [b for g, _ in plan for b in g]
        assert len(used) == len(set(used))
