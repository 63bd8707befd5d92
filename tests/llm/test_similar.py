"""Near copies against plain Python: exact similarity, and recall at the bound."""

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from tidemark.llm import similar


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def close(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def planted(seed, low, high, pairs, words):
    """Pairs of texts with a similarity in [low, high)."""
    rnd, out = random.Random(seed), []
    while len(out) < pairs:
        one = [f"w{rnd.randint(0, 10**6)}" for _ in range(words)]
        two = list(one)
        for at in rnd.sample(range(words), rnd.randint(1, words // 20)):
            two[at] = "changed"
        a, b = shingles(" ".join(one)), shingles(" ".join(two))
        if low <= len(a & b) / len(a | b) < high:
            out.append((" ".join(one), " ".join(two)))
    return out


@pytest.mark.parametrize("bound", [0.80, 0.82, 0.85])
def test_recall_at_the_bound(spark, bound, tmp_path):
    pairs = planted(1, bound, bound + 0.02, 200, 300) + planted(2, bound, bound + 0.02, 100, 104)
    far = planted(3, 0.77, 0.80, 100, 300)
    rows = [(2 * i + k, text, "en", "s", 0) for i, pair in enumerate(pairs + far) for k, text in enumerate(pair)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents")
    got = {r["doc_id"] for r in cp.near_dedup(spark, spark.read.parquet(f"{tmp_path}/documents"), "").collect()}
    assert got == {2 * i for i in range(len(pairs))} | {2 * (len(pairs) + i) + k for i in range(len(far)) for k in (0, 1)}


@pytest.mark.parametrize("short,block", [(16, 1 << 18), (2, 500)])
def test_equals_brute_force(spark, short, block, monkeypatch):
    monkeypatch.setattr(similar, "SHORT", short)
    monkeypatch.setattr(similar, "BLOCK", block)
    rnd = random.Random(5)
    base = [[f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(40, 120))] for _ in range(8)]
    rows = []
    for i in range(240):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 9)}"
        rows.append((5000 - i * 7, " ".join(words)))
    rows += [(9, None), (8, ""), (10, " \n"), (11, "one"), (12, "one"), (13, "two words"), (None, rows[0][1]), (None, "alone at last here now")]
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and close(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    want = sorted(((d, least.get(x)) for (d, _), x in zip(rows, label)), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, similar.near_copies(docs).collect()), key=repr) == want


def test_candidates_come_from_the_fingerprints(spark, monkeypatch):
    """Without keys of min-hashes, pairs whose fingerprints are near are linked all the same, and others are not."""
    monkeypatch.setattr(similar, "keys", lambda own: np.zeros(0, np.uint64).view(np.int64))
    pairs = planted(4, 0.97, 1.0, 60, 600) + planted(5, 0.80, 0.82, 40, 300)
    docs = spark.createDataFrame([(2 * i + k, text) for i, pair in enumerate(pairs) for k, text in enumerate(pair)], "doc_id long, text string")
    near = {i for i, pair in enumerate(pairs) if (similar_print(pair[0]) ^ similar_print(pair[1])).bit_count() <= 4}
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs).collect()}
    assert {i for i in range(len(pairs)) if got[2 * i + 1] == 2 * i} == near and 40 <= len(near) < 80
    assert all(got[2 * i + 1] in (2 * i, 2 * i + 1) and got[2 * i] == 2 * i for i in range(len(pairs)))


def similar_print(text):
    """A bit is 1 if it is set in over half the hashes of the set."""
    hashes = similar.shingles(text.encode(), 5).tolist()
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
