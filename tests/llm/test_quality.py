"""Quality classifier: gradients, held-out accuracy, and odd tables."""

import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality


def test_gradient_equals_differences():
    rnd = np.random.default_rng(0)
    counts, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = rnd.normal(size=(6, 5))
    model = quality.fit(x, counts, y, epochs=1)
    model.p = {k: np.array(v + rnd.normal(size=v.shape) * 0.3) for k, v in model.p.items()}
    loss = lambda: -np.mean(y * np.log(o := model.forward(x, counts)["score"]) + (1 - y) * np.log(1 - o))
    grads = model.gradient(model.forward(x, counts), counts, y)
    for k, v in model.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 7)]:
            keep = v[at].copy()
            v[at] = keep + 1e-5
            up = loss()
            v[at] = keep - 1e-5
            down = loss()
            v[at] = keep
            assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), k


def test_attention_weights_sum_to_one_and_use_every_passage():
    rnd = np.random.default_rng(1)
    x, counts = rnd.normal(size=(9, 4)), np.array([4, 1, 4])
    model = quality.fit(x, counts, np.array([1.0, 0.0, 1.0]), epochs=3)
    o = model.forward(x, counts)
    assert np.add.reduceat(o["weight"], [0, 4, 5]) == pytest.approx([1, 1, 1])
    moved = x.copy()
    moved[3] += 1
    assert model.forward(moved, counts)["score"][0] != o["score"][0]


def test_passages_cover_whole_texts():
    data = np.frombuffer(b"a" * 1024 + b"B" * 1024 + b"7" * 10, np.uint8)
    x, counts = quality.passages(data, np.array([0, 5, 0]), np.array([2058, 5, 1024]))
    assert counts.tolist() == [3, 1, 1] and x.shape == (5, quality.FEATURES)
    assert x[0, ord("a")] == x[1, ord("B")] == x[2, ord("7")] == x[4, ord("a")] == 1 and not x[3, :128].any()
    many, n = quality.passages(np.repeat(data, 40), np.array([0]), np.array([len(data) * 40]))
    assert n.tolist() == [-(-len(data) * 40 // 1024)] and len(many) == n[0]


def plain_score(m, text):
    """A score in plain loops over bytes, passages and units."""
    z, weights, hidden = [], [], []
    for a in range(0, max(len(text), 1), quality.PASSAGE):
        p = text[a : a + quality.PASSAGE]
        whole = max(len(p), 1)
        x = [math.sqrt(sum(min(b, 127) == v for b in p) / whole) for v in range(128)]
        classes = [int(quality._CLASS[b]) for b in p]
        pairs = list(zip(classes, classes[1:]))
        x += [math.sqrt(pairs.count((i, j)) / whole) for i in range(9) for j in range(9)]
        x += [math.log1p(len(p)) / 7, len(zlib.compress(p, 1)) / (len(p) + 20), sum(u == v for u, v in zip(p, p[1:])) / whole, float(len(p) < quality.PASSAGE / 4)]
        x = [(v - mean) / scale for v, mean, scale in zip(x, m.mean, m.scale)]
        dot = lambda v, w: sum(float(s) * float(t) for s, t in zip(v, w))
        h = [math.tanh(dot(x, m.p["w"][:, k]) + m.p["b"][k]) for k in range(quality.WIDTH)]
        q = [math.tanh(dot(h, m.p["v"][:, k])) / (1 + math.exp(-dot(h, m.p["u"][:, k]))) for k in range(quality.HEADS)]
        hidden.append(h)
        weights.append(math.exp(dot(q, m.p["a"])))
    z = [sum(w * h[k] for w, h in zip(weights, hidden)) / sum(weights) for k in range(quality.WIDTH)]
    return 1 / (1 + math.exp(-dot(z, m.p["c"]) - float(m.p["d"])))


def test_scores_equal_plain_loops(spark, tables):
    docs, labels = tables[:2]
    rows = [(10_000, "Some words, " * 400), (10_001, None), (10_002, ""), (10_003, "12 é\n" * 300), (1, "another text of this doc_id")]
    docs = docs.unionByName(spark.createDataFrame([(d, t, "clash") for d, t in rows], docs.schema))
    model = quality.learned(docs, labels)
    again = quality.learned(docs.repartition(7), labels)
    assert all((model.p[k] == again.p[k]).all() for k in model.p)
    for r in quality.scored(docs, model).where("doc_id < 12 or doc_id >= 10000").collect():
        assert r["score"] == pytest.approx(plain_score(model, (r["text"] or "").encode()), abs=1e-5)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(600):
        words, good = [word() for _ in range(rnd.randint(20, 400))], rnd.random() < 0.7
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "###" for w in words]
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(spark, tables):
    docs, labels, known = tables
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 600 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 80 and np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and len(r["attention"]) == r["passages"] for r in rows)
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs.repartition(3), labels.repartition(2)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-9) for r in rows)


def test_held_out_labels_are_never_learned(spark, tables):
    docs, labels, _ = tables
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_tables(spark, tables):
    docs, labels, _ = tables
    odd = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (None, "some text", "b"), (2, "é" * 100_000, None)], docs.schema)
    rows = quality.classify(odd.unionByName(docs.limit(50)), labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 0)], labels.schema))).collect()
    assert len(rows) == 54 and all(0 <= r["score"] <= 1 for r in rows) and {r["passages"] for r in rows if r["doc_id"] == 2} >= {196}
    assert not next(r for r in rows if r["doc_id"] is None)["held_out"]
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.classify(docs.limit(0), labels).collect() == []
