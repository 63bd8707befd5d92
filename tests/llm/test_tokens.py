"""Token-ID output: the cached encoder, Re-Pair round trips, random access and the files."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a\n\nb", " a", "a ", "a\n b", "a \nb", "a\n", "\n", "\ta b", "x\x01 y", "a\xa0b c", "<|endoftext|> a", "it's we'll", "1 22 333", "é ß z", "!? .,\n-", "　", "a\r\nb", "😀 😀"]


def reference(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library():
    rnd = random.Random(1)
    bits = ["word", "Thé", ",", ".", "  ", " ", " ", " ", "\n", "\n\n", "42", "'s", "###", "\t", "日本", "<|endoftext|>"]
    texts = ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    encoder = tokens.Encoder(PATH)
    encoder.LIMIT = 300
    got = [x for at in range(0, len(texts), 100) for x in encoder.encode(texts[at : at + 100])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == reference(texts)


@pytest.mark.parametrize("seed", range(6))
def test_re_pair_round_trip(seed):
    rnd = np.random.default_rng(seed)
    ids = [rnd.integers(0, 3, 4000), rnd.zipf(1.3, 6000) % 50257, np.zeros(5000, int), np.array([], int), np.array([7]), np.tile([1, 1, 1, 2], 900)][seed].astype(np.uint32)
    lengths, left = [], len(ids)
    while left:
        lengths.append(min(left, int(rnd.integers(0, 60))))
        left -= lengths[-1]
    value = tokens.pack(ids, np.array(lengths, np.int64))
    shard = tokens.Shard(value)
    assert (shard.all() == ids).all() and shard.n_ids == len(ids) and shard.lengths.tolist() == lengths
    for _ in range(50):
        a, b = sorted(rnd.integers(0, len(ids) + 1, 2).tolist())
        assert (shard.slice(a, b) == ids[a:b]).all()
    ends = np.cumsum(lengths)
    for k in rnd.integers(0, max(len(lengths), 1), 20 if lengths else 0).tolist():
        assert (shard.document(k) == ids[ends[k] - lengths[k] : ends[k]]).all()
    if seed in (0, 2, 5):
        assert len(shard.symbols) < len(ids) / 2 and len(shard.grammar.lengths) > 0
    first, rules, rest = tokens.compress(ids)
    assert len(rest) < 2 or not len(tokens.counted(rest, tokens.LEAST, np.arange(len(rest) - 1))[0])  # it goes on until no pair is frequent
    assert all(max(pair) < first + k for k, pair in enumerate(rules.tolist()))


def test_overlapping_pairs_are_replaced_from_the_left():
    seq, rules, _ = tokens.replaced(np.array([5] * 17 + [1], np.uint32), 9, least=2)
    assert rules.tolist() == [[5, 5]] and seq.tolist() == [9] * 8 + [5, 1]


def test_pairs_are_counted_exactly():
    seq = np.random.default_rng(4).zipf(1.5, 3000).astype(np.uint32) % 40
    pairs, n, at, number, counts = tokens.counted(seq, 3, np.arange(len(seq) - 1))
    at, number = at[counts], number[counts]
    want, i = {}, 0
    for i in range(len(seq) - 1):
        row = i  # every other place of a row of equal symbols, from its left
        while row and seq[row - 1] == seq[i]:
            row -= 1
        if seq[i] != seq[i + 1] or (i - row) % 2 == 0:
            want.setdefault((int(seq[i]), int(seq[i + 1])), []).append(i)
    want = {k: v for k, v in want.items() if len(v) >= 3}
    assert {(int(p >> 32), int(p & 0xFFFFFFFF)): at[number == k].tolist() for k, p in enumerate(pairs.tolist())} == want
    assert n.tolist() == [len(v) for _, v in sorted(want.items())]


def test_repeated_passages_become_long_rules():
    ids = np.tile(np.random.default_rng(0).integers(0, 50000, 200), 40).astype(np.uint32)
    shard = tokens.Shard(tokens.pack(ids, np.array([len(ids)])))
    assert (shard.all() == ids).all() and len(shard.symbols) <= 80 and shard.grammar.lengths.max() >= 100


def test_files(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i * 7 % 1009, " ".join(rnd.choice(["alpha", "beta", "gamma delta", "ü"]) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    rows += [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, "first of all"), (9999, None), (9999, "b"), (9998, "long text " * 40_000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, ids int")
    got = tokens.stored(docs, PATH, 2, shard_ids=500).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    ids = [x + [2] for x in reference([t or "" for _, t in want])]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == ids
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist() and [r["n_tokens"] for r in got] == list(map(len, ids))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.stored(docs, PATH, 2).select(F.col("start")).collect() == []
