"""Substring dedup and suffix-array dedup against plain Python."""

import random

import numpy as np
import pytest

from tidemark.llm import substrings, suffixes

DOCS = "doc_id long, text string, chunk string"


def documents(seed, n=120, long=True):
    """Documents that share passages, with copies, repeats, nulls, ties and very long texts."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "bb", "cc c", "é", "ddd", "x" * 30]) + rnd.choice(["", "", str(rnd.randint(0, 99))])
    passages = [[word() for _ in range(rnd.randint(3, 60))] for _ in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts += rnd.choice(passages)[rnd.randint(0, 9) :] if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(1, 40))]
        out.append((i * 3 % n if n % 3 else i, rnd.choice([" ", "  ", "\n", "\t "]).join(parts)))
    out += [(1000 + i, out[5][1]) for i in range(4)] + [(2000, None), (2001, ""), (2002, " \n"), (None, out[7][1]), (7, out[7][1]), (7, out[9][1])]
    if long:
        out += [(3000, " ".join(word() for _ in range(120_000))), (3001, "at " * 3000), (3002, "zz at " + "at " * 3000), (3003, "\x00" * 500)]
    return out


def split(text):
    return (text or "").encode().split()


def brute_words(rows, window):
    key = lambda d: (d is not None, d or 0)
    least = {}
    for d, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, key(d)), key(d))
    out = []
    for d, text in rows:
        w = split(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,window,size", [(1, 5, 1 << 12), (2, 13, 8 << 20)])
def test_substrings_equal_brute_force(spark, seed, window, size):
    rows = documents(seed)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], DOCS)
    got = sorted(map(tuple, substrings.remove_repeated(docs, window, size).collect()), key=repr)
    assert got == brute_words(rows, window)


def thue_morse(n):
    """Two words of ``n`` letters that polynomial hashes modulo 2**64 take for one another."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_substrings_tell_colliding_words_apart(spark):
    one, two = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{rest} {one}"), (2, f"{rest} {two}"), (3, f"{rest} {one}")]
    got = sorted(map(tuple, substrings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect()))
    assert got == brute_words(rows, 13) and [r[2] for r in got] == [0, 0, 13]


def test_suffixes_tell_colliding_strings_apart(spark):
    one, two = thue_morse(2048)
    rows = [(1, "x" + one), (2, "x" + two), (3, "y" + one)]
    got = sorted(((*r[:4], bytes(r[4])) for r in suffixes.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 1500).collect()))
    assert got == brute_bytes(rows, 1500)


def test_windows_of_one_hash_are_grouped_by_their_words():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab") for _ in range(40)).encode() for _ in range(20)]
    w = substrings.Words(texts, 4)
    w.hash = w.hash & np.uint64(3)
    some = np.flatnonzero(np.arange(len(w.first)) % 3 > 0)
    seen, want = {}, []
    for i in some.tolist():
        want.append(seen.setdefault(tuple(w.ids[w.first[i] : w.first[i] + 4]), i))
    assert w.leaders(some).tolist() == want


def test_slices_of_one_hash_are_grouped_by_their_bytes():
    rnd = np.random.default_rng(2)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    begins, sizes = np.sort(rnd.integers(0, 2900, 900)), rnd.integers(1, 12, 900)
    by = rnd.permutation(900)
    seen, want = {}, {}
    for i in by.tolist():
        want[i] = seen.setdefault(data[begins[i] : begins[i] + sizes[i]].tobytes(), i)
    for hashes in (np.zeros(900, np.uint64), suffixes.hashed(data, begins, begins + sizes)):
        order = by[np.argsort(hashes[by], kind="stable")]
        got = suffixes.leaders(suffixes.words_of(data), begins, sizes, hashes, by)
        assert got.tolist() == [want[i] for i in range(900)], order


def test_messages_grow_with_the_keys_not_with_chunks_times_shards(monkeypatch):
    from tidemark.llm import exchange

    monkeypatch.setattr(exchange, "CELLS", 64)
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
    sketch = exchange.Sketch(1_000_000, 2)
    assert sketch.shards == 62_500 and len(sketch.ask(3, keys)) <= 2 * len(keys)
    assert len(exchange.Met(1 << 40).ask(3, keys)) <= len(keys)


def test_substrings_empty_tables(spark):
    for rows in ([], [(1, None, None)], [(1, "", "x"), (1, "", "x")]):
        got = substrings.remove_repeated(spark.createDataFrame(rows, DOCS)).collect()
        assert [tuple(r)[1:] for r in got] == [(0, 0, "")] * len(rows)


# -- suffix-array dedup


def brute_bytes(rows, length):
    key = lambda d: (d is not None, d or 0)
    least = {}
    for d, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            least[k] = min(least.get(k, (key(d), i)), (key(d), i))
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < (key(d), i):
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((d, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,length,size,hot", [(3, 30, 1 << 12, 1 << 12), (4, 100, 8 << 20, 1 << 12), (5, 100, 1 << 15, 3), (6, 12, 1 << 14, 2)])
def test_suffixes_equal_brute_force(spark, seed, length, size, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = documents(seed, 100)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffixes.remove_repeated(spark.createDataFrame([(d, t, "clash") for d, t in rows], DOCS), length, size).collect()), key=repr)
    want = brute_bytes(rows, length)
    assert [g[:4] for g in got] == [w[:4] for w in want] and got == want


def test_suffixes_empty_tables(spark):
    for rows in ([], [(1, None, None)], [(1, "", "x"), (1, "", "x")]):
        got = suffixes.remove_repeated(spark.createDataFrame(rows, DOCS)).collect()
        assert [tuple(r)[1:4] for r in got] == [(0, 0, 0)] * len(rows)


@pytest.mark.parametrize("seed", range(8))
def test_deep_shallow_sorts(seed):
    rnd = np.random.default_rng(seed)
    data = rnd.integers(97, 97 + 1 + seed % 3, 900).astype(np.uint8)
    length = [5, 8, 20, 41, 64, 100, 33, 12][seed]
    at = rnd.integers(0, len(data) - length, 700)
    group = rnd.integers(0, 3, 700)
    order, new = suffixes.deep_shallow(data, at, group, length, [16, 32][seed % 2])
    keys = [(int(group[i]), data[at[i] : at[i] + length].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(700))
    assert new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(700)]


def test_blind_trie_sorts():
    rnd = random.Random(0)
    for _ in range(200):
        strings = [bytes(rnd.choice(b"ab") for _ in range(6)) for _ in range(rnd.randint(1, 30))]
        classes = suffixes.blind_trie(strings)
        assert [strings[c[0]] for c in classes] == sorted(set(strings)) and all(len({strings[i] for i in c}) == 1 for c in classes)
        assert sorted(i for c in classes for i in c) == list(range(len(strings)))
