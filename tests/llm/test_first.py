"""Decontamination, mixing, URL filters and chat formatting against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import chat, decontam, mixing, urls

DOCS = "doc_id long, text string, source string, n_words string"


# -- decontamination


def brute_spans(doc, items, window):
    hit, found = set(), set()
    for name, item in items:
        size = min(window, len(item))
        for k in range(len(item) - size + 1 if size else 0):
            w = item[k : k + size]
            for a in range(len(doc) - size + 1):
                if doc[a : a + size] == w:
                    hit.update(range(a, a + size))
                    found.add(name)
    return hit, found


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_brute_force(seed):
    import random

    rnd = random.Random(seed)
    word = lambda: rnd.choice([b"a", b"b", b"c"])
    items = [(str(i), [word() for _ in range(rnd.randint(0, 9))]) for i in range(6)]
    items += [items[0], ("x", items[1][1][1:])]
    automaton = decontam.Automaton(items, 4)
    for _ in range(30):
        doc = [rnd.choice([word(), b"z"]) if rnd.random() < 0.2 else word() for _ in range(rnd.randint(0, 25))]
        runs, found = automaton.match(doc)
        hit, names = brute_spans(doc, items, 4)
        assert {k for a, b in runs for k in range(a, b)} == hit
        assert {automaton.names[i] for i in found} == names
        assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))


def test_decontamination_cases(spark):
    docs = spark.createDataFrame(
        [(1, "x The, QUICK brown-fox y", "s", "k"), (2, None, None, None), (3, "", "s", "k"), (None, "the quick brown fox", "s", "k"), (4, "é " * 30000 + "short item", "s", "k")], DOCS
    )
    items = spark.createDataFrame([(7, "the quick brown fox"), (None, "short item"), (8, None), (9, "quick brown fox jumps"), (7, "the quick brown fox")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.report(decontam.spans(docs, items, window=3)).collect()}
    assert rows[1]["n_words"] == 6 and [tuple(s) for s in rows[1]["spans"]] == [(1, 5)] and rows[1]["items"] == ["7", "9"]
    assert rows[2]["n_words"] == 0 and not rows[2]["contaminated"] and rows[3]["n_hit"] == 0
    assert rows[None]["contaminated"] and rows[4]["items"] == [""] and not rows[4]["contaminated"]
    many = {r["doc_id"]: r for r in decontam.report(decontam.spans(docs, items, window=3, size=4)).collect()}
    assert {k: (r["spans"], r["items"], r["n_words"]) for k, r in many.items()} == {k: (r["spans"], r["items"], r["n_words"]) for k, r in rows.items()}
    assert decontam.spans(docs, items.limit(0)).where(F.size("spans") > 0).count() == 0
    assert decontam.spans(docs.limit(0), items).count() == 0
    clean = {r["doc_id"]: r["clean_text"] for r in decontam.without_spans(decontam.spans(docs, items, window=3)).collect()}
    assert clean[1] == "x  y" and clean[2] == "" and clean[None] == ""


# -- mixing


def brute_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, out = share * sum(sizes.values()), set(), {}
    while True:
        rest = left - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else rest * w[s] / total for s in names}
        more = {s for s in names if out[s] > most * sizes[s] + 1e-9}
        if not more:
            return out
        full |= more


def mixed(spark, rows, **more):
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("start", F.lit(1))
    return mixing.mix(docs, **more).collect()


def test_mixing_targets_and_takings(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 7, 40, 300, 5000])), rnd.choice(["hot"] * 6 + ["a", "b", "é", "z", None]), None) for i in range(400)]
    rows += [(401, None, "b", None), (None, "one two\tthree\x0bfour\u00a0same", "b", None), (3, "x", "tiny", None), (3, "x", "tiny", None)]
    out = mixed(spark, rows, block=64)
    again = mixed(spark, rows[::-1], block=64)
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goal = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)


def test_mixing_small_tables(spark):
    assert mixed(spark, []) == []
    assert [(r["size"], r["taken"], r["target"]) for r in mixed(spark, [(1, None, "a", None), (2, "", None, None)])] == [(0, 0, 0.0)] * 2
    assert [r["taken"] for r in mixed(spark, [(1, "a b c d", None, None)])] == [6]


def test_schedule_follows_weights_everywhere(spark):
    goals = spark.createDataFrame([("a", 60000, 60000.0), ("b", 60000, 20000.0), ("c", 60000, 40000.0)], "source string, source_size long, target double")
    rows = sorted((r for r in mixing.schedule(goals, 1200, 100).collect() if r["slot"] is not None), key=lambda r: r["slot"])
    for k in (60, 240, 600, 1100):
        for s, p in (("a", 1 / 2), ("b", 1 / 6), ("c", 1 / 3)):
            assert abs(sum(r["source"] == s for r in rows[:k]) - k * p) < 4


# -- url filters

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def test_url_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org#/es/": ("example.org", "", None, None),
        "x://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
        "http://com/de/?a#b": ("com", "/de/", "com/de/", "block"),
        "http://a.com?q=/fr/": ("a.com", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "no-host": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] * 2 + [(None, None, "h")], "page_id long, url string, score string")
    rows = urls.judge(pages, RULES).collect()
    assert len(rows) == 2 * len(cases) + 1 and len({(r["url"], r["verdict"]) for r in rows}) == len(cases)
    for r in rows:
        host, path, rule, verdict = cases[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_url_model_equals_plain_python(spark):
    import math
    import random

    rnd = random.Random(2)
    train = [(f"http://h{rnd.randint(1, 9)}.com/fr/{rnd.randint(1, 99)}", "allow") for _ in range(40)] + [(f"http://q{rnd.randint(1, 9)}.com/de/x{rnd.randint(1, 99)}", "block") for _ in range(30)]
    other = ["http://h3.net/fr/12", "http://q3.net/de/x4", "", "http://é.net/"]
    pages = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate([u for u, _ in train] + other)], "page_id long, url string, _key string, page string")
    got = {r["url"]: r for r in urls.judge(pages, RULES).collect()}
    assert got[""]["_key"] == "a" and got[""]["page"] == "b"
    held = F.pmod(F.xxhash64(F.lit("held"), "url"), F.lit(urls.HELD)) == 0
    held = {r["url"] for r in pages.where(held).collect()}
    assert {v for u, v in train if u in held} == {"allow", "block"}

    def fit(label):
        seen = {}
        for u, v in train:
            if v == label and u not in held:
                t = "\x02" * 3 + u + "\x03"
                for i in range(3, len(t)):
                    for k in range(4):
                        seen.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                        seen[t[i - k : i]][t[i]] += 1
        return seen

    def p(seen, context, c):
        lower = p(seen, context[1:], c) if context else 1 / 256
        nexts = seen.get(context)
        return (nexts.get(c, 0) + len(nexts) * lower) / (sum(nexts.values()) + len(nexts)) if nexts else lower

    a, b = fit("allow"), fit("block")
    for u in other:
        t = "\x02" * 3 + u + "\x03"
        score = sum(math.log(p(a, t[i - 3 : i], t[i]) / p(b, t[i - 3 : i], t[i])) for i in range(3, len(t))) / (len(t) - 3)
        assert got[u]["score"] == pytest.approx(score, abs=1e-9)
    assert got[other[0]]["verdict"] == "allow" and got[other[1]]["verdict"] == "block"


def test_url_filter_small_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(pages, RULES).collect()] == ["allow"]
    assert urls.judge(pages.limit(0), RULES).collect() == []


# -- chat

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("formatted", T.StringType())])


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|>", "<\\\\||", "<", "|", "\\", "", None, "<|im_sep|>", "é\n<|", "a<", "|im_end|>\n"]
    roles = ["assistant", "assistant", "user", "us\ner", "<|im_start|>", "\\n", "", None, "a\\\\nb", "<\\|"]
    rows = [(c, t, roles[(c * 7 + t * 3) % len(roles)] if t % 3 else "assistant", nasty[(c * 5 + t) % len(nasty)], "x") for c in range(12) for t in range(15)]
    rows += [(None, 1, "user", "u", "x"), (None, 1, "user", "u", "x"), (50, None, "assistant", "first", "x"), (50, 1, "assistant", "y" * 200_000, "x")]
    out = chat.format_chats(spark.createDataFrame(rows, TURNS))
    out = out.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert {r["conv_id"] for r in out} == set(want)
    for r in out:
        turns = sorted(want[r["conv_id"]])
        assert [tuple(t) for t in r["read"]] == [(b, x) for _, _, b, x in turns]
        assert r["loss"] == "".join(x for _, _, b, x in turns if b == "assistant")
        assert len(r["loss_spans"]) == sum(b == "assistant" for _, _, b, _ in turns)
        assert r["n_blocks"] == 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:])) == r["formatted"].count("<|im_start|>")


def test_chat_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_digest():
    assert decontam.digest_items(["1", "2"]) == hashlib.sha256(b"1,2").hexdigest()
