"""URL filters: rules on host and path, then a character language-model ratio (DataFrame functions only).

URLs that a rule allows or blocks train two variable-order Markov models of characters, one for each
verdict. Both are smoothed by interpolation: a context of ``k`` characters that was seen ``n`` times
with ``t`` different next characters gives ``(count + t * lower) / (n + t)``, where ``lower`` is the
estimate of the context with one character less, and 1/256 below the empty one. The score of a URL is
the mean over its characters, and its end, of the log ratio. One in ``held`` training URLs, by hash, is left out of the
models; the cut between the verdicts lies where the scores of the allowed and the blocked ones of those, taken as normal,
are as many deviations away (of all training URLs, where those left out lack a verdict). With ``held`` 0 none is left out:
all training URLs are in the models and make the cut.

Grams that make up a thousandth of all positions or more, at most a thousand of them, are broadcast; the others are joined
by a shuffle in which no gram has a larger part than that.

Defined cases: a null url or one without ``://`` has empty host and path, so no rule fits, and is
judged by the model as the text that it is (null: empty); a very long url is scored whole; equal urls get equal verdicts; rules of
equal length that disagree block; without training URLs of both verdicts the model allows all; an
empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Characters of the longest context. A gram is a context and the next character.
ORDER = 3
#: Marks before and after a url, so that each position has a full gram: control characters.
HEAD, END = "\x02", "\x03"
UNSEEN = 1.0 / 256
#: One in so many training URLs calibrates, unless the caller says otherwise; a gram with one in so many positions is frequent.
HELD, FREQUENT = 5, 1000


def host_of(url: Column) -> Column:
    rest = _rest(url)
    lower = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path, verdict) that fits, as a struct (n, block, rule, verdict); null if none does.

    ``rules`` is a list that the caller states; it becomes one expression, so the table isn't shuffled.
    """
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(v == "block").alias("block"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.greatest(*fits, F.lit(None)) if fits else F.lit(None)


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """A row for each position of each url: its columns and gram, the ``order`` characters before with the character."""
    marked = F.concat(F.lit(HEAD * order), F.col("url"), F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.char_length("url") + 1))
    return urls.withColumn("marked", marked).withColumn("at", at).withColumn("gram", F.substr("marked", F.col("at"), F.lit(order + 1))).drop("marked", "at")


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, ratio: the log ratio of each gram in ``counts`` (gram, allow, block) under the two models."""
    cut = F.col("gram")
    out = counts.select("gram", F.lit(UNSEEN).alias("p_allow"), F.lit(UNSEEN).alias("p_block"))
    for k in range(order + 1):  # from the empty context up
        own = counts.select(
            F.substr(cut, F.lit(order + 1 - k)).alias("tail"), F.substr(cut, F.lit(order + 1 - k), F.lit(k)).alias("context"), "allow", "block"
        )
        tails = own.groupBy("context", "tail").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        contexts = tails.groupBy("context").agg(
            F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"),
            F.count_if(F.col("allow") > 0).alias("t_allow"), F.count_if(F.col("block") > 0).alias("t_block"),
        )
        level = tails.join(contexts, "context").drop("context")
        step = lambda v: F.when(
            F.col(f"n_{v}") > 0, (F.col(v) + F.col(f"t_{v}") * F.col(f"p_{v}")) / (F.col(f"n_{v}") + F.col(f"t_{v}"))
        ).otherwise(F.col(f"p_{v}"))
        out = (
            out.withColumn("tail", F.substr(cut, F.lit(order + 1 - k)))
            .join(level, "tail")
            .select("gram", step("allow").alias("p_allow"), step("block").alias("p_block"))
        )
    return out.select("gram", F.log(F.col("p_allow") / F.col("p_block")).alias("ratio"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], order: int = ORDER, held: int = HELD) -> DataFrame:
    """Adds host, path, rule, verdict and score (null where a rule decides) to ``pages``."""
    url = F.coalesce("url", F.lit(""))
    fits = lambda c: rule_of(host_of(c), path_of(c), rules)
    distinct = pages.groupBy(url.alias("url")).agg(F.count("*").alias("n"))
    left_out = F.pmod(F.xxhash64(F.lit("held"), "url"), F.lit(held)) == 0 if held else F.lit(False)
    distinct = written(distinct.select("url", "n", fits(F.col("url"))["verdict"].alias("label"), left_out.alias("held")), "urls")
    each = grams(distinct, order)
    n = lambda v: F.sum(F.when((F.col("label") == v) & ~F.col("held"), F.col("n")).otherwise(0))
    counts = written(each.groupBy("gram").agg(n("allow").alias("allow"), n("block").alias("block"), F.count("*").alias("seen")), "url-grams")
    ratios = written(model(counts, order).join(counts.select("gram", "seen"), "gram"), "url-model")
    positions = counts.agg(F.sum("seen")).first()[0] or 0
    often = F.col("seen") * FREQUENT >= positions
    frequent, rare = F.broadcast(ratios.where(often).select("gram", "ratio")), ratios.where(~often).select("gram", "ratio")
    met = each.join(frequent, "gram").unionByName(each.join(frequent, "gram", "left_anti").join(rare.hint("merge"), "gram"))
    scores = written(met.groupBy("url", "n", "label", "held").agg(F.avg("ratio").alias("score")), "url-scores")
    apart = scores.where("label is not null").groupBy("label", "held").agg(
        F.sum("n").alias("n"), F.sum(F.col("score") * F.col("n")).alias("sum"), F.count("*").alias("urls"), F.avg("score").alias("centre"), F.var_pop("score").alias("spread")
    ).collect()  # fmt: skip  # four rows
    if {"allow", "block"} <= {r["label"] for r in apart if r["held"]}:
        apart = [r for r in apart if r["held"]]
    fit = {}
    for v in {r["label"] for r in apart}:
        own = [r for r in apart if r["label"] == v]
        size, sum_, k = (sum(r[c] for r in own) for c in ("n", "sum", "urls"))
        centre = own[0]["centre"] + sum(r["urls"] * (r["centre"] - own[0]["centre"]) for r in own) / k
        squares = sum(r["urls"] * (r["spread"] + (r["centre"] - centre) ** 2) for r in own)
        fit[v] = {"mean": sum_ / size, "dev": math.sqrt(squares / (k - 1)) if k > 1 else 0.0}
    if {"allow", "block"} <= fit.keys():
        a, b = fit["allow"], fit["block"]
        spread = a["dev"] + b["dev"]
        cut = (a["mean"] * b["dev"] + b["mean"] * a["dev"]) / spread if spread else (a["mean"] + b["mean"]) / 2
    else:
        cut = float("-inf")
    # The caller's columns are kept in one struct, so that none of their names clashes.
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("page"), url.alias("key"))
    out = out.withColumns({"host": host_of(F.col("page.url")), "path": path_of(F.col("page.url")), "hit": fits(F.col("page.url"))})
    judged = scores.where("label is null").select(F.col("url").alias("key"), "score")
    return out.join(judged, "key", "left").select(
        *[F.col(f"page.`{c}`").alias(c) for c in keep], "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")).alias("verdict"), "score",
    )
