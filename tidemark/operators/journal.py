"""Replicated journals: folds of events, replay, truncation and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(events: DataFrame) -> DataFrame:
    """The last event of each (grp, lsn): precommit, commit or rollback."""
    return events.groupBy("grp", "lsn").agg(F.max_by("event", "seq").alias("state"), F.count("*").alias("n_events"))


def commit_order(events: DataFrame) -> DataFrame:
    """Commits whose lsn isn't above the commit before: none in a sound journal."""
    before = F.lag("lsn").over(Window.partitionBy("grp").orderBy("seq"))
    return events.where("event = 'commit'").withColumn("before_lsn", before).where("before_lsn >= lsn").select("grp", "lsn", "before_lsn")


def deduplicated(requests: DataFrame) -> DataFrame:
    """The first of the requests with one (server_id, term, dsn)."""
    rest = [c for c in requests.columns if c not in ("server_id", "term", "dsn")]
    first = requests.groupBy("server_id", "term", "dsn").agg(F.min_by(F.struct(*rest), "lsn").alias("_r"), F.count("*").alias("n_copies"))
    return first.select("server_id", "term", "dsn", "_r.*", "n_copies")


def replay_class(lsn: Column, checkpoint: Column, snapshot: Column, durable: Column) -> Column:
    return F.when(lsn <= F.greatest(checkpoint, snapshot), "skip").when(lsn <= durable, "commit").otherwise("precommit")


def lagged_truncation(checkpoints: DataFrame, back: int = 2) -> DataFrame:
    """The lsn that may be truncated at each checkpoint: that of ``back`` checkpoints before."""
    return checkpoints.withColumn("truncate_lsn", F.lag("cp_lsn", back).over(Window.partitionBy("grp").orderBy("cp_id")))


def truncate_boundary(rounds: DataFrame, reserve: int) -> DataFrame:
    """max(commit - reserve, least replicated index), not beyond the checkpoint, and never falling. rounds: grp, round, commit, min_idx, cp."""
    bound = F.least(F.greatest(F.col("commit") - reserve, F.col("min_idx")), F.col("cp"))
    order = Window.partitionBy("grp").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumn("boundary", F.max(bound).over(order))


def active(peers: DataFrame, lag: int = 2000) -> DataFrame:
    """Peers within ``lag`` of the furthest of their group whose log is still there (from ``start_idx`` on, if the column exists)."""
    top = peers.groupBy("grp").agg(F.max("idx").alias("_top"))
    out = peers.join(top, "grp").where(F.col("_top") - F.col("idx") <= lag).drop("_top")
    return out.where("idx >= start_idx - 1") if "start_idx" in peers.columns else out


def quorum(peers: DataFrame) -> DataFrame:
    """Votes that a commit needs, and the highest index that so many voters have."""
    n = Window.partitionBy("grp")
    rows = peers.where("can_vote").withColumn("quorum", F.expr("count(*) over (partition by grp) div 2 + 1"))
    rows = rows.withColumn("_nth", F.row_number().over(n.orderBy(F.col("idx").desc(), "peer")))
    return rows.where("_nth = quorum").select("grp", "quorum", F.col("idx").alias("quorum_idx"))


def expected_leader(peers: DataFrame) -> DataFrame:
    return peers.groupBy("grp").agg(F.max_by("peer", F.struct("priority", -F.col("peer"))).alias("leader"))


def follower_priority(n: Column) -> Column:
    """1 + ceil(100 * 0.8 ** min(5, n)), or 100 where n is 0."""
    return F.when(n == 0, 100).otherwise(1 + F.ceil(F.lit(100.0) * F.pow(F.lit(0.8), F.least(n, F.lit(5))))).cast("long")


def resync(commit: Column, own: Column, gap: int = 100) -> Column:
    return commit - own > gap


def expired(requests: DataFrame, age_s: int = 300) -> DataFrame:
    """Requests of followers to be dropped: behind the next dsn, too old, and not flushed. requests: dsn, next_dsn, age_s, state, is_leader."""
    return requests.where(~F.col("is_leader") & (F.col("dsn") < F.col("next_dsn") - 1) & (F.col("age_s") > age_s) & (F.col("state") != "LOG_FLUSHED"))


def replace_status(asks: DataFrame, peers: DataFrame) -> DataFrame:
    """The status of a member replacement. asks: grp, task, is_leader, stored_task, out, into, members (expected, with ``into``)."""
    now = peers.groupBy("grp").agg(F.collect_set("peer").alias("_now"), F.count("*").alias("_n"))
    out = asks.join(now, "grp", "left").withColumn("_now", F.coalesce("_now", F.array().cast("array<long>")))
    gone, there = ~F.array_contains("_now", F.col("out")), F.array_contains("_now", F.col("into"))
    others = F.size(F.array_except("_now", "members")) == 0
    done = F.when(gone & there & others, "COMPLETED").when(gone & there, "UNKNOWN").otherwise("TASK_NOT_FOUND")
    state = F.when(~F.col("is_leader"), "NOT_LEADER").when(F.col("stored_task").isNull(), done)
    state = state.when(F.col("stored_task") != F.col("task"), "TASK_ID_MISMATCH").otherwise("IN_PROGRESS")
    return out.withColumn("status", state).select("grp", "task", "status")


def quorum_safe(peers: DataFrame, swap: DataFrame, lag: int = 2000) -> DataFrame:
    """Whether active peers without the two that are swapped still make a majority. swap: grp, out, into."""
    left = active(peers, lag).join(swap, "grp").where("peer != out and peer != into").groupBy("grp").agg(F.count("*").alias("n_left"))
    need = peers.groupBy("grp").agg(F.expr("count_if(can_vote) div 2 + 1").alias("need"))
    return swap.join(need, "grp").join(left, "grp", "left").withColumn("n_left", F.coalesce("n_left", F.lit(0))).withColumn("is_safe", F.col("n_left") >= F.col("need")).select("grp", "n_left", "need", "is_safe")


def caught_up(peers: DataFrame, swap: DataFrame, gap: int = 2000) -> DataFrame:
    """Whether the new member's index is within ``gap`` of the old one's."""
    at = lambda name: peers.select("grp", F.col("peer").alias(name), F.col("idx").alias(f"{name}_idx"))
    both = swap.join(at("out"), ["grp", "out"]).join(at("into"), ["grp", "into"])
    return both.withColumn("is_caught_up", F.col("into_idx") + gap >= F.col("out_idx")).select("grp", "out", "into", "is_caught_up")


def members(events: DataFrame) -> DataFrame:
    """Membership after all events (grp, peer, seq, change: add, remove, learner, voter): grp, peer, role."""
    last = events.groupBy("grp", "peer").agg(F.max_by("change", "seq").alias("change"))
    return last.where("change != 'remove'").select("grp", "peer", F.when(F.col("change") == "learner", "learner").otherwise("voter").alias("role"))


#: Bytes of the numbers in front of a journal entry, in their order. Fixed values of the layout.
FIELDS = {"version": 4, "code": 4, "server_id": 4, "dsn": 8, "header_size": 4, "key_size": 4, "value_size": 4}


def encoded(entries: DataFrame) -> DataFrame:
    """Adds ``entry``: the numbers, header, key and value of a journal entry as one binary, numbers big-endian.

    The value is the packed block ids (``blkids``) where the data lie in blocks, linked, or the data themselves, inlined.
    entries: version, code, server_id, dsn, header, key, blkids, data.
    """
    number = lambda c, n: F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 2 * n, "0"))
    ids = F.unhex(F.array_join(F.transform("blkids", lambda b: F.lpad(F.hex(b), 16, "0")), ""))
    out = entries.withColumn("is_linked", F.size("blkids") > 0)
    out = out.withColumn("value", F.when(F.col("is_linked"), ids).otherwise(F.coalesce(F.col("data").cast("binary"), F.lit("").cast("binary"))))
    for name in ("header", "key", "value"):
        out = out.withColumn(f"{name}_size", F.octet_length(F.col(name)))
    numbers = [number(c, n) for c, n in FIELDS.items()]
    return out.withColumn("entry", F.concat(*numbers, F.col("header").cast("binary"), F.col("key").cast("binary"), "value")).drop("value", *(c for c in FIELDS if c.endswith("size")))


def decoded(entries: DataFrame) -> DataFrame:
    """``entry`` and is_linked read back: the numbers, header, key, blkids and data."""
    at, out = 1, entries
    for name, n in FIELDS.items():
        out = out.withColumn(name, F.conv(F.hex(F.substring("entry", at, n)), 16, 10).cast("long"))
        at += n
    part = lambda begin, size: F.substr(F.col("entry"), begin, size)
    value = part(F.lit(at) + F.col("header_size") + F.col("key_size"), F.col("value_size"))
    ids = F.transform(F.filter(F.sequence(F.lit(0), F.expr("value_size div 8")), lambda i: i < F.expr("value_size div 8")), lambda i: F.conv(F.hex(F.substr(F.col("value"), i * 8 + 1, F.lit(8))), 16, 10).cast("long"))
    out = out.withColumn("value", value).withColumn("header", part(F.lit(at), F.col("header_size")).cast("string")).withColumn("key", part(F.lit(at) + F.col("header_size"), F.col("key_size")).cast("string"))
    none = F.array().cast("array<long>")
    return out.withColumn("blkids", F.when(F.col("is_linked"), ids).otherwise(none)).withColumn("data", F.when(~F.col("is_linked"), F.col("value").cast("string"))).drop("value")


def group_status(peers: DataFrame, progress: DataFrame, own: int) -> DataFrame:
    """A row for each group as ``own`` sees it: leader, is_leader, n_peers, quorum, commit_lsn, append_lsn, stage, is_ready.

    ``progress``: grp, commit_lsn, append_lsn, destroyed. A member is ready for traffic when it has applied what it appended.
    """
    votes = peers.groupBy("grp").agg(F.count("*").alias("n_peers"), F.expr("count_if(can_vote) div 2 + 1").alias("quorum"))
    out = votes.join(expected_leader(peers), "grp").join(progress, "grp").withColumn("is_leader", F.col("leader") == own)
    stage = F.when(F.col("destroyed"), "DESTROYED").when(F.col("append_lsn") < 0, "INIT").otherwise("ACTIVE")
    ready = ~F.col("destroyed") & (F.col("commit_lsn") >= F.col("append_lsn"))
    return out.withColumn("stage", stage).withColumn("is_ready", ready).select("grp", "leader", "is_leader", "n_peers", "quorum", "commit_lsn", "append_lsn", "stage", "is_ready")


def group_capacity(members: DataFrame) -> DataFrame:
    """Per group: members, total and used capacity, and what is left where the fullest member decides. members: grp, peer, total, used."""
    return members.groupBy("grp").agg(F.count("*").alias("n_peers"), F.sum("total").alias("total"), F.sum("used").alias("used"), F.min(F.col("total") - F.col("used")).alias("room"))
