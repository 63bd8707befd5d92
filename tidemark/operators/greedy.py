"""Order-dependent folds that no window frame expresses: sums that start anew, and first fit.

Rows are dealt by group and sorted by Spark; each task streams its sorted rows and keeps a few numbers for
the group at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def folded(rows: DataFrame, by: list[str], order: str, size: str, limit: int, reset_at: bool) -> DataFrame:
    """Adds ``bucket`` and ``offset`` (the sum before the row in its bucket).

    ``reset_at``: a bucket ends with the row that reaches the limit; otherwise before the row that would pass it.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("offset", T.LongType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A step for each bucket, not for each row: where it ends is found in the prefix sums."""
        group, bucket, total = None, 0, 0  # the group at hand, its bucket, and what the bucket holds so far
        for pdf in parts:
            sums = np.concatenate(([0], np.cumsum(pdf[size].to_numpy(np.int64))))
            buckets, offsets = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            new = (pdf[by] != pdf[by].shift()).any(axis=1).to_numpy() if len(pdf) else np.zeros(0, bool)
            heads = np.flatnonzero(new).tolist()
            for a, b in zip(heads, [*heads[1:], len(pdf)]):
                key = tuple(pdf[by].iloc[a])
                if key != group:
                    group, bucket, total = key, 0, 0
                while a < b:
                    # The bucket takes rows up to ``to``; it takes one at least, unless it holds some and the next doesn't fit.
                    if reset_at:
                        to = min(b, int(np.searchsorted(sums, sums[a] + limit - total, side="left")))
                        to = max(to, a + 1)
                    else:
                        to = min(b, int(np.searchsorted(sums, sums[a] + limit - total, side="right")) - 1)
                        to = max(to, a if total else a + 1)
                    buckets[a:to], offsets[a:to] = bucket, total + sums[a:to] - sums[a]
                    total += int(sums[to] - sums[a])
                    if total >= limit if reset_at else to < b:
                        bucket, total = bucket + 1, 0
                    a = to
            yield pdf.assign(bucket=buckets, offset=offsets)

    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInPandas(run, schema)


class Room:
    """Free extents in order; the first that has ``need`` blocks left is found from maxima over halves."""

    def __init__(self, sizes: list[int]) -> None:
        self.n = 1 << max(0, len(sizes) - 1).bit_length()
        self.most = [0] * self.n + sizes + [0] * (self.n - len(sizes))
        for i in range(self.n - 1, 0, -1):
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def first(self, need: int) -> int | None:
        if self.most[1] < need:
            return None
        i = 1
        while i < self.n:
            i = 2 * i if self.most[2 * i] >= need else 2 * i + 1
        return i - self.n

    def take(self, at: int, n: int) -> None:
        i = at + self.n
        self.most[i] -= n
        while i > 1:
            i //= 2
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])


def first_fit(requests: DataFrame, free: DataFrame, pieces: int = 6) -> DataFrame:
    """Serve block requests (chunk, seq, nblks) from free extents (chunk, blk_num, free_blks), in order of seq.

    A request is placed in the first extent that holds it whole; else in up to ``pieces`` extents from the
    front; else it gets none. Adds piece, blk_num and count; a request without room has one row of nulls.
    A chunk is the unit of allocation: its extents and requests are worked off together.
    """
    schema = "chunk int, seq long, nblks long, piece int, blk_num long, count long"

    def run(key: tuple, asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        have = have.sort_values("blk_num")
        begin, room = have["blk_num"].tolist(), Room(have["free_blks"].tolist())
        out = []
        for seq, need in asks.sort_values("seq")[["seq", "nblks"]].itertuples(index=False, name=None):
            whole = room.first(need)
            taken, left = [], need
            while left and len(taken) < (pieces if whole is None else 1):
                at = room.first(1) if whole is None else whole
                if at is None:
                    break
                n = min(left, room.most[at + room.n])
                taken.append((at, n))
                room.take(at, n)
                left -= n
            if left:
                for at, n in taken:
                    room.take(at, -n)
                out.append((key[0], seq, need, None, None, None))
                continue
            for k, (at, n) in enumerate(taken):
                out.append((key[0], seq, need, k, begin[at], n))
                begin[at] += n
        return pd.DataFrame(out, columns=["chunk", "seq", "nblks", "piece", "blk_num", "count"]).astype({"piece": "Int32", "blk_num": "Int64", "count": "Int64"})

    return requests.groupBy("chunk").cogroup(free.groupBy("chunk")).applyInPandas(run, schema)
