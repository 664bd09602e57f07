"""JOIN-07: half-open interval overlap ``[a_start, a_end) && [b_start, b_end)`` within a key.

Joining on the key alone and testing the ranges afterwards compares every interval of a key
with every other one; a teacher with a third of all sessions would make that quadratic.
Instead intervals are listed in time buckets of a ladder of lengths: an interval belongs to the
lowest level whose bucket is at least as long as itself, so it touches at most two buckets there. Of a
pair, the one of the lower level is also listed at the other's level: the left side lists itself at
its own level and those above it that occur on the right, the right side at its own (and the mirror image, for
pairs whose right interval is the shorter one). The join key is (key, level, bucket) and the range test its residual. No
interval is cut into many buckets, none is compared by key alone, and there is no switch by size.
A pair that shares two buckets is kept once: in the bucket of ``max(a_start, b_start)``.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 4      # 4 h, 10 days, 2 years, 120 years with the default first bucket
STEP = 64       # each level's buckets are this much longer than the ones below


def _epoch_s(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def bucket_lists(start: str, end: str, bucket_s: int, *, own: str | None, above: str | None,
                 own_at: Sequence[int] = range(LEVELS), above_at: Sequence[int] = range(LEVELS)) -> Column:
    """Array of (role, level, bucket): role ``own`` at the interval's level, ``above`` at higher ones, each only at the
    levels of ``own_at`` and ``above_at`` (None: not at all)."""
    s, e = _epoch_s(F.col(start)), _epoch_s(F.col(end))
    last = F.greatest(e, s + 1) - 1
    entries = [F.lit(None).cast("array<struct<role:string,level:int,bucket:bigint>>")]
    for level in range(LEVELS):
        size = bucket_s * STEP ** level
        fits = (e - s <= size) if level < LEVELS - 1 else F.lit(True)
        lower = (e - s <= size // STEP) if level else F.lit(False)
        buckets = F.sequence(F.floor(s / size), F.floor(last / size))
        def at(role: str, when: Column, level=level, buckets=buckets) -> Column:
            return F.when(when, F.transform(buckets, lambda b: F.struct(
                F.lit(role).alias("role"), F.lit(level).alias("level"), b.alias("bucket"))))
        entries += [at(own, fits & ~lower)] if own and level in own_at else []
        entries += [at(above, lower)] if above and level and level in above_at else []
    return F.flatten(F.filter(F.array(*entries), lambda x: x.isNotNull()))


def levels_of(df: DataFrame, start: str, end: str, bucket_s: int) -> list[int]:
    """The levels that intervals of ``df`` have (LEVELS at most)."""
    length = _epoch_s(F.col(end)) - _epoch_s(F.col(start))
    level = sum((F.when(length > bucket_s * STEP ** i, 1).otherwise(0) for i in range(LEVELS - 1)), F.lit(0))
    return sorted(r.level for r in df.select(level.alias("level")).distinct().collect() if r.level is not None)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], *,
                 left_start: str, left_end: str, right_start: str, right_end: str,
                 bucket_minutes: int = 240) -> DataFrame:
    """Pairs whose intervals overlap (half-open: touching intervals do not), equal on ``keys``.

    ``keys`` are (left column, right column) pairs; column names of the two sides must differ.
    Empty intervals and those with a NULL end overlap nothing. ``bucket_minutes``, the first level's
    length, should be near the longest common interval.
    """
    b = bucket_minutes * 60
    left = left.filter(F.col(left_start) < F.col(left_end))
    right = right.filter(F.col(right_start) < F.col(right_end))
    # Role "l": the left interval is of the lower or the same level; role "r": the right one is lower. An interval is listed
    # in a role only at levels where the other side has intervals that it can meet in that role.
    on_left, on_right = (levels_of(df, s, e, b) for df, s, e in ((left, left_start, left_end), (right, right_start, right_end)))
    under = [x for x in on_left if any(y < x for y in on_right)]
    ls = F.concat(bucket_lists(left_start, left_end, b, own="l", above="l", own_at=on_right, above_at=on_right),
                  bucket_lists(left_start, left_end, b, own="r", above=None, own_at=under))
    met = [x for x in range(LEVELS) if any(y <= x for y in on_left)]
    rs = bucket_lists(right_start, right_end, b, own="l", above="r", own_at=met, above_at=on_left)
    lb = left.withColumn("_l", F.explode(ls)).select(*left.columns, F.col("_l.role").alias("_lrole"),
                                                     F.col("_l.level").alias("_llevel"), F.col("_l.bucket").alias("_lb"))
    rb = right.withColumn("_r", F.explode(rs)).select(*right.columns, F.col("_r.role").alias("_rrole"),
                                                      F.col("_r.level").alias("_rlevel"), F.col("_r.bucket").alias("_rb"))
    same = [F.col("_lb") == F.col("_rb"), F.col("_llevel") == F.col("_rlevel"), F.col("_lrole") == F.col("_rrole"),
            *[F.col(lk) == F.col(rk) for lk, rk in keys]]
    overlap = (F.col(left_start) < F.col(right_end)) & (F.col(right_start) < F.col(left_end))
    size = F.element_at(F.array(*[F.lit(b * STEP ** i) for i in range(LEVELS)]), F.col("_llevel") + 1)
    owner = F.floor(_epoch_s(F.greatest(F.col(left_start), F.col(right_start))) / size) == F.col("_lb")
    return lb.join(rb, reduce(lambda x, y: x & y, same) & overlap & owner).select(*left.columns, *right.columns)
