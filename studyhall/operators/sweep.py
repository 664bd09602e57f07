"""Earliest overlap per interval without building the pairs (JOB-06).

For an interval ``[s, e)`` the earliest one of its key (by start, then id) that overlaps it is wanted, not all of them. In
the order of starts, the running maximum of the ends first exceeds ``s`` at the earliest interval that ends after ``s``; the
two overlap if and only if that one also starts before ``e``: all earlier ones have ended, all later ones start later. So

1. the intervals are swept once in order of their starts, keeping the running maximum of the ends, and leave one record
   where it grows;
2. records and questions are swept once in descending order of end and ``s``; the least record so far answers a question.

If a question may not be answered by one certain interval (the session it would replace), the second one that ends after ``s`` is
needed as well: it stands where the running maximum of the *losers* (the smaller of an end and the maximum before it) grows.

Both sweeps are range-partitioned prefix folds (``operators.prefix``): rows in and out are linear in the input, and a
key with all rows is spread over all tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.operators.prefix import in_chunks, running


def earliest_overlap(asked: DataFrame, intervals: DataFrame, keys: Sequence[str], *, start: str, end: str, ident: str,
                     own: str) -> DataFrame:
    """``asked`` with ``hit`` = struct(start, ident) of the earliest interval of the same ``keys`` that overlaps, or NULL.

    Both frames have the columns ``keys``, ``start``, ``end``; ``intervals`` has ``ident`` (unique within a key), ``asked`` has
    ``own``: the ident that may not answer (NULL: any may). Half-open: touching intervals do not overlap. Rows with NULL
    in a key, start or end, and empty intervals, overlap nothing.
    """
    keys = list(keys)
    whole = F.col(start) < F.col(end)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    order = [F.col(start), F.col(ident)]
    rows = in_chunks(intervals.select(*keys, start, end, ident).filter(whole), keys, order)
    rows = running(rows, keys, order, {"_before": ("max", end)}, exclusive=True)
    loser = F.when(F.col("_before").isNotNull(), F.least(F.col(end), F.col("_before")))
    rows = running(rows.withColumn("_loser", loser), keys, order, {"_second": ("max", "_loser")}, exclusive=True)
    at = F.struct(F.col(start), F.col(ident))
    grows = [F.when(F.col("_before").isNull() | (F.col(end) > F.col("_before")),
                    F.struct(F.col(end).alias("at"), F.lit(1).alias("kind"))),
             F.when(F.col("_loser").isNotNull() & (F.col("_second").isNull() | (F.col("_loser") > F.col("_second"))),
                    F.struct(F.col("_loser").alias("at"), F.lit(2).alias("kind")))]
    records = rows.select(*keys, at.alias("_at"), F.explode(F.filter(F.array(*grows), lambda x: x.isNotNull())).alias("_r"))
    records = records.select(*keys, F.col("_r.at").alias("_value"), F.col("_r.kind").alias("_kind"), "_at")
    asked = asked.withColumn("_asks", F.coalesce(whole, F.lit(False)))
    idle = asked.filter(~F.col("_asks")).drop("_asks").withColumn("hit", F.lit(None).cast(records.schema["_at"].dataType))
    boxed = asked.filter("_asks").drop("_asks")
    names = boxed.columns
    questions = boxed.select(*keys, F.col(start).alias("_value"), F.lit(0).alias("_kind"), F.struct(*names).alias("_row"))
    # At equal values questions come first: an interval that ends where another starts does not overlap it.
    down = [F.desc("_value"), F.asc("_kind"), F.asc("_at")]
    both = in_chunks(records.unionByName(questions, allowMissingColumns=True), keys, down)
    both = running(both, keys, down, {
        "_first": ("min", F.when(F.col("_kind") == 1, F.col("_at"))),
        "_next": ("min", F.when(F.col("_kind") == 2, F.col("_at")))})
    mine = F.coalesce(F.col(f"_first.{ident}") == F.col(f"_row.{own}"), F.lit(False))
    told = both.filter("_kind = 0").withColumn("_hit", F.when(mine, F.col("_next")).otherwise(F.col("_first")))
    hit = F.when(F.col(f"_hit.{start}") < F.col(f"_row.{end}"), F.col("_hit"))
    return told.select("_row.*", hit.alias("hit")).unionByName(idle)
