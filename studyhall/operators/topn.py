"""Top rows per group (SORT-04, JOIN-04) without funnelling a group into one task."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str],
                    prefix: str = "") -> DataFrame:
    """The smallest row by ``order`` per ``keys`` as a ``min(struct(order..., keep...))`` aggregate.

    ``LATERAL (... ORDER BY ... LIMIT 1)`` as an aggregate: Spark combines partial minimums on
    the map side, so a key with a third of all rows sends one row per task, not the rows.
    ``order`` columns must be non-NULL (ascending order, like the reference's filter implies).
    """
    fields = list(order) + [c for c in keep if c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in fields])).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(prefix + c) for c in fields])


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: list, k: int, rank_col: str = "position") -> DataFrame:
    """``row_number() <= k``: planned as WindowGroupLimit (partial top-k before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k) \
        .withColumn(rank_col, F.col(rank_col).cast("bigint"))


def is_first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "_is_first",
                      where: Column | None = None) -> DataFrame:
    """Flag the first row (by ``order``, which must tell rows apart) of each ``keys`` group.

    A ``min(struct)`` aggregate (combined map-side) joined back null-safe, whatever the sizes, so no
    task holds a group. With ``where`` only its rows take part; the others are flagged False and are
    spread over the join's partitions instead of meeting under one (often NULL) key.
    """
    part = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    df = df.withColumn("_part", part)
    first = df.filter("_part").groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.min(F.struct(*[F.col(c) for c in order])).alias("_first")).withColumn("_at", F.lit(0).cast("bigint"))
    df = df.withColumn("_to", F.when(F.col("_part"), F.lit(0)).otherwise(
        F.xxhash64(*order).bitwiseOR(F.lit(1))).cast("bigint"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_to") == F.col("_at"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_first.{c}")) for c in order])
    return (df.join(first, on, "left").withColumn(out, F.col("_part") & F.col("_first").isNotNull() & same)
            .drop("_first", "_at", "_to", "_part", *[f"_k_{k}" for k in keys]))


def earliest_ok(d: DataFrame, keys: Sequence[str], dup_code: str, order: Sequence[str] = ("requested_at", "request_id"),
                ) -> DataFrame:
    """Settle a batch of decisions: among OK rows only the earliest request per key stays OK; the later
    ones, which would have found its row, get ``dup_code``."""
    ok = F.col("decision") == "OK"
    d = is_first_in_group(d, keys, order, where=ok)
    return d.withColumn("decision", F.when(ok & ~F.col("_is_first"), F.lit(dup_code))
                        .otherwise(F.col("decision"))).drop("_is_first")
