"""Skew-safe running aggregates within a key (distributed prefix sum).

A plain ``sum(...).over(Window.partitionBy(key).orderBy(...))`` sends every row of a key to
one task; when one user owns a third of the ledger that task holds a third of the data.
Here the rows are always range-partitioned on ``(key, order...)`` so a hot key is split over many
partitions (Spark samples the key distribution to pick the bounds). Then:

1. running value inside each (key, chunk) piece — a window over a bounded piece;
2. one total per (key, chunk) — at most ``#keys + #partitions`` rows;
3. prefix over those totals per key — a hot key has at most ``#partitions`` chunks;
4. add the offset of the preceding chunks back by a null-safe equi-join on (key, chunk).

The chunk id comes from the range exchange, so the tagged rows are stored once in the shared folder; the
pieces (1) and totals (2) then read the same copy and always agree, also after a lost executor.
There is one path for every size. Rows with a NULL key are one group like any other.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyhall.session import stored

CHUNK = "_chunk"


# How values of one kind are folded in a chunk, and a chunk's value with what came before it.
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _merged(kind: str, inside: Column, before: Column) -> Column:
    if kind == "sum":
        return F.coalesce(inside, F.lit(0)) + F.coalesce(before, F.lit(0))
    return F.greatest(inside, before) if kind == "max" else F.least(inside, before)


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n_chunks: int | None = None) -> DataFrame:
    """``df`` range-partitioned on (keys, order) with its partition as column CHUNK, stored: the chunk id
    depends on where the range exchange put a row, so every pass over it must read the same copy."""
    n = n_chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn(CHUNK, F.spark_partition_id()))


def running(tagged: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
            values: dict[str, tuple[str, Column | str]], exclusive: bool = False) -> DataFrame:
    """Add running folds within ``keys`` to a frame of ``in_chunks`` (same keys and order): ``values`` maps an output
    column to (sum | max | min, value). ``exclusive`` folds the rows strictly before (sum 0, else NULL, for the first)."""
    keys = list(keys)
    frame_end = -1 if exclusive else Window.currentRow
    w_in = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    w_off = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    val = {out: F.col(v) if isinstance(v, str) else v for out, (_, v) in values.items()}
    inside = tagged.select("*", *[_FOLD[kind](val[out]).over(w_in).alias(f"_in_{out}") for out, (kind, _) in values.items()])
    totals = tagged.groupBy(*keys, CHUNK).agg(*[_FOLD[kind](val[out]).alias(f"_ct_{out}")
                                                for out, (kind, _) in values.items()])
    offsets = totals.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col(CHUNK).alias(f"_o_{CHUNK}"),
                            *[_FOLD[kind](f"_ct_{out}").over(w_off).alias(f"_off_{out}")
                              for out, (kind, _) in values.items()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys + [CHUNK]])
    return inside.join(offsets, same).select(
        *tagged.columns, *[_merged(kind, F.col(f"_in_{out}"), F.col(f"_off_{out}")).alias(out)
                           for out, (kind, _) in values.items()])


def running_sum(df: DataFrame, key: str | Sequence[str], order: Sequence[str], value: Column | str,
                out: str, n_chunks: int | None = None, exclusive: bool = False) -> DataFrame:
    """Add column ``out`` = running sum of ``value`` within ``key`` in ``order`` (keep order unique).

    ``exclusive=True`` gives the sum of the rows strictly before (0 for the first row).
    ``n_chunks`` defaults to the session's shuffle partitions.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return running(in_chunks(df, keys, order, n_chunks), keys, order, {out: ("sum", value)}, exclusive).drop(CHUNK)


def running_count(df: DataFrame, key: str | Sequence[str], order: Sequence[str], out: str,
                  n_chunks: int | None = None) -> DataFrame:
    """``row_number()`` within ``key`` in ``order`` without funnelling a hot key into one task."""
    return running_sum(df, key, order, F.lit(1).cast("bigint"), out, n_chunks)
