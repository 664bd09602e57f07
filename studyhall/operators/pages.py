"""Ordering and paging (SORT-01 .. SORT-05) and one-row combination of aggregates (JOIN-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pg_desc(c: str | Column) -> Column:
    """PostgreSQL ``DESC``: NULLs first."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def pg_asc(c: str | Column) -> Column:
    """PostgreSQL ``ASC``: NULLs last."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0,
         tiebreak: str | None = "id") -> DataFrame:
    """SORT-02: ``ORDER BY ... LIMIT n OFFSET m`` with a unique tiebreak so pages are stable.

    Spark plans this as ``TakeOrderedAndProject``: each task keeps its own top (offset+limit)
    rows and only those reach the final merge; the full table is never sorted globally.
    """
    keys = list(order) + ([F.col(tiebreak).asc()] if tiebreak else [])
    out = df.orderBy(*keys)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def page_of(page_no: int, limit: int) -> int:
    """page number (1-based) to offset."""
    return (max(page_no, 1) - 1) * limit


def one_row(spark: SparkSession, **scalars: DataFrame | Column) -> DataFrame:
    """JOIN-10: several one-row aggregates side by side as uncorrelated scalar subqueries.

    Each value is a single-column, single-row DataFrame (or a Column already built with
    ``.scalar()``). Spark merges scalar subqueries over the same source into one scan.
    No join is planned at all.
    """
    cols = []
    for name, v in scalars.items():
        col = v.scalar() if isinstance(v, DataFrame) else v
        cols.append(col.alias(name))
    return spark.range(1).select(*cols)
