"""Stored domain tables: fixed schemas, loading, relational source, views, payloads, sinks
(SRC-01 .. SRC-05, SNK-01 .. SNK-03, the SQL surface of 2.15)."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyhall.constants import CREDIT_SPENDABLE, DEBIT_TYPES

_S, _L, _I, _B, _D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
_TS = T.TimestampNTZType()
_MONEY, _RATING = T.DecimalType(10, 2), T.DecimalType(2, 1)
_ARR = T.ArrayType(T.StringType())


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Keys are longs here (the test data); every operator treats them as opaque and works with
# string keys (UUID text) unchanged.
SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(("id", _L), ("name", _S), ("email", _S), ("phone", _S), ("role", _S), ("lat", _D), ("lng", _D),
                     ("avatar_url", _S), ("is_active", _B), ("is_verified", _B), ("last_login_at", _TS),
                     ("created_at", _TS), ("updated_at", _TS)),
    "teachers": _schema(("id", _L), ("user_id", _L), ("bio", _S), ("subjects", _ARR), ("grade_levels", _ARR),
                        ("rating", _RATING), ("total_reviews", _I), ("total_sessions", _I), ("total_students", _I),
                        ("is_verified", _B), ("created_at", _TS)),
    "centers": _schema(("id", _L), ("owner_id", _L), ("name", _S), ("address", _S), ("lat", _D), ("lng", _D),
                       ("description", _S), ("phone", _S), ("logo_url", _S), ("rating", _RATING),
                       ("total_reviews", _I), ("is_active", _B), ("created_at", _TS)),
    "center_teachers": _schema(("center_id", _L), ("teacher_id", _L), ("is_active", _B), ("joined_at", _TS),
                               ("left_at", _TS)),
    "sessions": _schema(("id", _L), ("center_id", _L), ("teacher_id", _L), ("subject", _S), ("grade_level", _S),
                        ("title", _S), ("scheduled_at", _TS), ("duration_min", _I), ("capacity", _I),
                        ("seats_booked", _I), ("price", _MONEY), ("status", _S), ("notes", _S), ("created_at", _TS),
                        ("updated_at", _TS)),
    "bookings": _schema(("id", _L), ("session_id", _L), ("student_id", _L), ("status", _S), ("qr_code", _S),
                        ("amount_paid", _MONEY), ("booked_at", _TS), ("cancelled_at", _TS), ("updated_at", _TS)),
    "attendances": _schema(("id", _L), ("booking_id", _L), ("scanned_at", _TS), ("scanned_by", _L)),
    "rooms": _schema(("id", _L), ("center_id", _L), ("teacher_id", _L), ("name", _S), ("description", _S),
                     ("access_code", _S), ("subject", _S), ("grade_level", _S), ("paid_price", _MONEY),
                     ("is_active", _B), ("member_count", _I), ("content_count", _I), ("created_at", _TS),
                     ("updated_at", _TS)),
    "room_members": _schema(("id", _L), ("room_id", _L), ("student_id", _L), ("access_tier", _S), ("joined_at", _TS),
                            ("expires_at", _TS), ("is_active", _B)),
    "teacher_content": _schema(("id", _L), ("teacher_id", _L), ("center_id", _L), ("type", _S), ("title", _S),
                               ("description", _S), ("url", _S), ("is_free", _B), ("is_active", _B),
                               ("sort_order", _I), ("created_at", _TS), ("updated_at", _TS)),
    "content_items": _schema(("id", _L), ("room_id", _L), ("teacher_content_id", _L), ("type", _S), ("title", _S),
                             ("description", _S), ("url", _S), ("thumbnail_url", _S), ("is_free", _B),
                             ("sort_order", _I), ("duration_seconds", _I), ("view_count", _I), ("is_active", _B),
                             ("created_at", _TS)),
    "wallet_transactions": _schema(("id", _L), ("user_id", _L), ("amount", _MONEY), ("type", _S), ("status", _S),
                                   ("reference_id", _L), ("reference_type", _S), ("payment_method", _S),
                                   ("description", _S), ("metadata", _S), ("created_at", _TS),
                                   ("completed_at", _TS)),
    "reviews": _schema(("id", _L), ("teacher_id", _L), ("student_id", _L), ("booking_id", _L), ("rating", _I),
                       ("comment", _S), ("is_visible", _B), ("created_at", _TS)),
    "audit_logs": _schema(("id", _L), ("admin_id", _L), ("action", _S), ("entity_type", _S), ("entity_id", _L),
                          ("details", _S), ("ip_address", _S), ("created_at", _TS)),
    "notifications": _schema(("id", _L), ("user_id", _L), ("type", _S), ("title", _S), ("message", _S),
                             ("is_read", _B), ("created_at", _TS)),
}

# Fact tables written partitioned by calendar month of their time column. The partition
# column is named ``<time column>_month`` (yyyy-MM, UTC), so an operator that filters the time
# column can add the matching month predicate (``functions.exprs.prune_months``).
MONTH_PARTITIONED = {"sessions": "scheduled_at", "bookings": "booked_at", "wallet_transactions": "created_at",
                     "audit_logs": "created_at", "notifications": "created_at"}


def month_column(table: str) -> str | None:
    col = MONTH_PARTITIONED.get(table)
    return f"{col}_month" if col else None


class Tables(dict):
    """Mapping table name -> DataFrame (the ``t`` every operator takes)."""


# ------------------------------------------------------------------ SRC-01
def load_tables(spark: SparkSession, path: str, names=None) -> Tables:
    """Read stored domain tables with their fixed schemas (no inference, no footer merging).

    Month-partitioned tables carry an extra ``<time column>_month`` column used for pruning.
    """
    t = Tables()
    for name in names or SCHEMAS:
        schema = SCHEMAS[name]
        if name in MONTH_PARTITIONED:
            schema = T.StructType(schema.fields + [T.StructField(month_column(name), T.StringType(), True)])
        t[name] = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}")
    return t


def month_of(c: Column | str) -> Column:
    """Partition value ``yyyy-MM`` of a timestamp (UTC)."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM")


def read_snapshot(spark: SparkSession, path: str, table: str, schema: T.StructType) -> DataFrame:
    """A table of ``schema`` written by ``write_snapshot``; the month of a fact is text (``yyyy-MM``)."""
    if table in MONTH_PARTITIONED:
        schema = T.StructType(schema.fields + [T.StructField(month_column(table), T.StringType(), True)])
    return spark.read.schema(schema).parquet(path)


# ------------------------------------------------------------------ SNK-01 / SNK-02
def append(df: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """SNK-01: append rows (``INSERT ... RETURNING``): month-partitioned when the table is a fact
    table; returns the appended rows as written."""
    if table in MONTH_PARTITIONED:
        mc = month_column(table)
        df.withColumn(mc, month_of(MONTH_PARTITIONED[table])).write.mode("append").partitionBy(mc).parquet(path)
    else:
        df.write.mode("append").parquet(path)
    return df


def cluster_by_month(df: DataFrame, at: Column | str) -> DataFrame:
    """``df`` rebalanced by the month of ``at``: small months go to one task together, a large one is split over many by its
    measured size."""
    return df.withColumn("_month", month_of(at)).hint("rebalance", F.col("_month")).drop("_month")


def write_snapshot(df: DataFrame, path: str, table: str | None = None, *, clustered: bool = False) -> str:
    """SNK-02: write a new snapshot of a table (the result of a merge by join) to a fresh folder.

    Readers switch to the new folder after the write succeeded; the old snapshot stays intact
    until then, so a failed job never leaves a half-updated table. Rows are rebalanced by month (``cluster_by_month``)
    unless they are ``clustered`` so already.
    """
    if table in MONTH_PARTITIONED:
        mc = month_column(table)
        rows = df if clustered else cluster_by_month(df, MONTH_PARTITIONED[table])
        rows.withColumn(mc, month_of(MONTH_PARTITIONED[table])).write.mode("overwrite").partitionBy(mc).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def materialize(t: Mapping[str, DataFrame], path: str) -> str:
    """Write every table of ``t`` as a snapshot below ``path`` (month-partitioned facts)."""
    for name in t.keys():
        write_snapshot(t[name], f"{path.rstrip('/')}/{name}", name)
    return path


# ------------------------------------------------------------------ SNK-03
def to_json_documents(df: DataFrame, col: str = "document") -> DataFrame:
    """SNK-03: one JSON text per row, NULL fields kept (the reference's JSON keeps them)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(col))


# ------------------------------------------------------------------ SRC-02
def load_jdbc(spark: SparkSession, url: str, table: str, partition_col: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int = 64, properties: dict | None = None) -> DataFrame:
    """SRC-02: read a table of a relational database in parallel ranges of ``partition_col``.

    Needs the database's JDBC driver on the classpath; no database is used in tests.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_col is not None:
        r = (r.option("partitionColumn", partition_col).option("lowerBound", lower).option("upperBound", upper)
             .option("numPartitions", num_partitions))
    return r.load()


# ------------------------------------------------------------------ SRC-04
def rows_from_array(df: DataFrame, array_col: str, keep: list[str] | None = None, pos: str = "pos",
                    item: str = "item") -> DataFrame:
    """SRC-04: an array column of a request (``= ANY($1)``, a JSON array body) as rows, with position."""
    return df.select(*(keep or []), F.posexplode(array_col).alias(pos, item))


# ------------------------------------------------------------------ SRC-05
def parse_json_column(df: DataFrame, col: str, schema: T.DataType | str | None = None, out: str | None = None
                      ) -> DataFrame:
    """SRC-05: JSON text column to a typed column (``from_json`` with a schema) or to VARIANT."""
    parsed = F.from_json(F.col(col), schema) if schema is not None else F.parse_json(F.col(col))
    return df.withColumn(out or f"{col}_parsed", parsed)


# ------------------------------------------------------------------ SRC-03 and 2.15
def register_views(spark: SparkSession, t: Mapping[str, DataFrame], as_of: str) -> list[str]:
    """SRC-03: the domain tables and the three declared views as temporary views, plus the
    SQL function ``get_wallet_balance(user_id)`` of the schema (spendable balance)."""
    from studyhall.plans.center import center_analytics, student_bookings_summary
    from studyhall.plans.discovery import teacher_discovery

    names = []
    for name in (t.keys() if hasattr(t, "keys") else []):
        t[name].createOrReplaceTempView(name)
        names.append(name)
    teacher_discovery(t, as_of=as_of).createOrReplaceTempView("teacher_discovery")
    center_analytics(t).createOrReplaceTempView("center_analytics")
    student_bookings_summary(t).createOrReplaceTempView("student_bookings_summary")
    names += ["teacher_discovery", "center_analytics", "student_bookings_summary"]
    credit = ", ".join(f"'{c}'" for c in CREDIT_SPENDABLE)
    debit = ", ".join(f"'{c}'" for c in DEBIT_TYPES)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION get_wallet_balance(p_user_id BIGINT) RETURNS DECIMAL(20,2)
        RETURN SELECT CAST(COALESCE(SUM(CASE
                   WHEN type IN ({credit}) AND status = 'completed' THEN amount
                   WHEN type IN ({debit}) AND status = 'completed' THEN -amount
                   ELSE 0 END), 0) AS DECIMAL(20,2))
               FROM wallet_transactions WHERE user_id = p_user_id""")
    return names
