"""Read the driver's parquet tables (the TPC-H-like inputs the domain tables derive from)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan: Catalyst prunes columns and pushes filters into it."""
    if name not in DRIVER_TABLES:
        raise KeyError(f"unknown driver table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
