"""What the operators share: intermediate tables in the cluster's shared folder, column hygiene."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyhall.session import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage: a lost executor costs at most the tasks that were running, never a rerun of
    what is already on the shared disk.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict = {}


def worker_state(owner: str) -> dict:
    """What a Python worker keeps between tasks of the operator ``owner``; a task of another operator in the
    same worker frees it, so that the stages of a pipeline do not add up in a worker's memory."""
    if _kept.get("owner") != owner:
        _kept.clear()
        _kept.update(owner=owner, state={})
    return _kept["state"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under names of its own (``id`` long, ``text`` string,
    null text read as empty), so that further columns of the caller can never clash."""
    return docs.select(docs[id_col].cast("long").alias("id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def spread(df: DataFrame, *cols: Column | str) -> DataFrame:
    """Deal rows out anew over the session's shuffle partitions (hot inputs sit in few files)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols) if cols else df.repartition(n)
