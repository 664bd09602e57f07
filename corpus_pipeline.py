"""The corpus pipeline: five stages, each one operator of ``studyhall.llm``, applied to documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage gets it after it was
written as Parquet and read back. All but the last return the columns of documents.

1. ``toxicity``      drops the documents the fitted model calls toxic (score above 0.5).
2. ``near_dedup``    keeps one document of each class of near copies, the one with the smallest id.
3. ``pii``           replaces personal data in the texts by the kind in brackets; n_chars follows.
4. ``mix``           rakes token weights to the target marginals and samples by them.
5. ``pack``          packs the texts' tokens into sequences: one row per piece.

Defined results: empty tables pass through all stages; null texts are empty texts (toxicity keeps
them, all of them are one exact-copy class only if they have words, which they have not, so all stay);
the near-dedup compares rows, not ids: of rows repeated under one id, or without id, one of each class
stays (the smallest id, one with an id before one without), and rows of one id with different texts are
different documents; further columns of documents stay
with their rows, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyhall.llm import mixing, neardup, packing, pii, toxicity
from studyhall.llm.common import id_text, table, written
from studyhall.llm.queries import MIX_POWERS, tokenizer_path
from studyhall.session import ensure_checkpoint_dir

MIX_KEEP = 0.9  # expected share of the tokens that the sampled mixture has


def _boxed(docs: DataFrame) -> DataFrame:
    """Each row as one struct column ``row``, so that no column of ``docs`` can clash with another."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def _unboxed(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; labels of held-out rows are not learned from."""
    texts = id_text(docs)
    weights = toxicity.train(texts, toxicity.training_labels(table(spark, sf_dir, "labels")))
    clean = toxicity.clean_rows(docs, "text", weights)
    return clean.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: shingles of five words, similarity of at least 0.8."""
    keyed = written(_boxed(docs).withColumn("key", F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(keyed.select(F.col("key").alias("id"), F.col("row.text").cast("string").alias("text")),
                                    width=5, similarity=0.8)
    named = found.select(F.col("id").alias("key"), "component").join(keyed.select("key", "row.doc_id"), "key")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    rows = keyed.join(first.select(F.col("first.key").alias("key")), "key", "left_semi")
    return _unboxed(rows, docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in their texts."""
    model = pii.train(id_text(docs))
    return pii.redact_column(docs, "text", "n_chars", model)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled by their calibrated probabilities."""
    wide = _boxed(docs).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.lang").alias("lang"),
        mixing.text_topic(F.col("row.text")).alias("topic"), mixing.n_tokens(F.col("row.text")).alias("n_tokens"))
    out = mixing.mix(wide, dims=["source", "lang", "topic"], powers=MIX_POWERS, keep=MIX_KEEP)
    return _unboxed(out.filter("sampled"), docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return packing.pack(packing.tokenize(id_text(docs), tokenizer_path())).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

# The fitted models and the token ids cannot be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
