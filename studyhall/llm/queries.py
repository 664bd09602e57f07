"""The registered queries of this subpackage: each applies its operator to whole tables and derives
the digest columns from the operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyhall.llm import (audit, chat, fingerprint, langid, lm, mixing, neardup, packing, phrases, pii, quality, toxicity,
                           vectors)
from studyhall.llm.common import id_text, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    out = chat.format_chats(chat.turn_events(rows.unionByName(probe)))
    out = out.withColumn("turn", chat.read_back(F.col("formatted"), F.col("turns")))
    told = F.array_join(F.transform("turn", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turn", lambda x: x["trained"]), lambda x: x["text"]), "")
    return out.select("conv_id", F.size("turn").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT conv_id, turn, role, text,
         length('### ' || replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '#', '%23'), '<', '%3C') || ': '
                || replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') || '</turn>' || chr(10)) AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    weights = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, weights).select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    """The public vocabulary file, installed with the library on every machine."""
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(id_text(table(spark, sf_dir, "documents")), tokenizer_path())
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(id_text(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


MIX_POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
MIX_KEEP = 0.6


def op5_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", mixing.text_topic(F.col("text")).alias("topic"),
        mixing.n_tokens(F.col("text")).alias("n_tokens"))
    out = mixing.mix(docs, dims=["source", "lang", "topic"], powers=MIX_POWERS, keep=MIX_KEEP)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"),
                      F.round("probability", 6).alias("probability"), "sampled")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(id_text(table(spark, sf_dir, "documents")), width=4, similarity=0.8)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"),
                                                     F.col("embedding").alias("vec"))
    return vectors.near_vectors(rows, cosine=0.95).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    found = pii.find(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(told(base), 256).alias("base_sha256"),
                        told(F.col("spans")).alias("spans"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints(id_text(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
                        fingerprint.as_string(F.col("sketch")).alias("fingerprint"),
                        fingerprint.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
                        F.col("near_edited").cast("double").alias("near_edited"),
                        F.col("near_next").cast("double").alias("near_next"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), "url", "html")
    found = langid.identify(pages, table(spark, sf_dir, "documents").select("text", "lang"))
    return found.withColumnRenamed("id", "page_id")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    model = quality.train(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["lang"], F.lit("")).alias("part"),
                       F.coalesce(docs["text"], F.lit("")).alias("text"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic")
    return audit.audit(docs, labels)


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_chat_formatting": (op1_chat_formatting, OP1_SQL),
    "op2_toxicity": (op2_toxicity, None),
    "op3_best_fit_packing": (op3_best_fit_packing, None),
    "op4_lm_scoring": (op4_lm_scoring, None),
    "op5_mix_to_targets": (op5_mix_to_targets, mixing.oracle_sql(MIX_POWERS, MIX_KEEP)),
    "op6_minhash_near_dedup": (op6_minhash_near_dedup, None),
    "op7_embedding_near_dedup": (op7_embedding_near_dedup, None),
    "op8_pii": (op8_pii, None),
    "op9_document_fingerprints": (op9_document_fingerprints, None),
    "op10_language_id": (op10_language_id, None),
    "op11_quality_classifier": (op11_quality_classifier, None),
    "op12_filter_audit": (op12_filter_audit, audit.ORACLE_SQL),
    "op13_phrase_mining": (op13_phrase_mining, phrases.ORACLE_SQL),
}


def queries() -> dict:
    return {k: fn for k, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql is not None}
