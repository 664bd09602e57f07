"""Filter interaction audit: what five filters remove in every order, from one Gray-code walk over their subsets.

1. Every text gets the mask of the filters it fails: A under 200 words, B 100 * distinct words below 50 * words,
   C more than 3 % capitals A-Z, D one of ``#$%&*|``, E identical to the text of a smaller id anywhere in the table.
2. Rows are counted by (part, mask): at most 32 cells a part, aggregated before every shuffle.
3. Per part one walk over the 32 subsets of filters in Gray-code order switches one filter a step. Each cell keeps the
   number of active filters it fails; a cell whose number leaves or reaches zero leaves or joins the running survivors.
   The survivors of each subset are stored, and all 120 orders with 5 steps are differences of two of the 32 states.

Filter E needs no row of a group of copies to meet the others: rows are counted by (digest of the text, part, labels),
the smallest id is kept with its count, and only these counts meet. Rows that are repeated under one id count each time
and none is smaller than the other.

Defined results: a null text is empty, a null language is the part ''; a row without id has no smaller id, is none
itself and has no labels; an id labelled twice has a label if one of its rows says so; texts of any length are read
whole; an empty table gives no row; further columns of the tables are never read. The result has 600 rows a part, so
parts are taken to be few (one group of copies may meet once per part).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_COPY = 1 << FILTERS.index("E")


def text_mask(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # bytes: space and 0x09-0x0D
    return (int(len(words) < 200) | int(100 * len(set(words)) < 50 * len(words)) << 1
            | int(100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * n_chars) << 2
            | int(len(text.translate(None, _SYMBOLS)) < len(text)) << 3)


def masks(docs: DataFrame) -> DataFrame:
    """(id, part, mask, digest) per row of (id, part, text); mask has the bits A to D."""
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            chars = pc.utf8_length(b.column(2)).to_pylist()
            texts = [t.as_py() for t in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([text_mask(t, n) for t, n in zip(texts, chars)], pa.int32()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                names=["id", "part", "mask", "digest"])
    return docs.select("id", "part", "text").mapInArrow(run, "id long, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) from docs (id, part, text) and labels (id, quality, toxic)."""
    told = labels.filter("id is not null").groupBy("id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    # Rows without id go to join keys of their own (side > 0), which no label has.
    side = F.when(F.col("id").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(F.lit(0))
    rows = masks(docs).withColumn("side", side.cast("int")).withColumn("key", F.coalesce("id", F.lit(0)))
    told = told.withColumnRenamed("id", "key").withColumn("side", F.lit(0))
    rows = rows.join(told, ["key", "side"], "left").na.fill(0, ["good", "toxic"])
    group = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*group, "id").agg(F.count("*").alias("c"))
    known = F.col("id").isNotNull()
    copies = by_id.groupBy(*group).agg(
        F.sum("c").alias("n"), F.sum(F.when(known, F.col("c")).otherwise(0)).alias("known"),
        F.min(F.when(known, F.struct("id", "c"))).alias("first"))
    copies = copies.withColumn("least", F.min("first.id").over(W.partitionBy("digest")))
    later = F.col("known") - F.when(F.col("first.id") == F.col("least"), F.col("first.c")).otherwise(0)
    copies = copies.withColumn("later", later)
    both = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("later")).alias("n")),
                   F.struct(F.col("mask").bitwiseOR(_COPY).alias("mask"), F.col("later").alias("n")))
    flat = copies.select("part", "good", "toxic", F.explode(both).alias("cell"))
    return flat.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"),
        F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"))


def subset_survivors(counts: np.ndarray) -> np.ndarray:
    """Survivors (n, good, toxic) of every subset of filters, from the counts of the 32 mask cells."""
    mask = np.arange(len(counts))
    failing = np.zeros(len(counts), dtype=np.int64)
    live = counts.sum(axis=0)
    states = np.empty_like(counts)
    subset = 0
    states[subset] = live
    for step in range(1, len(counts)):
        bit = step & -step
        subset ^= bit
        hit = np.flatnonzero(mask & bit)
        if subset & bit:
            live = live - counts[hit[failing[hit] == 0]].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            live = live + counts[hit[failing[hit] == 0]].sum(axis=0)
        states[subset] = live
    return states


def _orders(frame: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros((1 << len(FILTERS), 3), dtype=np.int64)
    counts[frame["mask"].to_numpy(dtype=np.int64)] = frame[["n", "good", "toxic"]].to_numpy(dtype=np.int64)
    states = subset_survivors(counts)
    full = len(states) - 1
    out, total = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            gone = states[before] - states[before | bit]
            total[name] += int(gone[0])
            fails = states[0][0] - states[bit][0]
            out.append(("".join(order), step, states[before | bit][0], gone[0], fails - gone[0],
                        states[full ^ bit][0] - states[full][0], gone[1], gone[2], name))
            before |= bit
    out = pd.DataFrame(out, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                                     "toxic_lost", "name"])
    out["shapley"] = out.pop("name").map(total)
    out.insert(0, "part", frame["part"].iloc[0])
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step (see the module's docstring)."""
    return cells(docs, labels).groupBy("part").applyInPandas(
        _orders, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                 "unique_fails long, good_lost long, toxic_lost long, shapley long")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         len(words) < 200 AS fa, 100 * len(list_distinct(words)) < 50 * len(words) AS fb,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS fc,
         regexp_matches(text, '[#$%&*|]') AS fd, coalesce(d.doc_id > first_id, false) AS fe
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, concat(CASE WHEN fa THEN 'A' ELSE '' END, CASE WHEN fb THEN 'B' ELSE '' END, CASE WHEN fc THEN 'C' ELSE '' END,
                      CASE WHEN fd THEN 'D' ELSE '' END, CASE WHEN fe THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT p.k || q.k || r.k || s.k || t.k AS filter_order FROM x p, x q, x r, x s, x t
  WHERE p.k NOT IN (q.k, r.k, s.k, t.k) AND q.k NOT IN (r.k, s.k, t.k) AND r.k NOT IN (s.k, t.k) AND s.k <> t.k
), g AS (
  SELECT c.part, o.filter_order, s.step, substr(o.filter_order, s.step, 1) AS letter,
         substr(o.filter_order, 1, s.step - 1) AS earlier, c.fails, c.n, c.good, c.toxic
  FROM c, o, (SELECT unnest(range(1, 6)) AS step) s
), h AS (
  SELECT *, contains(fails, letter) AS hit,
         length(earlier) > 0 AND regexp_matches(fails, '[' || earlier || 'x]') AS gone FROM g
), r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, letter,
         sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM h GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
