"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Token counts are summed per cell (source, language, topic); raking scales the cells to each dimension's
target shares in turn, a fixed number of rounds; the fitted over the observed count of a cell is the
weight of its documents. Probabilities are min(1, c * weight) with c calibrated so that the expected
tokens meet the budget, and a document is taken if a hash of its id falls below its probability:
the same documents whatever the partitioning.

Target shares are given per dimension and value; a value without target keeps the share it has, and
each dimension's targets are scaled to sum to one over the values present. All of raking and
calibration runs on the cell table; documents are read once for the counts and once for the
decision, and meet the cells in a join Spark may broadcast when it has measured it small.

Defined results: nulls are a value of their own in each dimension; texts without words carry no
tokens, weight their cell's, and are sampled like any other; a cell without tokens has weight 1; a
null id counts as the empty text in the hash; repeated rows are taken or left together; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyhall.llm.common import written

ROUNDS = 6
CALIBRATION = 8
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
NONE = "\x00"  # stands for null in the cell key


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_topic(text: Column) -> Column:
    """A coarse topic from the form of the whole text: list, table of numbers, long prose, note."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    bars = n - F.length(F.replace(t, F.lit("|"), F.lit("")))
    digits = n - F.length(F.translate(t, "0123456789", ""))
    return (F.when(bars * 50 > n, "list").when(digits * 10 > n, "numbers").when(n >= 4000, "long")
            .when(n >= 400, "prose").otherwise("note"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Targets (dim, value, share) in proportion to a power of the tokens of each value of ``dim``."""
    total = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("t"))
    return total.select(F.lit(dim).alias("dim"), "value", F.pow(F.col("t").cast("double"), F.lit(power)).alias("share"))


def count_cells(docs: DataFrame, dims: list[str]) -> DataFrame:
    """(dims..., tokens) of ``docs`` (dims..., n_tokens); null values under the key ``NONE``."""
    return docs.groupBy(*[F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in dims]).agg(
        F.sum("n_tokens").alias("tokens"))


def rake(cells: DataFrame, targets: DataFrame, dims: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` plus ``fitted``: tokens raked to the targets (dim, value, share), total kept."""
    total = cells.select("*", F.sum("tokens").over(W.partitionBy(F.lit(0))).cast("double").alias("__all"))
    cells = total.withColumn("fitted", F.col("tokens").cast("double"))
    for d in dims:
        goal = targets.filter(F.col("dim") == d).select(F.col("value").alias(d), F.col("share").alias("__s"))
        own = F.sum("tokens").over(W.partitionBy(d)) / F.col("__all")
        cells = cells.join(goal, d, "left").withColumn("__s", F.coalesce("__s", own))
        one = F.when(F.row_number().over(W.partitionBy(d).orderBy(*dims)) == 1, F.col("__s"))
        cells = cells.withColumn("__one", one).withColumn(
            f"__goal_{d}", F.col("__s") / F.sum("__one").over(W.partitionBy(F.lit(0))) * F.col("__all")).drop("__s", "__one")
    cells = written(cells, "cells")
    for r in range(rounds):
        for d in dims:
            now = F.sum("fitted").over(W.partitionBy(d))
            cells = cells.withColumn("fitted", F.when(now > 0, F.col("fitted") * F.col(f"__goal_{d}") / now)
                                     .otherwise(F.col("fitted")))
        if r % 3 == 2:
            cells = written(cells, "cells")
    return cells.drop("__all", *[f"__goal_{d}" for d in dims])


def calibrate(cells: DataFrame, keep: float, rounds: int = CALIBRATION) -> DataFrame:
    """``cells`` (tokens, fitted) plus weight and probability; expected tokens are ``keep`` of all."""
    cells = written(cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens"))
                                     .otherwise(F.lit(1.0))), "weights")
    c = keep
    for _ in range(rounds):
        full = F.col("weight") * F.lit(c) >= 1
        got = cells.agg(F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
                        F.sum(F.when(~full, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("rest")).first()
        if not got["rest"]:
            break
        before, c = c, max(c, (keep * got["all"] - got["full"]) / got["rest"])
        if c == before:
            break
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(float(c))))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, *, dims: list[str], id_col: str = "doc_id", tokens_col: str = "n_tokens",
        targets: DataFrame | None = None, powers: dict[str, float] | None = None, keep: float = 0.5,
        seed: str = "mix") -> DataFrame:
    """``docs`` plus weight, probability and sampled (new columns replace old ones of these names)."""
    docs = docs.drop("weight", "probability", "sampled")
    cells = written(count_cells(docs.select(*dims, F.col(tokens_col).alias("n_tokens")), dims), "counts")
    if targets is None:
        for d in dims:
            one = tempered(cells, d, (powers or {}).get(d, 1.0))
            targets = one if targets is None else targets.unionByName(one)
    cells = calibrate(rake(cells, targets, dims), keep)
    cells = cells.select(*[F.col(d).alias(f"__{d}") for d in dims], "weight", "probability")
    on = [F.coalesce(docs[d].cast("string"), F.lit(NONE)) == cells[f"__{d}"] for d in dims]
    out = docs.join(cells, on).drop(*[f"__{d}" for d in dims])
    return out.withColumn("sampled", uniform(F.col(id_col), seed) < F.col("probability"))


def oracle_sql(powers: dict[str, float], keep: float, seed: str = "mix", rounds: int = ROUNDS,
               calibration: int = CALIBRATION) -> str:
    """The same in DuckDB SQL over ``documents``, rounds written out."""
    dims = ["source", "lang", "topic"]
    key = ", ".join(dims)
    sql = f"""WITH d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+')) AS n_tokens,
         CASE WHEN (length(t) - length(replace(t, '|', ''))) * 50 > length(t) THEN 'list'
              WHEN (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) * 10 > length(t) THEN 'numbers'
              WHEN length(t) >= 4000 THEN 'long' WHEN length(t) >= 400 THEN 'prose' ELSE 'note' END AS topic
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)
), c AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL
), """
    for d in dims:
        sql += (f"g_{d} AS (SELECT {d}, pow(sum(tokens), {powers.get(d, 1.0)}) / sum(pow(sum(tokens), {powers.get(d, 1.0)}))"
                f" OVER () * (SELECT sum(tokens) FROM c) AS goal FROM c GROUP BY {d}),\n")
    sql += f"f0 AS MATERIALIZED (SELECT {key}, tokens, tokens AS fitted FROM c)"
    n = 0
    for _ in range(rounds):
        for d in dims:
            n += 1
            sql += (f",\nf{n} AS MATERIALIZED (SELECT f.source, f.lang, f.topic, tokens, CASE WHEN now > 0 THEN fitted * goal / now"
                    f" ELSE fitted END AS fitted FROM (SELECT *, sum(fitted) OVER (PARTITION BY {d}) AS now FROM f{n - 1}) f"
                    f" JOIN g_{d} g ON f.{d} IS NOT DISTINCT FROM g.{d})")
    sql += (f",\nw AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN fitted / tokens ELSE 1.0 END AS weight FROM f{n}),"
            f"\nc0 AS (SELECT {keep}::DOUBLE AS c)")
    for i in range(calibration):
        sql += (f",\nc{i + 1} AS MATERIALIZED (SELECT CASE WHEN rest > 0 THEN greatest(c, ({keep} * all_ - full_) / rest) ELSE c END AS c"
                f" FROM (SELECT any_value(c) AS c, sum(tokens) AS all_, coalesce(sum(tokens) FILTER (WHERE weight * c >= 1), 0)"
                f" AS full_, coalesce(sum(tokens * weight) FILTER (WHERE NOT weight * c >= 1), 0) AS rest FROM w, c{i}))")
    sql += f""",
p AS (SELECT w.*, least(1.0, weight * c) AS probability FROM w, c{calibration})
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.weight, 6) AS weight,
       round(p.probability, 6) AS probability,
       ('0x' || substr(md5('{seed}' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p.probability AS sampled
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic"""
    return sql
