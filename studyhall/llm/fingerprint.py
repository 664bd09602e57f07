"""Document fingerprints as threshold-scaled sketches (DataFrame functions only).

A text's fingerprint keeps every hash of its shingles of ``width`` words that lies in the lowest
1/``scale`` of the 64-bit range. The same shingle is kept or dropped in every text, so fingerprints of
parts merge by union, and overlaps of very unequal texts are estimated without bias: similarity as
intersection over union, containment as intersection over one side. A text with words but no
such hash keeps its smallest one, so that short texts can be told apart; only texts without words have
empty fingerprints.

Words are lower-cased runs between white space; a text with fewer than ``width`` words is one
shingle. Two empty fingerprints have likeness 1, an empty and another one 0. Null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 5
SCALE = 8
LOWEST = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda's variable is)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Sorted array of the kept 64-bit hashes."""
    bound = F.lit(LOWEST + (1 << 64) // scale).cast("long")
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), "")

    def shingles(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)),
                                                      lambda i: F.xxhash64(F.slice(h, i, width)))
                      ).otherwise(F.filter(F.array(F.xxhash64(h)), lambda _: F.size(h) > 0))

    def kept(s: Column) -> Column:
        return let(F.filter(s, lambda x: x < bound),
                   lambda low: F.when((F.size(low) > 0) | (F.size(s) == 0), F.sort_array(F.array_distinct(low)))
                   .otherwise(F.array(F.array_min(s))))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), shingles), kept)


def as_string(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, lambda x: F.hex(x)), ",")


def similarity(a: Column, b: Column) -> Column:
    def of(i: Column) -> Column:
        union = F.size(a) + F.size(b) - i
        return F.when(union == 0, F.lit(1.0)).otherwise(i / union)
    return let(F.size(F.array_intersect(a, b)), of)


def containment(a: Column, b: Column) -> Column:
    """Share of the first text's shingles that the second holds."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(sketches: Column, scale: int = SCALE) -> Column:
    """Fingerprint of the union of the texts' shingle sets, from an array of sketches."""
    bound = F.lit(LOWEST + (1 << 64) // scale).cast("long")

    def kept(s: Column) -> Column:
        return let(F.filter(s, lambda x: x < bound),
                   lambda low: F.when((F.size(low) > 0) | (F.size(s) == 0), F.sort_array(low))
                   .otherwise(F.array(F.array_min(s))))
    return let(F.array_distinct(F.flatten(sketches)), kept)


def in_buckets(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) dealt out so that a window finds each row's next by (id, text), cyclic:
    partitioned by ``__bucket``, to be ordered by (``__last``, ``__key``, text).

    The id range is cut into buckets at approximate quantiles; each bucket also gets a copy of the
    first row of the following bucket (the last one that of the first) with ``__last`` = 1, so one shuffle
    of the texts and a window inside a bucket are enough. A null id comes first.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("__key", F.coalesce("id", F.lit(LOWEST).cast("long")))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("__key", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    at = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>"),
                         lambda c: c <= F.col("__key")))
    docs = docs.withColumn("__bucket", at)
    # One row per bucket that has rows: a bound set by the number of buckets.
    in_turn = W.orderBy("b")
    firsts = docs.groupBy(F.col("__bucket").alias("b")).agg(F.min("__key").alias("k"))
    firsts = firsts.withColumn("to", F.coalesce(F.lag("b").over(in_turn), F.max("b").over(
        in_turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    heads = docs.join(F.broadcast(firsts), (F.col("__bucket") == F.col("b")) & (F.col("__key") == F.col("k")))
    heads = heads.withColumn("__n", F.row_number().over(W.partitionBy("b").orderBy("text"))).filter("__n = 1")
    rows = docs.withColumn("__last", F.lit(0)).unionByName(
        heads.withColumn("__bucket", F.col("to")).withColumn("__last", F.lit(1)).drop("b", "k", "to", "__n"))
    return rows.repartition("__bucket")


def fingerprints(docs: DataFrame, *, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Per row of ``docs`` (id, text): its sketch, that of its edited text, and the likenesses.

    The edited text ends in the first code points of the next document (see ``in_buckets``) instead
    of its own last quarter.
    """
    rows = in_buckets(docs.select("id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("sketch", sketch(F.col("text"), width, scale))
    w = W.partitionBy("__bucket").orderBy("__last", "__key", "text")
    rows = rows.select("id", "text", "sketch", "__last", F.lead("text").over(w).alias("next_text"),
                       F.lead("sketch").over(w).alias("next_sketch")).filter("__last = 0")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.select("id", n.cast("long").alias("n_chars"), "sketch", "next_sketch",
                       F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut)).alias("edited"))
    rows = rows.select("id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"),
                       sketch(F.col("edited"), width, scale).alias("edited_sketch"))
    return rows.select("id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
                       similarity(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       similarity(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                       containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"))
