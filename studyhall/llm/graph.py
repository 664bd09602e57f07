"""Connected components of a link table by alternating star contractions (large-star, small-star).

Every step is a grouped minimum and a join; the table is written to the shared folder after each
pair of steps, so lineage stays short. The number of steps grows with the logarithm of the
longest path, and no component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.llm.common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable, itself included.

    Loops and repeated links are harmless; rows with a null end are ignored; no links, no rows.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), name)
    before = None
    while True:
        size = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if size["n"] == 0 or tuple(size) == before:
            break
        before = tuple(size)
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges = written(small, name)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
