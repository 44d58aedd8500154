"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.session import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: long); label is the smallest node it reaches.

    Each turn writes the contracted links to the shared folder, so lineage stays short and a lost
    executor costs one turn at most. The smallest node of a component labels itself. No links give
    no rows.
    """

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stage(links.where("a != b").select("a", "b").distinct(), "links")
    before = mark(now)
    while before[0]:
        now = stage(_small_star(_large_star(now)), "links")
        after = mark(now)
        if after == before:
            break
        before = after
    star = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return star.unionByName(star.select(F.col("label").alias("node"), "label").distinct())
