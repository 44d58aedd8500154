"""Ranking, top-k and set helpers on result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranking import running_counts


def top_by_abs(df: DataFrame, value: str, tie: Sequence[str], k: int) -> DataFrame:
    """k rows of largest absolute value. Sort with limit keeps k rows per task, no full sort."""
    return df.orderBy(F.desc(F.abs(value)), *tie).limit(k)


def first_row(df: DataFrame, groups: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """First row per group by ascending ``order`` with NULL last.

    A minimum over a struct, so the choice is made by partial aggregation and no group is
    sorted in one task.
    """
    parts = []
    for c in order:
        parts += [F.col(c).isNull().alias(f"_null_{c}"), F.col(c)]
    best = F.min(F.struct(*parts, *[F.col(c) for c in carry if c not in order]))
    names = [*order, *[c for c in carry if c not in order]]
    return df.groupBy(*groups).agg(best.alias("_b")).select(*groups, *[f"_b.{c}" for c in names])


def argmin(df: DataFrame, groups: Sequence[str], cost: str, choice: Sequence[str]) -> DataFrame:
    """Cheapest choice per group; among equal costs the smallest ``choice`` wins."""
    best = F.min(F.struct(F.col(cost), *[F.col(c) for c in choice]))
    return df.groupBy(*groups).agg(best.alias("_b")).select(*groups, *[f"_b.{c}" for c in choice], f"_b.{cost}")


def rank_map(df: DataFrame, value: str, key: str, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """Position by descending value (1 = largest), ties by ascending key, without one global window.

    With a numeric key even one value shared by most rows is ranked in pieces. A text key is meant
    for tables of names (features, slices); rows of equal value are then sorted together.
    """
    ladder = running_counts(df, groups, value, {"n": F.lit(1)})
    above = F.col("n_total") - F.col("n_below") - F.col("n")
    lines = ladder.select(*groups, value, above.alias("_above"), F.col("n").alias("_same"))
    placed = df.join(lines, [*groups, value])
    alone = placed.where(F.col("_same") == 1).withColumn("_pos", F.lit(1))
    tied = placed.where(F.col("_same") > 1)
    if dict(df.dtypes)[key] == "string":
        same = Window.partitionBy(*groups, value).orderBy(key)
        ranked = tied.withColumn("_pos", F.row_number().over(same))
    else:
        inner = running_counts(tied, [*groups, value], key, {"n": F.lit(1)})
        ranked = tied.join(
            inner.select(*groups, value, key, (F.col("n_below") + 1).alias("_pos")), [*groups, value, key]
        )
    place = (F.col("_above") + F.col("_pos")).cast("bigint").alias(out)
    return alone.unionByName(ranked).select(*df.columns, place)


def topk_overlap(a: DataFrame, b: DataFrame, key: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Members of both top-k sets for several k. Only rows inside the largest k take part."""
    most = max(ks)
    both = a.where(F.col("rank_a") <= most).join(b.where(F.col("rank_b") <= most), list(key))
    sized = both.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    member = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    inside = (F.col("rank_a") <= F.col("k")) & (F.col("rank_b") <= F.col("k"))
    found = sized.where(inside).groupBy("k").agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank_a", member.alias("m")))), lambda s: s["m"]), ","
        ).alias("shared"),
    )
    all_k = a.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).distinct()
    return all_k.join(found, "k", "left").select(
        "k", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("shared", F.lit("")).alias("shared")
    )


def rank_gap(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Both ranks and their difference, largest disagreement first."""
    gap = F.col("rank_a") - F.col("rank_b")
    return a.join(b, list(key)).withColumn("gap", gap).orderBy(F.desc(F.abs("gap")), "rank_a")


def membership_flag(df: DataFrame, members: DataFrame, key: Sequence[str], out: str) -> DataFrame:
    """``df`` with a boolean: does its key occur in ``members``."""
    keys = members.select(*key).distinct().withColumn("_in", F.lit(True))
    return df.join(keys, list(key), "left").withColumn(out, F.col("_in").isNotNull()).drop("_in")


def two_way_difference(a: DataFrame, b: DataFrame, key: Sequence[str], a_name: str, b_name: str) -> DataFrame:
    """Values only in ``a`` and values only in ``b``."""
    left, right = a.select(*key).distinct(), b.select(*key).distinct()
    only_a = left.join(right, list(key), "left_anti").select(F.lit(a_name).alias("side"), *key)
    only_b = right.join(left, list(key), "left_anti").select(F.lit(b_name).alias("side"), *key)
    return only_a.unionByName(only_b)
