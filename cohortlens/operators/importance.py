"""Importance from per-row contributions and its relation to coefficients and drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import count_where
from cohortlens.functions.session import stage
from cohortlens.operators.ordering import rank_gap, rank_map, topk_overlap

# Fixed values
MISSING_PREFIX = "was_missing_"
LEVEL_MARK = "__"
OVERLAP_K = [5, 10]


def linear_contributions(
    design: DataFrame, key: Sequence[str], coefficients: Mapping[str, float], means: Mapping[str, float]
) -> DataFrame:
    """Long (key, column, contribution) of a linear score: coefficient times centred value.

    One term per design column; with the intercept at the means they add up to the score.
    """
    terms = [
        (F.lit(float(coefficients[c])) * (F.col(f"`{c}`").cast("double") - F.lit(float(means[c])))).alias(c)
        for c in coefficients
    ]
    return design.select(*key, *terms).unpivot(list(key), [f"`{c}`" for c in coefficients], "column", "contribution")


def feature_of(column: str | Column) -> Column:
    """Feature a design column belongs to: its indicator and its category levels fold into it."""
    c = F.col(column) if isinstance(column, str) else column
    bare = F.when(c.startswith(MISSING_PREFIX), F.substring(c, len(MISSING_PREFIX) + 1, 1 << 20)).otherwise(c)
    return F.split(bare, LEVEL_MARK)[0]


def _folded(columns: Sequence[str]) -> dict[str, list[int]]:
    """Positions of each feature's design columns; see :func:`feature_of`."""
    at: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        bare = c[len(MISSING_PREFIX) :] if c.startswith(MISSING_PREFIX) else c
        at.setdefault(bare.split(LEVEL_MARK)[0], []).append(i)
    return at


def folded_contributions(
    design: DataFrame, keep: Sequence[str], coefficients: Mapping[str, float], means: Mapping[str, float]
) -> DataFrame:
    """``keep`` and ``contributions``: per feature the signed sum of its columns' terms in :func:`linear_contributions`.

    The sum is made inside the row, so the table keeps one row per input row and nothing is shuffled by row.
    """
    names = list(coefficients)
    term = {c: F.lit(float(coefficients[c])) * (F.col(f"`{c}`").cast("double") - F.lit(float(means[c]))) for c in names}
    parts = [F.struct(F.lit(f).alias("feature"), sum((term[names[i]] for i in at), F.lit(0.0)).alias("c")) for f, at in _folded(names).items()]
    return design.select(*keep, F.array(*parts).alias("contributions"))


def grouped_contribution(long: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean absolute value of the signed sum over each feature's columns."""
    per_row = long.groupBy(*key, feature_of("column").alias("feature")).agg(F.sum("contribution").alias("_c"))
    return per_row.groupBy("feature").agg(F.avg(F.abs("_c")).alias("importance"))


def vector_contributions(rows: DataFrame, x: str, columns: Sequence[str], weights: Sequence[float], intercept: float) -> DataFrame:
    """The input with ``contributions``, feature -> signed sum over the feature's columns, and the probability p that they add up to.

    Columns fold to features inside the row, so nothing is turned into long form.
    """
    w = F.array(*[F.lit(float(v)) for v in weights])
    terms = F.zip_with(F.col(x), w, lambda a, b: a * b)
    summed = rows.withColumn("_terms", terms)
    parts = [F.struct(F.lit(f).alias("feature"), sum((F.col("_terms")[i] for i in at), F.lit(0.0)).alias("c")) for f, at in _folded(columns).items()]
    out = summed.withColumn("contributions", F.array(*parts))
    score = F.aggregate("contributions", F.lit(float(intercept)), lambda a, t: a + t["c"])
    return out.withColumn("p", 1.0 / (1.0 + F.exp(-score))).drop("_terms")


def mean_contributions(rows: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute contribution over the rows, one aggregate of vectors; no rows give no features."""
    vector = array_to_vector(F.transform("contributions", lambda t: F.abs(t["c"])))
    got = rows.groupBy(F.lit(1)).agg(vector_to_array(Summarizer.mean(vector)).alias("m"), F.first(F.transform("contributions", lambda t: t["feature"])).alias("f"))
    return got.select(F.explode(F.arrays_zip("f", "m")).alias("t")).select(F.col("t.f").alias("feature"), F.col("t.m").alias("importance"))


def column_importance(long: DataFrame) -> DataFrame:
    """Mean absolute contribution per design column; columns that never contribute are marked."""
    return (
        long.groupBy("column")
        .agg(F.avg(F.abs("contribution")).alias("importance"), F.max(F.abs("contribution")).alias("_m"))
        .withColumn("never_used", F.col("_m") == 0.0)
        .drop("_m")
    )


def contribution_integrity(long: DataFrame, key: Sequence[str], base: float, stored: DataFrame) -> DataFrame:
    """Largest distance between the stored probability and the one rebuilt from contributions."""
    rebuilt = long.groupBy(*key).agg(F.sum("contribution").alias("_s"))
    p = 1.0 / (1.0 + F.exp(-(F.col("_s") + F.lit(float(base)))))
    both = stored.join(rebuilt, list(key), "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_where(F.col("_s").isNull()).alias("unmatched"),
        F.max(F.abs(p - F.col("p"))).alias("max_abs_deviation"),
    )


def importance_vs_coefficient(importance: DataFrame, coefficients: DataFrame, key: str) -> DataFrame:
    """Rank by contribution beside rank by absolute coefficient, largest disagreement first."""
    a = rank_map(importance, "importance", key, "rank_a").select(key, "importance", "rank_a")
    sized = stage(coefficients.withColumn("_abs", F.abs("coefficient")), "coefficients")
    b = rank_map(sized, "_abs", key, "rank_b").select(key, "coefficient", "rank_b")
    return rank_gap(a, b, [key])


def drift_vs_importance(psi: DataFrame, importance: DataFrame, ks: Sequence[int] = OVERLAP_K) -> DataFrame:
    """How many of the top features by drift are also on top by importance."""
    a = rank_map(psi, "psi", "feature", "rank_a").select("feature", "rank_a")
    b = rank_map(importance, "importance", "feature", "rank_b").select("feature", "rank_b")
    return topk_overlap(a, b, ["feature"], ks)
