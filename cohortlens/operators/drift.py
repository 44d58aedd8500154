"""Population drift between two splits: stability index, intervals, decomposition by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranking import same_keys
from cohortlens.functions.scalars import (
    NULL_TOKEN,
    count_where,
    safe_ratio,
    unpivot_text,
    wilson_bounds,
)
from cohortlens.functions.session import stage
from cohortlens.operators.ordering import rank_map
from cohortlens.operators.quantile_cells import quantile_cells

# Fixed values
EPSILON = 1e-4
EPSILONS = [1e-3, 1e-4, 1e-6]
BINS = 10
STABLE_BELOW = 0.1
MODERATE_TO = 0.25
THIN_ROWS = 200


def psi_term(train: Column, test: Column, eps: Column | float = EPSILON) -> Column:
    """One bin's share of the index, an empty side replaced by ``eps``."""
    e = F.lit(eps) if isinstance(eps, float) else eps
    q = F.when(train <= 0, e).otherwise(train)
    p = F.when(test <= 0, e).otherwise(test)
    return (p - q) * F.ln(p / q)


def _proportions(counts: DataFrame, by: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups.., feature, bin, train_n, test_n) with shares of each feature's split totals.

    The totals are window sums over counted bins, so the rows behind them are read once.
    """
    whole = Window.partitionBy(*groups, "feature")
    return (
        counts.withColumn("train_prop", safe_ratio("train_n", F.sum("train_n").over(whole), 0.0))
        .withColumn("test_prop", safe_ratio("test_n", F.sum("test_n").over(whole), 0.0))
        .withColumn("term", psi_term(F.col("train_prop"), F.col("test_prop")))
        .select(*groups, *by, "train_prop", "test_prop", "term")
    )


def numeric_bins(
    df: DataFrame, features: Sequence[str], train: str = "train", test: str = "test", groups: Sequence[str] = ()
) -> DataFrame:
    """(groups.., feature, bin, degenerate, train_prop, test_prop, term) for numeric features; NULL is the last bin.

    Bins are cut at ten exact train quantiles of the feature in its group. Outer edges are open, so values beyond the train
    range fall into the end bins. Fewer than two distinct train values give no inner edge and the feature is marked
    degenerate. The rows are read twice, whatever the number of features and groups.
    """
    in_train, in_test = F.col("split") == train, F.col("split") == test
    counted = {"train_n": in_train, "test_n": in_test}
    cells, q = quantile_cells(df.where(in_train | in_test), groups, features, in_train, counted, BINS)
    edges = F.array_sort(F.array_distinct("edges"))
    n = F.size(edges)
    inner = F.when(n > 2, F.slice(edges, F.lit(2), F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<double>"))
    by = [*groups, "feature"]
    cuts = stage(q.select(*by, inner.alias("inner"), (n < 2).alias("degenerate")), "edges")
    above = F.expr(" + ".join(f"IF(value >= get(inner, {i}), 1, 0)" for i in range(BINS - 1)))
    binned = same_keys(cells, cuts, by).withColumn("bin", F.when(F.col("value").isNull(), F.size("inner") + 1).otherwise(above))
    counts = binned.groupBy(*by, "bin").agg(F.sum("train_n").alias("train_n"), F.sum("test_n").alias("test_n"))
    axis = cuts.select(*by, "degenerate", F.explode(F.sequence(F.lit(0), F.size("inner") + 1)).alias("bin"))
    full = same_keys(axis, counts, [*by, "bin"], "left").fillna(0, ["train_n", "test_n"])
    return _proportions(full, ["feature", "bin", "degenerate"], groups)


def categorical_bins(
    df: DataFrame, features: Sequence[str], train: str = "train", test: str = "test", groups: Sequence[str] = ()
) -> DataFrame:
    """The same per category of either split; NULL is a category of its own."""
    long = unpivot_text(df.where(F.col("split").isin(train, test)), [*groups, "split"], features, value="bin")
    counts = long.groupBy(*groups, "feature", "bin").agg(
        count_where(F.col("split") == train).alias("train_n"), count_where(F.col("split") == test).alias("test_n")
    )
    return _proportions(counts, ["feature", "bin"], groups)


def psi_numeric(bins: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Index per feature with the number of bins used (the NULL bin not counted)."""
    return bins.groupBy(*groups, "feature").agg(
        F.sum("term").alias("psi"),
        (F.count(F.lit(1)) - 1).alias("n_bins_used"),
        F.max("degenerate").alias("degenerate"),
        one_sided_empty().alias("empty_bins"),
    )


def psi_categorical(bins: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return bins.groupBy(*groups, "feature").agg(
        F.sum("term").alias("psi"),
        F.count(F.lit(1)).alias("n_bins_used"),
        (F.count(F.lit(1)) < 2).alias("degenerate"),
        one_sided_empty().alias("empty_bins"),
    )


def psi_band(psi: str | Column) -> Column:
    psi = F.col(psi) if isinstance(psi, str) else psi
    return F.when(psi < STABLE_BELOW, "stable").when(psi <= MODERATE_TO, "moderate").otherwise("significant")


def one_sided_empty() -> Column:
    """Bins empty on exactly one side, the only ones where the substitute constant matters."""
    return count_where((F.col("train_prop") <= 0) != (F.col("test_prop") <= 0))


def epsilon_sensitivity(bins: DataFrame, epsilons: Sequence[float] = EPSILONS) -> DataFrame:
    """Index under other constants, recomputed from the stored bins, for affected features."""
    affected = bins.groupBy("feature").agg(one_sided_empty().alias("empty_bins")).where("empty_bins > 0")
    rows = bins.join(affected, "feature").withColumn(
        "epsilon", F.explode(F.array(*[F.lit(float(e)) for e in epsilons]))
    )
    term = psi_term(F.col("train_prop"), F.col("test_prop"), F.col("epsilon"))
    return rows.groupBy("feature", "epsilon").agg(F.sum(term).alias("psi"))


def drift_table(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    train: str = "train",
    test: str = "test",
    groups: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(one row per group and feature, all bins), both over numeric and categorical features."""
    nb = stage(numeric_bins(df, numeric, train, test, groups), "numeric-bins")
    cb = stage(categorical_bins(df, categorical, train, test, groups), "categorical-bins")
    psi = psi_numeric(nb, groups).withColumn("kind", F.lit("numeric")).unionByName(
        psi_categorical(cb, groups).withColumn("kind", F.lit("categorical"))
    )
    null_bin = F.max("bin").over(Window.partitionBy(*groups, "feature"))
    labelled = nb.withColumn(
        "bin", F.when(F.col("bin") == null_bin, NULL_TOKEN).otherwise(F.col("bin").cast("string"))
    )
    bins = labelled.drop("degenerate").unionByName(cb)
    return psi.withColumn("band", psi_band("psi")), bins


def ranked_report(psi: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Features by falling index with their place inside each group."""
    return rank_map(psi, "psi", "feature", "place", groups).orderBy(*groups, "place")


def top_bins(ranked: DataFrame, bins: DataFrame, k: int) -> DataFrame:
    top = ranked.where(F.col("place") <= k).select("feature", "place")
    return bins.join(top, "feature")


def base_rate_drift(cohort: DataFrame, sets: Sequence[Sequence[str]], label: str = "not_completed") -> DataFrame:
    """n, k, rate and Wilson interval per presentation and per module-presentation in one pass."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    rates = cohort.groupingSets([list(s) for s in sets], *cols).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("k")
    )
    lo, hi = wilson_bounds("k", "n")
    return rates.select(*cols, "n", "k", safe_ratio("k", "n").alias("rate"), lo.alias("lo"), hi.alias("hi"))


def module_decomposition(metrics: DataFrame, split_rows: DataFrame, thin: int = THIN_ROWS) -> DataFrame:
    """Ranking metrics per group beside how many rows each group had in the earlier splits.

    ``metrics`` has one row per group, ``split_rows`` (group, n_train, n_validate).
    """
    return (
        metrics.join(split_rows, "module", "left")
        .fillna(0, ["n_train", "n_validate"])
        .select(
            "module",
            "n",
            "base_rate",
            "auc_pr",
            safe_ratio("auc_pr", "base_rate").alias("ratio"),
            "brier",
            "auc_roc",
            "n_train",
            "n_validate",
            (F.col("n_train") < thin).alias("thin"),
        )
    )


def decomposition_spread(decomposed: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Best and worst group and the distance between them for each metric."""
    long = decomposed.where(F.col("auc_pr").isNotNull() & (F.col("module") != "ALL"))
    long = long.select("module", *metrics).unpivot(["module"], list(metrics), "metric", "value")
    most = F.max(F.struct("value", "module"))
    least = F.min(F.struct("value", "module"))
    return long.groupBy("metric").agg(
        most["module"].alias("highest"),
        least["module"].alias("lowest"),
        (most["value"] - least["value"]).alias("spread"),
    )
