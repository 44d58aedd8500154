"""Metrics of a long scored table ``(groups.., key, y, p)``.

All of them follow from cells: one row per (group, distinct score) with its rows ``n`` and positives ``pos``. Cells of
parts of a table add up, so :func:`score_cells` reads the rows once for any number of groupings and metrics; what
remains is the rows at a boundary that a budget cuts through. The functions that take rows see each row as a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranking import budget_hits, cell_ladder, collapsed, running_counts
from cohortlens.functions.scalars import count_where, safe_ratio
from cohortlens.functions.session import stage

# Fixed values
GRID = [k / 100.0 for k in range(1, 100)]
RATIOS = list(range(2, 21))
HEADLINE_RATIO = 10
BUDGETS = [0.05, 0.10, 0.20]
THRESHOLD_STEP = 0.05
ECE_BINS = 10


def confusion(scored: DataFrame, groups: Sequence[str], threshold: float | str = "threshold") -> DataFrame:
    """False negatives, false positives and n with ``p >= threshold`` flagged.

    ``threshold`` is a number or the name of a column of ``scored``.
    """
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    flagged = F.col("p") >= t
    return scored.groupBy(*groups).agg(
        count_where((F.col("y") == 1) & ~flagged).alias("fn"),
        count_where((F.col("y") == 0) & flagged).alias("fp"),
        F.count(F.lit(1)).alias("n"),
    )


def cost(ratio: float | str | Column = HEADLINE_RATIO) -> Column:
    r = F.col(ratio) if isinstance(ratio, str) else ratio if isinstance(ratio, Column) else F.lit(ratio)
    return (r.cast("double") * F.col("fn") + F.col("fp")) / F.col("n")


def with_cost(conf: DataFrame, ratio=HEADLINE_RATIO, name: str = "expected_cost") -> DataFrame:
    return conf.withColumn(name, cost(ratio))


def score_cells(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Stored cells ``(groups.., p, n, pos)`` of all scored rows, the rows read once."""
    return collapsed(scored, groups, "p", F.col("y"))


def rows_as_cells(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    one = F.lit(1).cast("bigint").alias("n")
    return scored.select(*groups, F.col("p").cast("double").alias("p"), one, F.col("y").cast("bigint").alias("pos"))


def cell_confusion(cells: DataFrame, groups: Sequence[str], threshold: float | str = "threshold") -> DataFrame:
    """:func:`confusion` of cells."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    none = F.lit(0).cast("bigint")
    return cells.groupBy(*groups).agg(
        F.sum(F.when(F.col("p") >= t, none).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(F.col("p") >= t, F.col("n") - F.col("pos")).otherwise(none)).alias("fp"),
        F.sum("n").alias("n"),
    )


def confusion_by_threshold(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """fn, fp, n for each of the 99 grid thresholds and each group."""
    return grid_confusion(rows_as_cells(scored, groups), groups)


def grid_confusion(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """:func:`confusion_by_threshold` of cells.

    Scores are binned by the grid (bin k: k thresholds are at or below the score), counted, and
    summed along at most 100 bins per group.
    """
    cut = Bucketizer(
        splits=[-float("inf"), *GRID, float("inf")], inputCol="p", outputCol="_bin", handleInvalid="error"
    )
    cells = cut.transform(cells).groupBy(*groups, F.col("_bin").cast("int").alias("_bin")).agg(
        F.sum("pos").alias("_pos"), F.sum(F.col("n") - F.col("pos")).alias("_neg")
    )
    axis = cells.select(*groups).distinct().withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(len(GRID)))))
    full = axis.join(cells, [*groups, "_bin"], "left").fillna(0, ["_pos", "_neg"])
    below = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    return (
        full.select(
            *groups,
            "_bin",
            F.coalesce(F.sum("_pos").over(below), F.lit(0)).alias("fn"),
            (F.sum("_neg").over(whole) - F.coalesce(F.sum("_neg").over(below), F.lit(0))).alias("fp"),
            F.sum(F.col("_pos") + F.col("_neg")).over(whole).alias("n"),
        )
        .where(F.col("_bin") >= 1)
        .select(*groups, (F.col("_bin") / F.lit(100.0)).alias("threshold"), "fn", "fp", "n")
    )


def best_threshold(table: DataFrame, groups: Sequence[str], ratio=HEADLINE_RATIO) -> DataFrame:
    """Cheapest threshold per group; the lowest of equally cheap ones."""
    best = F.min(F.struct(cost(ratio).alias("expected_cost"), "threshold", "fn", "fp", "n"))
    return table.groupBy(*groups).agg(best.alias("_b")).select(
        *groups, "_b.threshold", "_b.expected_cost", "_b.fn", "_b.fp", "_b.n"
    )


def with_ratios(table: DataFrame, ratios: Sequence[int] = RATIOS) -> DataFrame:
    """One copy of each row of a small table per cost ratio."""
    return table.withColumn("ratio", F.explode(F.array(*[F.lit(int(r)) for r in ratios])))


def cost_ratio_curve(table: DataFrame, groups: Sequence[str], ratios: Sequence[int] = RATIOS) -> DataFrame:
    return best_threshold(with_ratios(table, ratios), [*groups, "ratio"], "ratio").select(
        *groups, "ratio", "threshold", "expected_cost"
    )


def threshold_sensitivity(table: DataFrame, groups: Sequence[str], ratio=HEADLINE_RATIO) -> DataFrame:
    """Cost at the best threshold and one step to either side, clipped to the grid."""
    best = best_threshold(table, groups, ratio).select(*groups, "threshold", "expected_cost")
    step = int(round(THRESHOLD_STEP * 100))
    k = F.round(F.col("threshold") * 100).cast("int")
    best = best.withColumn("_lo", F.greatest(F.lit(1), k - step)).withColumn("_hi", F.least(F.lit(99), k + step))
    costs = table.select(*groups, F.round(F.col("threshold") * 100).cast("int").alias("_k"), cost(ratio).alias("_c"))
    near = costs.join(best, list(groups)).where((F.col("_k") == F.col("_lo")) | (F.col("_k") == F.col("_hi")))
    return near.groupBy(*groups, "threshold", "expected_cost").agg(
        F.max(F.when(F.col("_k") == F.col("_lo"), F.col("_c"))).alias("cost_minus"),
        F.max(F.when(F.col("_k") == F.col("_hi"), F.col("_c"))).alias("cost_plus"),
    )


def score_ladder(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per (group, distinct score): n, pos and the sums below each score."""
    y = F.col("y").cast("bigint")
    return running_counts(scored, groups, "p", {"n": F.lit(1), "pos": y})


def stored_ladder(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """:func:`score_ladder` from cells, written out for several readers."""
    return stage(cell_ladder(cells, groups, "p"), "score-ladder")


def ranking_metrics(ladder: DataFrame, groups: Sequence[str]) -> DataFrame:
    """n, positives, base rate, average precision, ROC AUC and Brier score per group.

    Average precision steps over distinct scores; the AUC counts ties as one half. Both are
    NULL when a group has only one class.
    """
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    neg = n - pos
    all_n, all_pos = F.col("n_total").cast("double"), F.col("pos_total").cast("double")
    neg_below = (F.col("n_below") - F.col("pos_below")).cast("double")
    caught = all_pos - F.col("pos_below")
    shown = all_n - F.col("n_below")
    sums = ladder.groupBy(*groups).agg(
        F.max("n_total").alias("n"),
        F.max("pos_total").alias("positives"),
        F.sum(pos * caught / shown).alias("_ap"),
        F.sum(pos * (neg_below + neg / 2.0)).alias("_auc"),
        F.sum(pos * (F.col("p") - 1.0) * (F.col("p") - 1.0) + neg * F.col("p") * F.col("p")).alias("_sq"),
    )
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    p = F.col("positives").cast("double")
    return sums.select(
        *groups,
        "n",
        "positives",
        (p / F.col("n")).alias("base_rate"),
        F.when(both, F.col("_ap") / p).alias("auc_pr"),
        F.when(both, F.col("_auc") / (p * (F.col("n") - p))).alias("auc_roc"),
        (F.col("_sq") / F.col("n")).alias("brier"),
    )


def recall_at_budgets(
    scored: DataFrame,
    groups: Sequence[str],
    key: Sequence[str],
    budgets: Sequence[float] = BUDGETS,
    seed: int = 42,
    ladder: DataFrame | None = None,
) -> DataFrame:
    """Share of positives among the top ``max(1, round(budget * n))`` rows, with its ceiling.

    With a stored ``ladder`` of the same groups the rows are read for ties at a boundary only.
    """
    hits = budget_hits(scored, groups, key, "y", "p", budgets, seed, ladder)
    return hits.select(
        *groups,
        "budget",
        "k",
        safe_ratio("tp", "pos_total").alias("recall"),
        recall_ceiling(F.col("budget"), F.col("pos_total") / F.col("n_total")).alias("ceiling"),
    )


def recall_ceiling(budget: Column, base_rate: Column) -> Column:
    return F.when(base_rate > 0, F.least(F.lit(1.0), budget / base_rate))


def calibration(scored: DataFrame, groups: Sequence[str], bins: int = ECE_BINS) -> DataFrame:
    """Equal-width probability bins, empty ones included, with each bin's share of the ECE."""
    return cell_calibration(rows_as_cells(scored, groups), groups, bins)


def cell_calibration(cells: DataFrame, groups: Sequence[str], bins: int = ECE_BINS) -> DataFrame:
    """:func:`calibration` of cells."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    cut = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="p", outputCol="_bin", handleInvalid="error")
    cells = cut.transform(cells).groupBy(*groups, F.col("_bin").cast("int").alias("bin")).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_p"),
        (F.sum("pos") / F.sum("n")).alias("observed"),
    )
    axis = cells.select(*groups).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    whole = Window.partitionBy(*groups)
    full = axis.join(cells, [*groups, "bin"], "left").fillna(0, ["n"])
    share = F.col("n") / F.sum("n").over(whole) * F.abs(F.col("mean_p") - F.col("observed"))
    return full.withColumn("ece_part", F.coalesce(share, F.lit(0.0)))


def ece(bins: DataFrame, groups: Sequence[str]) -> DataFrame:
    return bins.groupBy(*groups).agg(
        F.sum("ece_part").alias("ece"), count_where(F.col("n") == 0).alias("empty_bins")
    )


def metric_rows(wide: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metrics to (keep.., metric, value)."""
    return wide.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keep), list(metrics), "metric", "value"
    )
