"""Evaluation of frozen policies on a holdout: slices, trivial policies, stability, comparisons.

Inputs are long scored rows ``(cutoff, split, rung, key, y, p)`` and the small tables derived from
them. A policy is one row per (cutoff, rung).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranking import same_keys
from cohortlens.functions.scalars import safe_ratio, unpivot_text
from cohortlens.functions.session import stage
from cohortlens.operators.ordering import argmin
from cohortlens.operators.scoring import (
    HEADLINE_RATIO,
    RATIOS,
    best_threshold,
    cell_calibration,
    cell_confusion,
    confusion,
    confusion_by_threshold,
    cost,
    cost_ratio_curve,
    ece,
    grid_confusion,
    metric_rows,
    ranking_metrics,
    recall_at_budgets,
    score_cells,
    stored_ladder,
    with_ratios,
)

# Fixed values
UNDERPOWERED_N = 100
COMPARED = ["expected_cost", "auc_pr", "brier", "recall_at_10pct"]


def freeze_policy(validated: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Threshold of lowest validation cost per group."""
    best = best_threshold(confusion_by_threshold(validated, groups), groups)
    return best.select(*groups, "threshold", F.col("expected_cost").alias("validate_cost"))


def select_rung(policy: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rung of lowest validation cost per group; the first by name among equals."""
    return argmin(policy, groups, "validate_cost", ["rung"])


def at_policy(scored: DataFrame, policy: DataFrame, groups: Sequence[str]) -> DataFrame:
    """fn, fp, n of every group at its frozen threshold."""
    lines = stage(policy.select(*groups, "threshold"), "policy")
    return confusion(scored.join(lines, list(groups)), [*groups, "threshold"])


def frozen_from_cells(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """:func:`freeze_policy` of the cells of the validation rows."""
    best = best_threshold(grid_confusion(cells, groups), groups)
    return best.select(*groups, "threshold", F.col("expected_cost").alias("validate_cost"))


def holdout_metrics(
    scored: DataFrame, policy: DataFrame, groups: Sequence[str], key: Sequence[str], cells: DataFrame | None = None
) -> DataFrame:
    """All point metrics per group: cost at the frozen threshold, ranking metrics, recall at 10 %.

    Everything comes from one ladder of score cells. ``cells`` are those of ``scored`` where the caller has them; the
    rows themselves are then read for ties at the budget line only.
    """
    by = list(groups)
    ladder = stored_ladder(score_cells(scored, by) if cells is None else cells, by)
    lines = stage(policy.select(*by, "threshold"), "policy")
    costs = cell_confusion(ladder.join(lines, by), [*by, "threshold"]).select(*by, "threshold", cost().alias("expected_cost"))
    recall = recall_at_budgets(scored, by, key, [0.10], ladder=ladder).select(*by, F.col("recall").alias("recall_at_10pct"))
    return ranking_metrics(ladder, by).join(costs, by).join(recall, by)


def evaluation_report(scored: DataFrame, groups: Sequence[str], key: Sequence[str], budgets: Sequence[float]) -> DataFrame:
    """One row per group with every metric: cheapest threshold and its cost, ranking metrics, calibration error, recalls.

    Recall columns are named by the budget in percent. The rows are read twice whatever the number of metrics: for the
    cells, and for ties at budget lines. A NULL group is a group; groups of one class have NULL ranking metrics.
    """
    by = list(groups)
    cells = score_cells(scored, by)
    ladder = stored_ladder(cells, by)
    best = best_threshold(grid_confusion(cells, by), by).select(*by, "threshold", "expected_cost", "fn", "fp")
    calibrated = ece(cell_calibration(cells, by), by).select(*by, "ece")
    recall = recall_at_budgets(scored, by, key, budgets, ladder=ladder)
    shares = [F.max(F.when(F.col("budget") == b, F.col("recall"))).alias(f"recall_at_{b * 100:g}pct") for b in budgets]
    out = ranking_metrics(ladder, by)
    for part in (best, calibrated, recall.groupBy(*by).agg(*shares)):
        out = same_keys(out, part, by)
    return out


def slice_metrics(
    scored: DataFrame, threshold: float | str, slices: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """Metrics per value of each slice column; NULL is a slice of its own.

    ``gap_pct`` compares a slice's cost with that of all rows; the slices of one column add up to
    them, so the overall cost is a sum over a handful of slice rows. Slices of one class keep their
    cost and lose the ranking metrics. Rows collapse to cells of all slice columns first and only cells are turned
    into slices; rows are read again for ties at the budget line of a slice.
    """
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    rows = scored.select(*key, "y", "p", t.cast("double").alias("threshold"), *slices)
    by = ["slice", "value"]
    cells = score_cells(rows, ["threshold", *slices])
    sliced = unpivot_text(cells, ["threshold", "p", "n", "pos"], slices, *by)
    whole = Window.partitionBy("slice")
    sums = {c: F.sum(c).over(whole) for c in ("fn", "fp", "n")}
    overall = (F.lit(float(HEADLINE_RATIO)) * sums["fn"] + sums["fp"]) / sums["n"]
    costs = cell_confusion(sliced, by).select(*by, cost().alias("expected_cost"), overall.alias("overall_cost"))
    ladder = stored_ladder(sliced, by)
    ranked = ranking_metrics(ladder, by)
    long = unpivot_text(rows, [*key, "y", "p"], slices, *by)
    recall = recall_at_budgets(long, by, key, [0.10], ladder=ladder).select(*by, "recall")
    return (
        ranked.join(costs, by)
        .join(recall, by)
        .select(
            *by,
            "n",
            (F.col("n") < UNDERPOWERED_N).alias("underpowered"),
            "base_rate",
            "expected_cost",
            (safe_ratio(F.col("expected_cost") - F.col("overall_cost"), "overall_cost") * 100.0).alias("gap_pct"),
            "auc_pr",
            "auc_roc",
            "brier",
            F.when(F.col("auc_pr").isNotNull(), F.col("recall")).alias("recall_at_10pct"),
        )
    )


def improvement_pct(base: Column, value: Column) -> Column:
    return safe_ratio(base - value, base) * 100.0


def trivial_policies(conf: DataFrame, base: DataFrame, groups: Sequence[str], ratios=RATIOS) -> DataFrame:
    """Frozen model against flagging everyone and no one, for every cost ratio.

    ``conf`` has fn, fp, n at the frozen threshold, ``base`` the base rate, both one row per group.
    """
    rows = with_ratios(conf.join(base.select(*groups, "base_rate"), list(groups)), ratios)
    all_, none = 1.0 - F.col("base_rate"), F.col("ratio") * F.col("base_rate")
    model = cost("ratio")
    return rows.select(
        *groups,
        "ratio",
        all_.alias("cost_flag_all"),
        none.alias("cost_flag_none"),
        model.alias("cost_model"),
        (all_ - model).alias("improvement"),
        improvement_pct(all_, model).alias("improvement_pct"),
    )


def counterfactual_thresholds(
    scored: DataFrame, policy: DataFrame, groups: Sequence[str], ratios: Sequence[int] = RATIOS
) -> DataFrame:
    """Threshold re-optimised on the holdout per ratio beside the frozen one. For reading, not for use."""
    curve = cost_ratio_curve(confusion_by_threshold(scored, groups), groups, ratios)
    frozen = at_policy(scored, policy, groups)
    own = with_ratios(frozen, ratios).select(
        *groups, "ratio", F.col("threshold").alias("frozen_threshold"), cost("ratio").alias("cost_frozen")
    )
    return curve.withColumnsRenamed({"threshold": "cf_threshold", "expected_cost": "cost_cf"}).join(
        own, [*groups, "ratio"]
    )


def threshold_stability(scored: DataFrame, policy: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Frozen minus holdout-optimal threshold."""
    best = best_threshold(confusion_by_threshold(scored, groups), groups).select(
        *groups, F.col("threshold").alias("test_optimal")
    )
    return policy.select(*groups, F.col("threshold").alias("frozen")).join(best, list(groups)).withColumn(
        "gap", F.col("frozen") - F.col("test_optimal")
    )


def cutoff_comparison(metrics: DataFrame, selected: DataFrame, early: int, late: int) -> DataFrame:
    """Each metric at an early and a late cutoff, for the selected rungs and for each rung held fixed."""
    rows = metric_rows(metrics, ["cutoff", "rung"], COMPARED)
    chosen = rows.join(selected.select("cutoff", "rung"), ["cutoff", "rung"]).withColumn("basis", F.lit("selected"))
    fixed = rows.withColumn("basis", F.col("rung"))
    both = chosen.unionByName(fixed)
    wide = both.groupBy("basis", "metric").agg(
        F.max(F.when(F.col("cutoff") == early, F.col("value"))).alias("early_value"),
        F.max(F.when(F.col("cutoff") == late, F.col("value"))).alias("late_value"),
    )
    return wide.withColumn(
        "change_pct", safe_ratio(F.col("early_value") - F.col("late_value"), "late_value") * 100.0
    )


def validate_test_change(metrics: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Validation and holdout side by side: base rate, flag-all cost, model cost, AP, Brier."""
    rows = metric_rows(
        metrics.withColumn("flag_all_cost", 1.0 - F.col("base_rate")),
        [*groups, "split"],
        ["base_rate", "flag_all_cost", "expected_cost", "auc_pr", "brier"],
    )
    wide = rows.groupBy(*groups, "metric").agg(
        F.max(F.when(F.col("split") == "validate", F.col("value"))).alias("validate_value"),
        F.max(F.when(F.col("split") == "test", F.col("value"))).alias("test_value"),
    )
    moved = F.col("test_value") - F.col("validate_value")
    return wide.withColumn("change", moved).withColumn("change_pct", safe_ratio(moved, "validate_value") * 100.0)


def rung_cost_comparison(policy: DataFrame, first: str, second: str, tolerance: float = 0.0) -> DataFrame:
    """Validation cost of two rungs per cutoff, and which one is cheaper."""
    wide = policy.groupBy("cutoff").agg(
        F.max(F.when(F.col("rung") == first, F.col("validate_cost"))).alias("cost_first"),
        F.max(F.when(F.col("rung") == second, F.col("validate_cost"))).alias("cost_second"),
    )
    gap = F.col("cost_first") - F.col("cost_second")
    verdict = F.when(gap < -tolerance, "win").when(gap > tolerance, "lose").otherwise("tie")
    return wide.withColumn("difference", gap).withColumn("verdict", verdict)


def split_base_rates(rows: DataFrame, groups: Sequence[str], label: str = "y") -> DataFrame:
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("base_rate")
    )
