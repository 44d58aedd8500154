"""The point-in-time feature table: one row per cohort row, nothing dated on or after the cutoff."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranking import with_percent_rank
from cohortlens.functions.scalars import count_where, safe_ratio
from cohortlens.functions.session import stage
from cohortlens.operators.activity import BREADTH, VOLUME, at_cutoff, breadth_by_unit, half_ratio, volume_by_unit
from cohortlens.operators.cleaning import TableSet
from cohortlens.operators.cohort import GROUP, KEY, StudyDesign, cohorts, population
from cohortlens.operators.submissions import STATS, due_counts, evidence, submission_stats_by_unit, submissions_with_due

# Fixed values
NUMERIC_FEATURES = [
    "num_of_prev_attempts",
    "studied_credits",
    "total_clicks",
    "active_days",
    "clicks_last_7d",
    "mean_clicks_per_active_day",
    "days_registered_before_start",
    "days_since_last_activity",
    "click_slope_daily",
    "second_half_click_ratio",
    "longest_activity_gap",
    "distinct_activity_types",
    "distinct_materials",
    "assessment_material_share",
    "n_assessments_submitted",
    "mean_score_submitted",
    "min_score_submitted",
    "mean_submission_lateness",
    "n_due_not_submitted",
    "clicks_percentile",
    "score_percentile",
]
CATEGORICAL_FEATURES = [
    "gender",
    "region",
    "highest_education",
    "imd_band",
    "age_band",
    "disability",
    "code_module",
]
DEMOGRAPHIC = CATEGORICAL_FEATURES[:6] + NUMERIC_FEATURES[:2]
ASSESSMENT_TYPES = ["quiz", "externalquiz"]


def assembled_features(
    tables: TableSet,
    cohort: DataFrame,
    cutoffs: Sequence[int],
    assessment_types: Sequence[str] = ASSESSMENT_TYPES,
    key: Sequence[str] = KEY,
    group: Sequence[str] = GROUP,
) -> DataFrame:
    """Cohort rows with all features except the two cohort-relative percentiles.

    Four left joins on the key, whose right sides hold all cutoffs side by side, and one on the group; all right
    sides but the info are unique on their key, so the row count is that of the cohort.
    """
    # The log is read once, for one row per unit, day and item; both collapses start from there.
    early = tables.activity.where(F.col("date") < max(cutoffs)).groupBy(*key, "date", "id_site")
    log = stage(early.agg(F.sum("sum_click").alias("sum_click")), "activity")
    volume = volume_by_unit(log, key, cutoffs)
    range_ = breadth_by_unit(log, tables.sites, key, cutoffs, assessment_types)
    handed_in = submissions_with_due(tables.submissions, tables.assessments)
    work = submission_stats_by_unit(handed_in, key, cutoffs)
    due = due_counts(tables.assessments, group, cutoffs)
    kept = ["cutoff", *key, "not_completed", "split", "date_registration", *DEMOGRAPHIC]
    wide = (
        cohort.join(tables.info.select(*key, *DEMOGRAPHIC), list(key), "left")
        .join(volume, list(key), "left")
        .join(range_, list(key), "left")
        .join(work, list(key), "left")
        .select(*kept, *[at_cutoff(n, cutoffs).alias(n) for n in (*VOLUME, *BREADTH, *STATS)])
        .join(due, [*group, "cutoff"], "left")
    )
    zero = F.lit(0)
    total = F.coalesce(F.col("total_clicks"), zero).cast("bigint")
    days = F.coalesce(F.col("active_days"), zero).cast("bigint")
    return wide.select(
        "cutoff",
        *key,
        "not_completed",
        "split",
        *DEMOGRAPHIC,
        total.alias("total_clicks"),
        days.alias("active_days"),
        F.coalesce(F.col("clicks_last_7d"), zero).cast("bigint").alias("clicks_last_7d"),
        safe_ratio(total, days).alias("mean_clicks_per_active_day"),
        (zero - F.col("date_registration")).alias("days_registered_before_start"),
        (F.col("cutoff") - 1 - F.col("max_date")).alias("days_since_last_activity"),
        F.coalesce(F.col("click_slope_daily"), F.lit(0.0)).alias("click_slope_daily"),
        half_ratio("first_half_clicks", "second_half_clicks").alias("second_half_click_ratio"),
        "longest_activity_gap",
        F.coalesce(F.col("distinct_activity_types"), zero).cast("bigint").alias("distinct_activity_types"),
        F.coalesce(F.col("distinct_materials"), zero).cast("bigint").alias("distinct_materials"),
        safe_ratio(F.coalesce(F.col("assessment_clicks"), zero), total, 0.0).alias("assessment_material_share"),
        F.coalesce(F.col("n_assessments_submitted"), zero).cast("bigint").alias("n_assessments_submitted"),
        "mean_score_submitted",
        "min_score_submitted",
        "mean_submission_lateness",
        (F.coalesce(F.col("n_due"), zero) - F.coalesce(F.col("n_submitted_of_due"), zero))
        .cast("bigint")
        .alias("n_due_not_submitted"),
    )


def with_percentiles(assembled: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Rank of activity and of score among the cohort of the same group and cutoff."""
    by = ["cutoff", *group]
    ranked = stage(with_percent_rank(assembled, by, "total_clicks", "clicks_percentile"), "ranked")
    return with_percent_rank(ranked, by, "mean_score_submitted", "score_percentile")


def feature_table(
    tables: TableSet,
    design: StudyDesign,
    assessment_types: Sequence[str] = ASSESSMENT_TYPES,
) -> DataFrame:
    """Features of every cutoff. The assembled rows are written once, because the percentiles
    read them several times and the log behind them is the expensive part."""
    # The population and the demographic columns both come from the info.
    info = stage(tables.info, "info")
    tables = tables.replaced(info=info)
    cohort = cohorts(population(tables.registration, info), design)
    wide = assembled_features(tables, cohort, design.cutoffs, assessment_types)
    full = with_percentiles(stage(wide, "assembled"))
    return full.select(
        "cutoff",
        *KEY,
        "not_completed",
        "split",
        *[c for c in CATEGORICAL_FEATURES if c not in KEY],
        *NUMERIC_FEATURES,
    )


def row_count_check(features: DataFrame, cohort: DataFrame) -> DataFrame:
    """Feature and cohort rows per cutoff side by side."""
    f = features.groupBy("cutoff").agg(F.count(F.lit(1)).alias("feature_rows"))
    c = cohort.groupBy("cutoff").agg(F.count(F.lit(1)).alias("cohort_rows"))
    return c.join(f, "cutoff", "left").withColumn(
        "status", F.when(F.col("feature_rows") == F.col("cohort_rows"), "PASS").otherwise("FAIL")
    )


def leakage_sentinel(
    tables: TableSet, features: DataFrame, cutoffs: Sequence[int], key: Sequence[str] = KEY
) -> DataFrame:
    """Feature rows that raw rows before the cutoff cannot explain, per cutoff.

    ``max_event_day`` is the latest activity day that the recency feature implies, ``wrong_recency``,
    ``wrong_active_days`` and ``wrong_submissions`` count rows whose feature differs from what is recomputed
    from the raw log and hand-ins before the cutoff. A feature that has seen a later day differs. PASS when the implied
    day is before the cutoff and nothing differs.
    """

    def per_cutoff(rows: DataFrame, day: str, values: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
        before = {d: F.when(F.col(day) < d, F.col(day)) for d in cutoffs}
        wide = rows.groupBy(*key).agg(*[f(before[d]).alias(f"{n}{d}") for d in cutoffs for n, f in values.items()])
        lists = F.array(*[F.struct(F.lit(d).alias("cutoff"), *[F.col(f"{n}{d}").alias(n) for n in values]) for d in cutoffs])
        return wide.select(*key, F.explode(lists).alias("r")).select(*key, "r.*")

    days = tables.activity.select(*key, "date").distinct()
    events = per_cutoff(days, "date", {"last_event": F.max, "n_days": F.count})
    handed_in = submissions_with_due(tables.submissions, tables.assessments).where(evidence())
    works = per_cutoff(handed_in, "date_submitted", {"n_works": F.count})
    at = [*key, "cutoff"]
    seen = features.select(*at, "days_since_last_activity", "active_days", "n_assessments_submitted")
    joined = seen.join(events, at, "left").join(works, at, "left")
    implied = F.col("cutoff") - 1 - F.col("days_since_last_activity")
    none = F.lit(0)
    found = joined.groupBy("cutoff").agg(
        F.max(implied).alias("max_event_day"),
        count_where(~implied.eqNullSafe(F.col("last_event"))).alias("wrong_recency"),
        count_where(F.coalesce("active_days", none) != F.coalesce("n_days", none)).alias("wrong_active_days"),
        count_where(F.coalesce("n_assessments_submitted", none) != F.coalesce("n_works", none)).alias("wrong_submissions"),
    )
    clean = (F.col("wrong_recency") + F.col("wrong_active_days") + F.col("wrong_submissions") == 0) & (
        F.coalesce(F.col("max_event_day") < F.col("cutoff"), F.lit(True))
    )
    return found.withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))

