"""Assessment behaviour before a cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.session import stage
from cohortlens.operators.activity import per_cutoff, reaching

# Fixed values
EXAM = "Exam"


def evidence(kind: str | Column = "assessment_type", banked: str | Column = "is_banked") -> Column:
    """Work of this term: no exams, nothing carried over. An unknown kind does not pass."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    banked = F.col(banked) if isinstance(banked, str) else banked
    return (kind != EXAM) & (F.coalesce(banked, F.lit(0)) != 1)


def submissions_with_due(submissions: DataFrame, assessments: DataFrame) -> DataFrame:
    """Submissions with kind, group and due day of their assessment (left join).

    All submissions share a few assessments. The list is written out, so Spark knows its real size: a small
    one is broadcast, and only a large one, with its many keys, is dealt out by key.
    """
    meta = assessments.select(
        "id_assessment", "code_module", "code_presentation", "assessment_type", F.col("date").alias("due_date")
    )
    return submissions.join(stage(meta, "assessments"), "id_assessment", "left")


STATS = [
    "n_assessments_submitted",
    "mean_score_submitted",
    "min_score_submitted",
    "mean_submission_lateness",
    "n_submitted_of_due",
]


def submission_stats_by_unit(
    submitted: DataFrame, key: Sequence[str], cutoffs: Sequence[int], day: str = "date_submitted"
) -> DataFrame:
    """One row per key with the columns of :data:`STATS` for every cutoff, ``<name>_<cutoff>``."""
    rows = submitted.where(evidence() & (F.col(day) < max(cutoffs)))
    d, due, score, late = F.col(day), F.col("due_date"), F.col("score"), F.col(day) - F.col("due_date")

    def item_values(c: int) -> dict[str, Column]:
        seen = lambda x: F.when(d < c, x)
        return {
            "_n": F.count(seen(d)),
            "_score": F.sum(seen(score)),
            "_scored": F.count(seen(score)),
            "_low": F.min(seen(score)),
            "_late": F.sum(seen(late)),
            "_dated": F.count(seen(late)),
            "_due": F.max(seen(F.when(due < c, 1).otherwise(0))),
        }

    per_item = rows.groupBy(*key, "id_assessment").agg(*[v.alias(f"{n}_{c}") for c in cutoffs for n, v in item_values(c).items()])

    def values(c: int) -> list[Column]:
        return [
            F.sum(f"_n_{c}"),
            F.try_divide(F.sum(f"_score_{c}"), F.sum(f"_scored_{c}")),
            F.min(f"_low_{c}"),
            F.try_divide(F.sum(f"_late_{c}"), F.sum(f"_dated_{c}")),
            F.sum(f"_due_{c}"),
        ]

    return per_item.groupBy(*key).agg(*[v.alias(f"{n}_{c}") for c in cutoffs for n, v in zip(STATS, values(c))])


def submission_stats(
    submitted: DataFrame, key: Sequence[str], cutoffs: Sequence[int], day: str = "date_submitted"
) -> DataFrame:
    """Count, score and lateness per (key, cutoff) over evidence rows submitted before the cutoff.

    The count includes rows without a score, the score statistics do not. The last column counts
    distinct assessments that were due and submitted before the cutoff; it turns "due, not
    submitted" into a subtraction.
    """
    return per_cutoff(submission_stats_by_unit(submitted, key, cutoffs, day), key, cutoffs, STATS, STATS[0])


def due_counts(assessments: DataFrame, group: Sequence[str], cutoffs: Sequence[int]) -> DataFrame:
    """Number of non-exam assessments due before each cutoff, per group and cutoff; written out for its size."""
    rows = assessments.where(F.col("assessment_type") != EXAM)
    due = reaching(rows, "date", cutoffs).groupBy(*group, "cutoff").agg(F.count(F.lit(1)).alias("n_due"))
    return stage(due, "due")


def due_not_submitted(
    cohort: DataFrame, due: DataFrame, stats: DataFrame, key: Sequence[str], group: Sequence[str]
) -> DataFrame:
    """Assessments already due that a unit has not handed in, without listing unit x assessment pairs."""
    return (
        cohort.select("cutoff", *key)
        .join(stats.select(*key, "cutoff", "n_submitted_of_due"), [*key, "cutoff"], "left")
        .join(due, [*group, "cutoff"], "left")
        .select(
            "cutoff",
            *key,
            (
                F.coalesce(F.col("n_due"), F.lit(0)) - F.coalesce(F.col("n_submitted_of_due"), F.lit(0))
            ).alias("n_due_not_submitted"),
        )
    )
