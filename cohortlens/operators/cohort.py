"""Study population: target, temporal split, ordered exclusions and the diagnostics around them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import count_where, label_from, safe_ratio

# Fixed values
KEY = ["code_module", "code_presentation", "id_student"]
GROUP = ["code_module", "code_presentation"]
CUTOFFS = [14, 28, 56]
OUTCOMES = {1: ["Fail", "Withdrawn"], 0: ["Pass", "Distinction"]}
SPLITS = {"train": ["2013B", "2013J"], "validate": ["2014B"], "test": ["2014J"]}


@dataclass(frozen=True)
class StudyDesign:
    """What makes one dataset's cohort: outcome classes, split of presentations, cutoffs."""

    splits: Mapping[str, Sequence[str]] = field(default_factory=lambda: SPLITS)
    outcomes: Mapping[int, Sequence[str]] = field(default_factory=lambda: OUTCOMES)
    cutoffs: Sequence[int] = tuple(CUTOFFS)

    @property
    def presentations(self) -> list[str]:
        return [p for ps in self.splits.values() for p in ps]

    @property
    def results(self) -> list[str]:
        return [r for rs in self.outcomes.values() for r in rs]


def target_label(c: str | Column, outcomes=OUTCOMES, default: int | None = None) -> Column:
    return label_from(c, outcomes, default)


def split_label(c: str | Column, splits=SPLITS) -> Column:
    return label_from(c, splits)


def first_exclusion(cutoff: str | Column) -> Column:
    """First rule that removes a row, in the declared order; ``kept`` if none does.

    E3 no registration day, E2 registered after the cutoff, E1 left before the cutoff. A row
    registered on the cutoff day stays, and so does one that leaves on it.
    """
    reg, unreg, d = F.col("date_registration"), F.col("date_unregistration"), cutoff
    d = F.col(d) if isinstance(d, str) else d
    return (
        F.when(reg.isNull(), "E3")
        .when(reg > d, "E2")
        .when(unreg.isNotNull() & (unreg < d), "E1")
        .otherwise("kept")
    )


def population(registration: DataFrame, info: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Registration rows with their final result."""
    return registration.join(info.select(*key, "final_result"), list(key)).select(
        *key, "date_registration", "date_unregistration", "final_result"
    )


def with_cutoffs(df: DataFrame, cutoffs: Iterable[int]) -> DataFrame:
    """One copy of each row per cutoff day; rows are already one per unit, so this stays small."""
    return df.withColumn("cutoff", F.explode(F.array(*[F.lit(int(d)) for d in cutoffs])))


def exclusion_states(pop: DataFrame, cutoffs: Iterable[int]) -> DataFrame:
    return with_cutoffs(pop, cutoffs).withColumn("first_exclusion", first_exclusion("cutoff"))


def cohorts(pop: DataFrame, design: StudyDesign) -> DataFrame:
    """Cohort rows of every cutoff in one table with a ``cutoff`` column."""
    return (
        exclusion_states(pop, design.cutoffs)
        .where(F.col("first_exclusion") == "kept")
        .drop("first_exclusion")
        .withColumn("not_completed", target_label("final_result", design.outcomes))
        .withColumn("split", split_label("code_presentation", design.splits))
    )


def exclusion_waterfall(states: DataFrame, by: str = "code_presentation") -> DataFrame:
    """Start, removed per rule and remaining, per cutoff and group plus a TOTAL row, in one pass."""
    x = F.col("first_exclusion")
    return (
        states.groupingSets([["cutoff", by], ["cutoff"]], "cutoff", by)
        .agg(
            F.grouping(by).alias("_total"),
            F.count(F.lit(1)).alias("start_rows"),
            count_where(x == "E3").alias("removed_e3"),
            count_where(x == "E2").alias("removed_e2"),
            count_where(x == "E1").alias("removed_e1"),
            count_where(x == "kept").alias("remaining"),
        )
        .withColumn(by, F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(by)))
        .drop("_total")
    )


def exclusion_share(states: DataFrame, by: str = "code_presentation") -> DataFrame:
    """Share of the rows that enter the last rule and are removed by it."""
    x = F.col("first_exclusion")
    return (
        states.groupBy("cutoff", by)
        .agg(count_where(x.isin("E1", "kept")).alias("entering"), count_where(x == "E1").alias("removed"))
        .withColumn("share", safe_ratio("removed", "entering", 0.0))
    )


def base_rates(
    cohort: DataFrame, sets: Sequence[Sequence[str]], label: str = "not_completed"
) -> DataFrame:
    """Row count and mean label for several groupings at once; grouped-out columns are NULL.

    ``level`` names the grouping a row belongs to.
    """
    cols = list(dict.fromkeys(c for s in sets for c in s))
    named = None
    for s in sets:
        out_of = [F.grouping(c) == (0 if c in s else 1) for c in cols]
        cond = out_of[0]
        for o in out_of[1:]:
            cond = cond & o
        name = F.lit("+".join(s))
        named = F.when(cond, name) if named is None else named.when(cond, name)
    return cohort.groupingSets([list(s) for s in sets], *cols).agg(
        named.alias("level"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col(label).cast("double")).alias("base_rate"),
    )


def result_by_null_state(pop: DataFrame) -> DataFrame:
    """Final result against whether an unregistration day exists, before any exclusion."""
    state = F.when(F.col("date_unregistration").isNull(), "NULL").otherwise("NOT NULL")
    return pop.groupBy("final_result", state.alias("unreg_state")).agg(F.count(F.lit(1)).alias("n_rows"))


def withdrawal_conflicts(pop: DataFrame, withdrawn: str = "Withdrawn") -> DataFrame:
    left = F.col("date_unregistration").isNotNull()
    is_w = F.col("final_result") == withdrawn
    return pop.agg(
        count_where(is_w & ~left).alias("withdrawn_without_day"),
        count_where(~is_w & left).alias("day_without_withdrawal"),
    )


def zero_activity_summary(cohort: DataFrame, first_day: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows without any activity before their cutoff, with the base rate of both groups.

    ``first_day`` holds one row per unit (key, first_active_day): a unit was active before any
    cutoff exactly when its first day is.
    """
    silent = F.coalesce(F.col("first_active_day") >= F.col("cutoff"), F.lit(True))
    y = F.col("not_completed").cast("double")
    return (
        cohort.join(first_day, list(key), "left")
        .groupBy("cutoff")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            count_where(silent).alias("zero_rows"),
            F.avg(F.when(silent, y)).alias("base_rate_zero"),
            F.avg(F.when(~silent, y)).alias("base_rate_rest"),
        )
        .withColumn("zero_share", safe_ratio("zero_rows", "total_rows", 0.0))
    )


def flagged_rows(df: DataFrame, cond: Column, unit: str) -> DataFrame:
    """Rows and distinct units that carry a flag."""
    return df.where(cond).agg(
        F.count(F.lit(1)).alias("flagged_rows"), F.countDistinct(unit).alias("flagged_units")
    )


def first_due(assessments: DataFrame, kind: str, group: Sequence[str] = GROUP) -> DataFrame:
    """Earliest due day and number of assessments of one kind per group."""
    return (
        assessments.where(F.col("assessment_type") == kind)
        .groupBy(*group)
        .agg(F.min("date").alias("earliest_due"), F.count(F.lit(1)).alias("n_assessments"))
    )


def groups_without(courses: DataFrame, present: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    return courses.select(*group).distinct().join(present.select(*group), list(group), "left_anti")
