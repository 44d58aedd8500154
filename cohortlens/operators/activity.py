"""Activity features of a click log for many cutoffs in one pass.

The log is read once. It is reduced to one row per (unit, day) and one row per (unit, item) with
partial aggregation, so a unit that owns a large share of the log still contributes at most one
row per day and item to a shuffle partition. All cutoffs are conditional sums over these rows, side by
side in one row per unit (``*_by_unit``); rows are copied per cutoff only after that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hot_join import hot_join
from cohortlens.functions.scalars import safe_ratio
from cohortlens.functions.session import stage

LAST_DAYS = 7


def before(df: DataFrame, day: str, cutoff: int) -> DataFrame:
    """Rows strictly before the cutoff day. Plain comparison, so it reaches the Parquet scan."""
    return df.where(F.col(day) < F.lit(cutoff))


def daily_totals(log: DataFrame, key: Sequence[str], day: str, amount: str) -> DataFrame:
    return log.groupBy(*key, day).agg(F.sum(amount).alias("day_total"), F.count(F.lit(1)).alias("day_rows"))


def reaching(df: DataFrame, day: str, cutoffs: Sequence[int]) -> DataFrame:
    """One copy of a row for every cutoff it lies before, in column ``cutoff``.

    Applied after the rows were collapsed, so the copies never multiply the log itself.
    """
    later = F.filter(F.array(*[F.lit(int(c)) for c in cutoffs]), lambda c: c > F.col(day))
    return df.withColumn("cutoff", F.explode(later))


def per_cutoff(wide: DataFrame, key: Sequence[str], cutoffs: Sequence[int], names: Sequence[str], seen: str) -> DataFrame:
    """(key.., cutoff, names..) from columns ``<name>_<cutoff>``; only rows whose count ``seen`` is not zero."""
    rows = [F.struct(F.lit(int(c)).alias("cutoff"), *[F.col(f"{n}_{c}").alias(n) for n in names]) for c in cutoffs]
    return wide.select(*key, F.explode(F.array(*rows)).alias("_at")).select(*key, "_at.*").where(F.col(seen) > 0)


def at_cutoff(name: str, cutoffs: Sequence[int]) -> Column:
    """Value of ``name`` at the cutoff of the row, from columns ``<name>_<cutoff>``."""
    return F.coalesce(*[F.when(F.col("cutoff") == c, F.col(f"{name}_{c}")) for c in cutoffs])


def zero_filled_slope(day: Column, total: Column, cutoff: int | Column) -> Column:
    """Least-squares slope over days 0..cutoff-1 where a day without rows counts as zero.

    Zero days add nothing to the sums, and the sums over the day axis are known, so no
    (unit x day) grid is needed. ``cutoff`` may be a grouping column.
    """
    c = (F.lit(cutoff) if isinstance(cutoff, int) else cutoff).cast("double")
    y = F.when((day >= 0) & (day < c), total)
    sum_y = F.coalesce(F.sum(y), F.lit(0)).cast("double")
    sum_xy = F.coalesce(F.sum(y * day), F.lit(0)).cast("double")
    spread = c * (c * c - 1.0) / 12.0
    return F.when(c > 1, (sum_xy - (c - 1.0) / 2.0 * sum_y) / spread)


VOLUME = [
    "total_clicks",
    "active_days",
    "clicks_last_7d",
    "max_date",
    "first_half_clicks",
    "second_half_clicks",
    "click_slope_daily",
    "longest_activity_gap",
]


def volume_by_unit(
    log: DataFrame,
    key: Sequence[str],
    cutoffs: Sequence[int],
    day: str = "date",
    amount: str = "sum_click",
) -> DataFrame:
    """One row per key with the columns of :data:`VOLUME` for every cutoff, ``<name>_<cutoff>``.

    The gap window and the aggregate share one exchange on the key.
    """
    days = daily_totals(before(log, day, max(cutoffs)), key, day, amount)
    order = Window.partitionBy(*key).orderBy(day)
    stepped = days.withColumn("_gap", F.col(day) - F.lag(day).over(order))
    d = F.col(day)

    def values(c: int) -> list[Column]:
        total, half = F.when(d < c, F.col("day_total")), c // 2
        return [
            F.sum(total),
            F.count(F.when(d < c, 1)),
            F.sum(F.when(d >= c - LAST_DAYS, total)),
            F.max(F.when(d < c, d)),
            F.sum(F.when((d >= 0) & (d < half), total)),
            F.sum(F.when(d >= half, total)),
            zero_filled_slope(d, total, c),
            F.max(F.when(d < c, F.col("_gap"))),
        ]

    return stepped.groupBy(*key).agg(*[v.alias(f"{n}_{c}") for c in cutoffs for n, v in zip(VOLUME, values(c))])


def volume_and_trajectory(
    log: DataFrame,
    key: Sequence[str],
    cutoffs: Sequence[int],
    day: str = "date",
    amount: str = "sum_click",
) -> DataFrame:
    """Totals, active days, recency, half sums, slope and longest gap per (key, cutoff).

    Only pairs with activity before the cutoff get a row.
    """
    return per_cutoff(volume_by_unit(log, key, cutoffs, day, amount), key, cutoffs, VOLUME, "active_days")


def densified_days(units: DataFrame, daily: DataFrame, key: Sequence[str], day: str, cutoff: int) -> DataFrame:
    """One row per unit and day 0..cutoff-1, missing days as zero. For inspection of daily series."""
    grid = units.withColumn(day, F.explode(F.sequence(F.lit(0), F.lit(cutoff - 1))))
    return grid.join(daily, [*key, day], "left").withColumn(
        "day_total", F.coalesce(F.col("day_total"), F.lit(0))
    )


def slope_from_series(series: DataFrame, key: Sequence[str], day: str) -> DataFrame:
    return series.groupBy(*key).agg(F.regr_slope(F.col("day_total"), F.col(day)).alias("click_slope_daily"))


BREADTH = ["distinct_activity_types", "distinct_materials", "assessment_clicks"]


def breadth_by_unit(
    log: DataFrame,
    items: DataFrame,
    key: Sequence[str],
    cutoffs: Sequence[int],
    assessment_types: Sequence[str],
    item: str = "id_site",
    kind: str = "activity_type",
    day: str = "date",
    amount: str = "sum_click",
) -> DataFrame:
    """One row per key with the columns of :data:`BREADTH` for every cutoff, ``<name>_<cutoff>``.

    The log is collapsed to one row per (key, item) first; an item counts at a cutoff when its
    first day is before it, so no distinct count is left. ``items`` holds one row per item.
    """
    d = F.col(day)
    touched = before(log, day, max(cutoffs)).groupBy(*key, item).agg(
        F.min(d).alias("_first"),
        *[F.sum(F.when(d < c, F.col(amount))).alias(f"_sum_{c}") for c in cutoffs],
    )
    # An item that every unit opens is one key with a row per unit.
    typed = hot_join(stage(touched, "touched"), stage(items.select(item, kind), "items"), [item], "left")
    per_type = typed.groupBy(*key, kind).agg(
        *[F.count(F.when(F.col("_first") < c, 1)).alias(f"_items_{c}") for c in cutoffs],
        *[F.sum(f"_sum_{c}").alias(f"_amount_{c}") for c in cutoffs],
    )

    def values(c: int) -> list[Column]:
        assessed = F.when(F.col(kind).isin(list(assessment_types)), F.col(f"_amount_{c}"))
        return [
            F.count(F.when(F.col(f"_items_{c}") > 0, F.col(kind))),
            F.sum(f"_items_{c}"),
            F.coalesce(F.sum(assessed), F.lit(0)),
        ]

    return per_type.groupBy(*key).agg(*[v.alias(f"{n}_{c}") for c in cutoffs for n, v in zip(BREADTH, values(c))])


def breadth(
    log: DataFrame,
    items: DataFrame,
    key: Sequence[str],
    cutoffs: Sequence[int],
    assessment_types: Sequence[str],
    item: str = "id_site",
    kind: str = "activity_type",
    day: str = "date",
    amount: str = "sum_click",
) -> DataFrame:
    """Distinct items and types touched and the volume on assessment types per (key, cutoff) with activity before it."""
    wide = breadth_by_unit(log, items, key, cutoffs, assessment_types, item, kind, day, amount)
    return per_cutoff(wide, key, cutoffs, BREADTH, "distinct_materials")


def first_active_day(log: DataFrame, key: Sequence[str], day: str = "date") -> DataFrame:
    return log.groupBy(*key).agg(F.min(day).alias("first_active_day"))


def half_ratio(first: str | Column, second: str | Column) -> Column:
    """Second half over first half; NULL when the first half is empty."""
    second = F.col(second) if isinstance(second, str) else second
    return safe_ratio(F.coalesce(second, F.lit(0)), first)
