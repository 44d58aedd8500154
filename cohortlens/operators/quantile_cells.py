"""Exact quantiles and histograms of many numeric features from two reads of the rows.

The first read is one aggregate of mergeable sketches, one per feature. A sketch gives an interval that a wanted quantile
lies in. The second read counts rows per feature: those inside an interval by their value, all others by the gap between
intervals that they lie in. Rows are combined before the shuffle, so what is written is the few values near quantiles and
one cell a gap, and quantiles and bins follow from it exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranking import exact_quantiles, running_counts, same_keys
from cohortlens.functions.scalars import count_where, unpivot_numeric
from cohortlens.functions.session import stage

#: A sketch errs by a ten-thousandth of the rows at most.
ACCURACY = 10_000
#: Shares of the rows by which an interval reaches beyond its quantile to either side; the first that is :data:`SLACK` rows
#: holds. Where none is, each value is a cell of its own.
MARGINS = (2.0 / ACCURACY, 0.01)
SLACK = 4


def _limits(df: DataFrame, by: Sequence[str], features: Sequence[str], fitted: Column, parts: int, margins: Sequence[float]) -> DataFrame:
    """(by.., limits): per feature lows and highs of the intervals, least and largest fitted value and how many there are."""
    steps = [i / parts for i in range(1, parts)]
    probs = [min(1.0, max(0.0, p + sign * m)) for m in margins for sign in (-1, 1) for p in steps]
    k = len(steps)

    def summary(f: str) -> Column:
        v = F.when(fitted, F.col(f).cast("double") + F.lit(0.0))
        sketch = F.percentile_approx(v, probs, ACCURACY) if margins else F.lit(None).cast("array<double>")
        return F.struct(sketch.alias("q"), F.min(v).alias("least"), F.max(v).alias("largest"), F.count(v).alias("n")).alias(f"_{f}")

    found = df.groupBy(*by).agg(*[summary(f) for f in features])

    def interval(f: str) -> Column:
        c = F.col(f"_{f}")
        lows, highs = F.array(F.lit(-float("inf"))), F.array(F.lit(float("inf")))
        for j, m in reversed(list(enumerate(margins))):
            enough = c["n"] * F.lit(m) >= SLACK
            lows = F.when(enough, F.slice(c["q"], 2 * j * k + 1, k)).otherwise(lows)
            highs = F.when(enough, F.slice(c["q"], (2 * j + 1) * k + 1, k)).otherwise(highs)
        return F.struct(F.lit(f).alias("feature"), lows.alias("lows"), highs.alias("highs"), *[c[x].alias(x) for x in ("least", "largest", "n")])

    return stage(found.select(*by, F.array(*[interval(f) for f in features]).alias("limits")), "limits")


def _cells(df: DataFrame, by: Sequence[str], features: Sequence[str], limits: DataFrame, counted: dict[str, Column], k: int) -> DataFrame:
    parts = [
        F.struct(F.lit(f).alias("feature"), (F.col(f).cast("double") + F.lit(0.0)).alias("value"), F.col("limits")[i]["lows"].alias("lows"), F.col("limits")[i]["highs"].alias("highs"))
        for i, f in enumerate(features)
    ]
    # One row per group of limits, whose real size Spark knows.
    placed = same_keys(df.select(*by, *features, *[c.alias(f"_{n}") for n, c in counted.items()]), limits, by)
    long = placed.select(*by, *[f"_{n}" for n in counted], F.explode(F.array(*parts)).alias("t")).select(*by, *[f"_{n}" for n in counted], "t.*")
    gap = F.expr(" + ".join(f"IF(value > get(highs, {i}), 1, 0)" for i in range(k)))
    gapped = long.withColumn("_gap", gap)
    at = F.when(F.get("lows", F.col("_gap")) <= F.col("value"), F.col("value"))
    return stage(
        gapped.groupBy(*by, "feature", F.when(F.col("value").isNotNull(), F.col("_gap")).alias("_gap"), at.alias("_at")).agg(
            F.min("value").alias("value"), *[count_where(F.col(f"_{n}")).alias(n) for n in counted]
        ),
        "quantile-cells",
    )


def quantile_cells(
    df: DataFrame, groups: Sequence[str], features: Sequence[str], fitted: Column, counted: dict[str, Column], parts: int
) -> tuple[DataFrame, DataFrame]:
    """(cells, edges) of each feature in each group.

    ``cells`` is (groups.., feature, value, one count per condition of ``counted``): rows with a NULL value are one cell, and
    all rows of a cell lie on the same side of every edge. ``edges`` is (groups.., feature, edges): least value, the
    ``parts`` quantiles between, and largest of the ``fitted`` rows, linearly interpolated and exact; a feature without a
    fitted value is left out. Should a sketch err by more than it promises, the intervals are widened and counted again.
    """
    by = list(groups) or ["_whole"]
    rows = df if groups else df.withColumn("_whole", F.lit(0))
    low, high = f"(i * (total - 1)) div {parts}", f"(i * (total - 1) + {parts - 1}) div {parts}"
    holds = "below <= {0} AND {0} < below + n"
    steps = ", ".join(f"{i}L" for i in range(1, parts))
    margins = list(MARGINS)
    while True:
        limits = _limits(rows, by, features, fitted, parts, margins)
        cells = _cells(rows, by, features, limits, {**counted, "_fitted": fitted}, max(1, parts - 1))
        own = {"n": F.col("_fitted"), "_exact": F.col("_at").isNotNull().cast("long")}
        ladder = running_counts(cells.where("_fitted > 0"), [*by, "feature"], "value", own)
        seen = ladder.selectExpr(*by, "feature", "value AS v", "n", "n_below AS below", "n_total AS total", "_exact").selectExpr(
            "*", f"explode(filter(array({steps}), i -> ({holds.format(low)}) OR ({holds.format(high)}))) AS i"
        )
        ends = seen.groupBy(*by, "feature", "i").agg(
            F.expr(f"max(CASE WHEN {holds.format(low)} THEN v END)").alias("lo"),
            F.expr(f"max(CASE WHEN {holds.format(high)} THEN v END)").alias("hi"),
            F.expr(f"max((i * (total - 1)) % {parts}) / {float(parts)}D").alias("w"),
            F.min("_exact").alias("exact"),
        )
        points = ends.groupBy(*by, "feature").agg(F.expr("array_sort(collect_list(struct(i, lo + (hi - lo) * w AS q)))").alias("p"), F.min("exact").alias("exact"))
        points = stage(points, "quantiles")
        if points.where("exact = 0").isEmpty():
            break
        margins = [10 * m for m in margins if 10 * m < 1.0]
    ends_of = limits.select(*by, F.explode("limits").alias("t")).where("t.n > 0").select(*by, "t.feature", "t.least", "t.largest")
    joined = same_keys(ends_of, points, [*by, "feature"])
    edges = F.concat(F.array("least"), F.transform("p", lambda t: t["q"]), F.array("largest"))
    return cells.select(*groups, "feature", "value", *counted), joined.select(*groups, "feature", edges.alias("edges"))


def medians(df: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(groups.., feature, median) of the present values, exact; a feature without a value is left out.

    Rows below an interval are counted in one aggregate of all features, and only values inside an interval become rows. Should a
    sketch err by more than it promises, all values are ordered.
    """
    by = list(groups) or ["_whole"]
    rows = df.select(*groups, *features) if groups else df.select(F.lit(0).alias("_whole"), *features)
    limits = _limits(rows, by, features, F.lit(True), 2, MARGINS)
    # One row per group of limits, whose real size Spark knows.
    placed = same_keys(rows, limits.select(*by, "limits"), by)
    parts = [(f, F.col(f).cast("double") + F.lit(0.0), F.col("limits")[i]["lows"][0], F.col("limits")[i]["highs"][0]) for i, f in enumerate(features)]
    sums = [
        F.struct(F.lit(f).alias("feature"), F.max(lo).alias("lo"), F.max(hi).alias("hi"), count_where(v < lo).alias("below"), count_where(v == lo).alias("n"), F.count(v).alias("total")).alias(f"_{i}")
        for i, (f, v, lo, hi) in enumerate(parts)
    ]
    wide = placed.groupBy(*by).agg(*sums).select(*by, F.explode(F.array(*[F.col(f"_{i}") for i in range(len(parts))])).alias("t"))
    seen = stage(wide.select(*by, "t.*").where("total > 0"), "below")
    values = F.array(*[F.struct(F.lit(f).alias("feature"), v.alias("value"), lo.alias("lo"), hi.alias("hi")) for f, v, lo, hi in parts])
    inside = F.filter(values, lambda t: (t["lo"] < t["hi"]) & (t["lo"] <= t["value"]) & (t["value"] <= t["hi"]))
    near = placed.select(*by, F.explode(inside).alias("t")).groupBy(*by, "t.feature", "t.value").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by, "feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = near.withColumn("_inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    several = same_keys(seen.where("lo < hi").drop("n"), ranked, [*by, "feature"]).selectExpr(*by, "feature", "value", "below + _inside AS below", "n", "total")
    cells = seen.where("lo = hi").selectExpr(*by, "feature", "lo AS value", "below", "n", "total").unionByName(several)
    holds = "max(CASE WHEN below <= ({0}) AND ({0}) < below + n THEN value END)"
    ends = cells.groupBy(*by, "feature").agg(F.expr(holds.format("(total - 1) div 2")).alias("first"), F.expr(holds.format("total div 2")).alias("last"))
    found = same_keys(seen.select(*by, "feature", "total"), ends, [*by, "feature"], "left").withColumn(
        "median", F.col("first") + (F.col("last") - F.col("first")) * ((F.col("total") - 1) % 2 / 2.0)
    )
    points = stage(found.select(*by, "feature", "median"), "medians")
    if not points.where("median IS NULL").isEmpty():
        long = unpivot_numeric(df, groups, features)
        return exact_quantiles(long, [*groups, "feature"], "value", [1], 2, "q").select(*groups, "feature", F.col("q")[0].alias("median"))
    return points.select(*groups, "feature", "median")
