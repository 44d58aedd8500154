"""Regression discontinuity from aggregates.

Rows are collapsed to cells per value of the running variable. Every estimate, whatever its
bandwidth or cutoff, is then a handful of weighted sums over the cells and a closed-form solve,
written as column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from cohortlens.functions.normal import detection_multiplier, two_sided_p
from cohortlens.functions.ranking import same_keys
from cohortlens.functions.scalars import count_where, safe_ratio, unpivot_numeric, unpivot_text
from cohortlens.functions.session import stage
from cohortlens.operators.ordering import first_row

# Fixed values
PASS_MARK = 40.0
PRIMARY_BANDWIDTH = 10.0
BANDWIDTHS = [5.0, 8.0, 10.0, 15.0, 20.0]
PLACEBO_CUTOFFS = [30.0, 50.0, 60.0]
DONUT_RADIUS = 1.0
ALPHA = 0.05
POWER = 0.80
HEAPING_STEP = 5
Z95 = 1.959963984540054
DENSITY_CONSTANT = 24.0 / 5.0
ROUNDING = 1e-9


def first_assessments(assessments: DataFrame, kind: str, group: Sequence[str]) -> DataFrame:
    """Earliest assessment of one kind per group; a missing due day sorts last, then the id decides."""
    rows = assessments.where(F.col("assessment_type") == kind)
    return first_row(rows, group, ["date", "id_assessment"], ["weight"]).withColumnRenamed("date", "due_date")


def submission_states(first: DataFrame, submissions: DataFrame) -> DataFrame:
    """Submissions to the first assessments with the first reason that removes them."""
    state = F.when(F.col("score").isNull(), "null score").when(F.col("is_banked") == 1, "banked").otherwise("retained")
    return first.join(submissions, "id_assessment").withColumn("state", state)


def rd_population(first: DataFrame, submissions: DataFrame, info: DataFrame, key: Sequence[str], failed: Sequence[str]) -> DataFrame:
    """Scored, not carried-over submissions to the first assessment with the unit's attributes."""
    rows = first.join(submissions.where(F.col("score").isNotNull() & (F.col("is_banked") == 0)), "id_assessment")
    y = F.when(F.col("final_result").isin(list(failed)), 1).otherwise(0)
    return rows.join(info, list(key)).withColumn("not_completed", y)


def donut(df: DataFrame, x: str, cutoff: float, radius: float = DONUT_RADIUS) -> DataFrame:
    """Rows farther than ``radius`` from the cutoff."""
    return df.where(F.abs(F.col(x) - F.lit(cutoff)) > radius)


def cells(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per value of the running variable: n, sum of y and of its square, y less the group's mean.

    A jump does not change when a constant is taken off y, but sums of squares around a large mean would lose
    every digit of the residuals. Each cell's spread is summed around its own mean first.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_y", F.col(y).cast("double"))
    return _centred(rows.groupBy(*groups, F.col(x).cast("double").alias("x")), "_y", groups)


def _centred(grouped: GroupedData, y: str, groups: Sequence[str]) -> DataFrame:
    cell = stage(
        grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("_mean"), F.var_pop(y).alias("_spread")), "rd-cells"
    )
    mean = (F.sum(F.col("n") * F.col("_mean")) / F.sum("n")).alias("_centre")
    if groups:
        placed = same_keys(cell, cell.groupBy(*groups).agg(mean), list(groups))
    else:
        placed = cell.withColumn("_centre", F.lit(cell.agg(mean).first()[0]).cast("double"))
    off = F.col("_mean") - F.col("_centre")
    return placed.withColumns({"sy": F.col("n") * off, "syy": F.col("n") * (F.col("_spread") + off * off)}).drop(
        "_mean", "_spread", "_centre"
    )


def with_specs(cell: DataFrame, cutoffs: Sequence[float], bandwidths: Sequence[float]) -> DataFrame:
    """Cells once per (cutoff, bandwidth) whose window they fall into, centred and weighted."""
    specs = F.array(
        *[
            F.struct(F.lit(float(c)).alias("cutoff"), F.lit(float(h)).alias("bandwidth"))
            for c in cutoffs
            for h in bandwidths
        ]
    )
    inside = F.filter(specs, lambda s: F.abs(F.col("x") - s["cutoff"]) < s["bandwidth"])
    at = cell.withColumn("_s", F.explode(inside)).select("*", "_s.cutoff", "_s.bandwidth").drop("_s")
    d = F.col("x") - F.col("cutoff")
    u = d / F.col("bandwidth")
    return at.withColumn("u", u).withColumn("w", 1.0 - F.abs(u)).withColumn(
        "side", F.when(d < 0, "left").otherwise("right")
    )


def moments(weighted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every sum the estimates need, per specification and side, in one aggregate.

    s, t: kernel-weighted powers of the centred variable alone and times y. a, b, c: the same with
    squared weights for n, y and y squared; residual variances follow from them without a second
    pass. The variable is centred and divided by the bandwidth, so powers stay below one.
    """
    w, u, n = F.col("w"), F.col("u"), F.col("n").cast("double")

    def powers(name: str, weight: Column, upto: int) -> list[Column]:
        return [F.sum(weight * F.pow(u, F.lit(float(k)))).alias(f"{name}{k}") for k in range(upto + 1)]

    return weighted.groupBy(*by, "cutoff", "bandwidth", "side").agg(
        F.sum("n").alias("n_side"),
        *powers("s", w * n, 4),
        *powers("t", w * F.col("sy"), 2),
        *powers("a", w * w * n, 8),
        *powers("b", w * w * F.col("sy"), 6),
        *powers("c", w * w * F.col("syy"), 4),
    )


def _terms(name: str, upto: int) -> list[Column]:
    return [F.col(f"{name}{k}") for k in range(upto + 1)]


def _product(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    out: list[Column | None] = [None] * (len(p) + len(q) - 1)
    for i, x in enumerate(p):
        for j, y in enumerate(q):
            out[i + j] = x * y if out[i + j] is None else out[i + j] + x * y
    return out


def _dot(poly: Sequence[Column], sums: Sequence[Column]) -> Column:
    total = poly[0] * sums[0]
    for x, y in zip(poly[1:], sums[1:]):
        total = total + x * y
    return total


def _sandwich(pull: Sequence[Column], fit: Sequence[Column]) -> Column:
    """Sum of squared pull times squared residual, expanded into the stored sums.

    Below zero it can only be by rounding, in a fit without residuals; anything more is an error.
    """
    pull2 = _product(pull, pull)
    whole = _dot(pull2, _terms("c", 4))
    total = (
        whole
        - 2.0 * _dot(_product(pull2, fit), _terms("b", 6))
        + _dot(_product(pull2, _product(fit, fit)), _terms("a", 8))
    )
    lost = F.raise_error(F.lit("residual variance lost to rounding")).cast("double")
    return F.when(total >= 0.0, total).when(total >= -ROUNDING * F.abs(whole), 0.0).when(total.isNotNull(), lost)


def fits(m: DataFrame) -> DataFrame:
    """Weighted line and quadratic per side: limits at the cutoff and their HC0 variances.

    NULL where a side has too few distinct values for the fit.
    """
    s, t = _terms("s", 4), _terms("t", 2)
    det = s[0] * s[2] - s[1] * s[1]
    m = m.withColumn("_det", F.when(det > 1e-9 * s[0] * s[2], det))
    m = m.withColumns(
        {
            "_p0": s[2] / F.col("_det"),
            "_p1": -s[1] / F.col("_det"),
            "_slope": (s[0] * t[1] - s[1] * t[0]) / F.col("_det"),
        }
    ).withColumn("level", F.col("_p0") * t[0] + F.col("_p1") * t[1])
    # Cofactors of the symmetric 3x3 moment matrix; each row of the inverse gives one coefficient.
    cof = {
        (0, 0): s[2] * s[4] - s[3] * s[3],
        (0, 1): s[2] * s[3] - s[1] * s[4],
        (0, 2): s[1] * s[3] - s[2] * s[2],
        (1, 1): s[0] * s[4] - s[2] * s[2],
        (1, 2): s[1] * s[2] - s[0] * s[3],
        (2, 2): s[0] * s[2] - s[1] * s[1],
    }
    det3 = s[0] * cof[0, 0] + s[1] * cof[0, 1] + s[2] * cof[0, 2]
    m = m.withColumn("_det3", F.when(det3 > 1e-12 * s[0] * s[2] * s[4], det3))
    m = m.withColumns({f"_i{i}{j}": c / F.col("_det3") for (i, j), c in cof.items()})
    inv = {(i, j): F.col(f"_i{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    m = m.withColumns({f"_q{i}": inv[i, 0] * t[0] + inv[i, 1] * t[1] + inv[i, 2] * t[2] for i in range(3)})
    line = _sandwich([F.col("_p0"), F.col("_p1")], [F.col("level"), F.col("_slope")])
    quad = _sandwich([inv[0, k] for k in range(3)], [F.col(f"_q{k}") for k in range(3)])
    return m.withColumns({"level_var": line, "q_level_var": quad}).withColumn("q_level", F.col("_q0"))


def estimates(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Jump at the cutoff (right limit minus left) per specification.

    ``estimate`` is the local linear jump, ``bias_corrected`` the local quadratic one at the same
    bandwidth, which is the linear jump less its leading bias. Errors are HC0; other estimators'
    default variances differ.
    """
    sides = fits(m)
    value = ["n_side", "level", "level_var", "q_level", "q_level_var"]
    wide = sides.groupBy(*by, "cutoff", "bandwidth").agg(
        *[F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}_{side}") for side in ("left", "right") for c in value]
    )
    gap = {c: F.col(f"{c}_right") - F.col(f"{c}_left") for c in ("level", "q_level")}
    var = {c: F.col(f"{c}_right") + F.col(f"{c}_left") for c in ("level_var", "q_level_var")}
    return wide.select(
        *by,
        "cutoff",
        "bandwidth",
        F.coalesce(F.col("n_side_left"), F.lit(0)).alias("n_left"),
        F.coalesce(F.col("n_side_right"), F.lit(0)).alias("n_right"),
        gap["level"].alias("estimate"),
        F.sqrt(var["level_var"]).alias("se"),
        gap["q_level"].alias("bias_corrected"),
        F.sqrt(var["q_level_var"]).alias("robust_se"),
    )


def inference(est: DataFrame) -> DataFrame:
    """Robust interval and both p-values beside the estimates."""
    return (
        est.withColumn("ci_lo", F.col("bias_corrected") - Z95 * F.col("robust_se"))
        .withColumn("ci_hi", F.col("bias_corrected") + Z95 * F.col("robust_se"))
        .withColumn("p_conventional", two_sided_p(F.try_divide(F.col("estimate"), F.col("se"))))
        .withColumn("p_robust", two_sided_p(F.try_divide(F.col("bias_corrected"), F.col("robust_se"))))
    )


def jump_table(
    df: DataFrame, x: str, y: str, cutoffs: Sequence[float], bandwidths: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Estimates for all cutoffs and bandwidths from one pass over the rows."""
    weighted = with_specs(cells(df, x, y, groups), cutoffs, bandwidths)
    return estimates(moments(weighted, groups), groups)


def donut_table(df: DataFrame, x: str, y: str, cutoff: float, bandwidths: Sequence[float], radius=DONUT_RADIUS) -> DataFrame:
    """Estimates without the rows next to the cutoff, with how many were dropped and kept."""
    est = jump_table(donut(df, x, cutoff, radius), x, y, [cutoff], bandwidths)
    far = F.abs(F.col(x) - F.lit(cutoff)) > radius
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        count_where(~far).alias("rows_dropped"), count_where(far).alias("rows_kept")
    ).withColumn("cutoff", F.explode(F.array(F.lit(float(cutoff)))))
    return est.join(counts, "cutoff")


def covariate_moments(
    df: DataFrame, x: str, numeric: Sequence[str], categorical: Sequence[str], cutoff: float, bandwidth: float
) -> DataFrame:
    """Sums for every covariate as outcome: numeric ones as they are, each category level as 0/1.

    A level has rows only where it occurs; its zeros enter through the sums of all rows, so no
    indicator is ever spread over the rows.
    """
    rows = df.withColumn("x", F.col(x).cast("double"))
    near = rows.where(F.abs(F.col("x") - F.lit(cutoff)) < bandwidth)
    at = ["cutoff", "bandwidth", "side"]
    by = ["covariate", "level_name"]
    parts = []
    if numeric:
        v = F.col("v")
        long = unpivot_numeric(near, ["x"], numeric, "covariate", "v").where(v.isNotNull())
        cell = _centred(long.groupBy("covariate", F.lit("").alias("level_name"), "x"), "v", by)
        parts.append(moments(with_specs(cell, [cutoff], [bandwidth]), by))
    if categorical:
        one = near.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        zero = F.lit(0.0)
        all_rows = moments(with_specs(one.withColumn("sy", zero).withColumn("syy", zero), [cutoff], [bandwidth]))
        hit = unpivot_text(near, ["x"], categorical, "covariate", "level_name").groupBy(*by, "x").agg(
            F.count(F.lit(1)).alias("n")
        )
        hit = hit.withColumn("sy", F.col("n").cast("double")).withColumn("syy", F.col("n").cast("double"))
        hits = moments(with_specs(hit, [cutoff], [bandwidth]), by)
        levels = unpivot_text(rows, [], categorical, "covariate", "level_name").distinct()
        axis = levels.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
        own = [*[f"t{k}" for k in range(3)], *[f"b{k}" for k in range(7)], *[f"c{k}" for k in range(5)]]
        full = axis.join(all_rows.drop(*own), "side").join(hits.select(*by, *at, *own), [*by, *at], "left")
        parts.append(full.fillna(0.0, own).select(*by, *at, "n_side", *[f"s{k}" for k in range(5)], *own, *[f"a{k}" for k in range(9)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def covariate_balance(
    df: DataFrame, x: str, numeric: Sequence[str], categorical: Sequence[str], cutoff: float, bandwidth: float
) -> DataFrame:
    """The same jump with each pre-determined characteristic as outcome."""
    by = ["covariate", "level_name"]
    return estimates(covariate_moments(df, x, numeric, categorical, cutoff, bandwidth), by)


def rejections(balance: DataFrame, alpha: float = ALPHA) -> DataFrame:
    tested = inference(balance)
    return tested.agg(
        F.count("p_robust").alias("n_tests"), count_where(F.col("p_robust") < alpha).alias("n_rejected")
    )


def density_test(df: DataFrame, x: str, cutoff: float, bandwidth: float, binsize: float = 1.0, groups: Sequence[str] = ()) -> DataFrame:
    """Jump in the density of ``x`` at the cutoff: log difference of two weighted line limits.

    Bins are anchored at the cutoff, so none straddles it; empty bins between the smallest and
    largest value count as zero heights; the last bin is closed on the right.
    """
    by = list(groups) or ["_all"]
    rows = df if groups else df.withColumn("_all", F.lit(1))
    rows = rows.where(F.col(x).isNotNull()).select(
        *by, ((F.col(x).cast("double") - F.lit(float(cutoff))) / F.lit(float(binsize))).alias("z")
    )
    cell = rows.groupBy(*by, F.floor("z").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("hi"))
    ends = cell.groupBy(*by).agg(
        F.sum("n").alias("total"), F.min("bin").alias("first_bin"), (F.ceil(F.max("hi")) - 1).alias("last_bin")
    )
    last = F.greatest(F.col("last_bin"), F.col("first_bin"))
    reach = int(bandwidth / binsize) + 1
    axis = ends.withColumn(
        "bin",
        F.explode(F.sequence(F.greatest(F.col("first_bin"), F.lit(-reach)), F.least(last, F.lit(reach))))
    )
    counted = cell.join(ends.select(*by, last.alias("_last")), by).withColumn("bin", F.least("bin", "_last"))
    counted = counted.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    mid = (F.col("bin") + 0.5) * binsize
    heights = axis.join(counted, [*by, "bin"], "left").select(
        *by,
        "total",
        mid.alias("x"),
        F.lit(1).cast("bigint").alias("n"),
        (F.coalesce(F.col("n"), F.lit(0)) / (F.col("total") * binsize)).alias("sy"),
        F.lit(0.0).alias("syy"),
    )
    sides = fits(moments(with_specs(heights, [0.0], [bandwidth]), [*by, "total"]))
    wide = sides.groupBy(*by, "total").agg(
        F.max(F.when(F.col("side") == "left", F.col("level"))).alias("f_left"),
        F.max(F.when(F.col("side") == "right", F.col("level"))).alias("f_right"),
    )
    good = (F.col("f_left") > 0) & (F.col("f_right") > 0)
    theta = F.when(good, F.ln("f_right") - F.ln("f_left"))
    variance = DENSITY_CONSTANT / (F.col("total") * bandwidth) * (1.0 / F.col("f_right") + 1.0 / F.col("f_left"))
    se = F.when(good, F.sqrt(variance))
    return wide.select(
        *groups, F.col("total").alias("n"), "f_left", "f_right", theta.alias("theta"), se.alias("se"), (theta / se).alias("z")
    )


def score_histogram(df: DataFrame, x: str, low: int, high: int) -> DataFrame:
    """Frequency of every integer value in a range, zeros included."""
    inside = df.where((F.col(x) >= low) & (F.col(x) <= high) & (F.col(x) == F.floor(F.col(x))))
    counts = inside.groupBy(F.col(x).cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    axis = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "value")
    return axis.join(counts, "value", "left").fillna(0, ["n"])


def heaping_ratio(histogram: DataFrame, step: int = HEAPING_STEP) -> DataFrame:
    """Count at each multiple of ``step`` over the mean of its neighbours inside the listed range."""
    order = Window.orderBy("value")
    near = F.array_compact(F.array(F.lag("n").over(order), F.lead("n").over(order)))
    mean = F.aggregate(near, F.lit(0).cast("bigint"), lambda a, v: a + v) / F.size(near)
    return (
        histogram.withColumn("neighbour_mean", mean)
        .where(F.col("value") % step == 0)
        .withColumn("ratio", safe_ratio("n", "neighbour_mean"))
    )


def population_rates(pop: DataFrame, by: str, unit: str, x: str, label: str = "not_completed") -> DataFrame:
    """Rows, distinct units, outcome rate and score range overall (TOTAL) and per group.

    Units are collapsed first, so the distinct count needs no second copy of the rows.
    """
    y = F.col(label).cast("double")
    per_unit = pop.groupBy(by, unit).agg(
        F.count(F.lit(1)).alias("c"), F.sum(y).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )
    kinds = per_unit.rollup(by).agg(
        F.grouping(by).alias("_total"),
        F.sum("c").alias("n_rows"),
        F.countDistinct(unit).alias("n_units"),
        (F.sum("s") / F.sum("c")).alias("base_rate"),
        F.min("lo").alias("min_x"),
        F.max("hi").alias("max_x"),
    )
    return kinds.withColumn(by, F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(by))).drop("_total")


def power_curve(rates: DataFrame, groups: Sequence[str], effects: Sequence[int] = range(1, 11), alpha=ALPHA, power=POWER) -> DataFrame:
    """Rows needed per arm to see a reduction of 1..10 points from each group's own rate.

    ``rates`` has one row per group with ``base_rate``. NULL when the reduced rate is not a rate.
    """
    z = detection_multiplier(alpha, power)
    rows = rates.select(*groups, "base_rate").withColumn(
        "effect_points", F.explode(F.array(*[F.lit(int(e)) for e in effects]))
    )
    p1, delta = F.col("base_rate"), F.col("effect_points") / F.lit(100.0)
    p2 = p1 - delta
    need = F.lit(z * z) * (p1 * (1.0 - p1) + p2 * (1.0 - p2)) / (delta * delta)
    return rows.withColumn("n_per_arm", F.when((p2 > 0) & (p2 < 1), F.ceil(need)).cast("bigint"))


def minimum_detectable_effect(est: DataFrame, alpha: float = ALPHA, power: float = POWER) -> DataFrame:
    """Smallest effect each specification would find with the stated power, for both errors."""
    z = detection_multiplier(alpha, power)
    return est.withColumn("mde_conventional", F.lit(z) * F.col("se")).withColumn(
        "mde_robust", F.lit(z) * F.col("robust_se")
    )


def population_gap(cohort: DataFrame, population: DataFrame, key: Sequence[str], label: str = "not_completed") -> DataFrame:
    """Cohort rows inside and outside a population with their rates, and population rows outside the cohort."""
    keys = population.select(*key).distinct().withColumn("_in", F.lit(True))
    flagged = cohort.join(keys, list(key), "left")
    inside = F.col("_in").isNotNull()
    y = F.col(label).cast("double")
    main = flagged.groupBy(F.when(inside, "inside").otherwise("outside").alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(y).alias("base_rate")
    )
    whole = Window.partitionBy(F.lit(1))
    main = main.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(whole))
    extra = population.select(*key).join(cohort.select(*key).distinct(), list(key), "left_anti").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return main.unionByName(
        extra.select(
            F.lit("absent from cohort").alias("part"),
            "n_rows",
            F.lit(None).cast("double").alias("base_rate"),
            F.lit(None).cast("double").alias("share"),
        )
    )


def declared_outcome(est: DataFrame, density: DataFrame, groups: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """O9 when the density test rejects, else O7 when the robust interval excludes zero, else O8."""
    checked = density.withColumn("p_density", two_sided_p(F.col("z"))).select(*groups, "z", "p_density")
    rows = inference(est).join(checked, list(groups))
    excludes = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    rule = F.when(F.col("p_density") < alpha, "O9").when(excludes, "O7").otherwise("O8")
    return rows.withColumn("outcome", rule)
