"""Exact order statistics without a global sort and without a large group in one task.

Every operator here first collapses rows to one cell per distinct value (partial aggregation
on the map side, so a value shared by a third of all rows is one cell). Cells are cut into
value ranges of about equal mass; range totals give offsets, and running sums inside one range
finish the job. One window partition therefore holds at most one range of one group, whatever
the size of the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hot_join import hot_join
from cohortlens.functions.scalars import key_digest
from cohortlens.functions.session import stage

_RANGE = "_range"
_WHOLE = "_whole"
MIN_RANGES = 64
TIE_DIGITS = 3


def range_splits(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Inner split points that cut ``value`` into ranges of about equal row count.

    The sketch is mergeable and of bounded size; what comes to the driver is at most
    ``ranges - 1`` numbers.
    """
    if ranges is None:
        ranges = max(MIN_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / ranges for i in range(1, ranges)]
    found = df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", probs, 0.25 / ranges)
    return sorted({float(e) + 0.0 for e in found})


def with_range(df: DataFrame, value: str, splits: Sequence[float]) -> DataFrame:
    if not splits:
        return df.withColumn(_RANGE, F.lit(0.0))
    probe = "_range_probe"
    edges = [-float("inf"), *splits, float("inf")]
    cut = Bucketizer(splits=edges, inputCol=probe, outputCol=_RANGE, handleInvalid="keep")
    # Adding zero turns -0.0 into 0.0, which the binary search would put below it.
    return cut.transform(df.withColumn(probe, F.col(value).cast("double") + F.lit(0.0))).drop(probe)


def same_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal key columns where NULL equals NULL; the keys appear once."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def running_counts(
    df: DataFrame, groups: Sequence[str], value: str, measures: Mapping[str, Column]
) -> DataFrame:
    """One row per (group, distinct value) with sums, sums over smaller values and group totals.

    Output columns: groups, value, and for each measure m: m, m_below, m_total. Rows with a NULL
    value are left out; a NULL group is a group.
    """
    rows = df.where(F.col(value).isNotNull())
    by = list(groups)
    if not by:
        rows, by = rows.withColumn(_WHOLE, F.lit(0)), [_WHOLE]
    ranged = with_range(rows, value, range_splits(rows, value))
    names = list(measures)
    cells = ranged.groupBy(*by, _RANGE, value).agg(*[F.sum(measures[m]).alias(m) for m in names])

    before = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = (
        cells.groupBy(*by, _RANGE)
        .agg(*[F.sum(m).alias(m) for m in names])
        .select(
            *by,
            _RANGE,
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_offset") for m in names],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in names],
        )
    )
    inside = (
        Window.partitionBy(*by, _RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = same_keys(cells, offsets, [*by, _RANGE])
    return joined.select(
        *groups,
        value,
        *names,
        *[
            (F.coalesce(F.sum(m).over(inside), F.lit(0)) + F.col(f"{m}_offset")).alias(f"{m}_below")
            for m in names
        ],
        *[f"{m}_total" for m in names],
    )


def with_percent_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Percent rank of ``value`` inside each group; rows without a value get NULL and do not count.

    Those rows stay out of the join, where they would meet on one key. The ladder is written out, so Spark
    broadcasts it when its real size allows; ``df`` is read four times and should be a stored table.
    """
    ladder = running_counts(df, groups, value, {"n": F.lit(1)})
    rank = F.when(F.col("n_total") <= 1, F.lit(0.0)).otherwise(
        F.col("n_below") / (F.col("n_total") - 1)
    )
    ranks = stage(ladder.select(*groups, value, rank.alias(out)), "ranks")
    # A value of a large share of a group is a hot key of this join once the ladder outgrows a broadcast.
    ranked = hot_join(df.where(F.col(value).isNotNull()), ranks, [*groups, value])
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, steps: Sequence[int], parts: int, out: str
) -> DataFrame:
    """Linearly interpolated quantiles ``step/parts`` per group as one array column.

    Positions are integer arithmetic, so a quantile that falls on a data point is exactly it.
    Counts per value range show which ranges hold a wanted position; only rows of those ranges
    are collapsed, shuffled and ordered.
    """
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("v"))
    by = list(groups)
    if not by:
        rows, by = rows.withColumn(_WHOLE, F.lit(0)), [_WHOLE]
    ranged = with_range(rows, "v", range_splits(rows, "v"))

    low = f"(i * (total - 1)) div {parts}"
    high = f"(i * (total - 1) + {parts - 1}) div {parts}"
    holds = "below <= {0} AND {0} < below + n"
    either = f"({holds.format(low)}) OR ({holds.format(high)})"
    wanted = ", ".join(f"{step}L" for step in steps)

    before = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.groupBy(*by, _RANGE).agg(F.count(F.lit(1)).alias("n")).select(
        *by,
        _RANGE,
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"),
        F.sum("n").over(Window.partitionBy(*by)).alias("total"),
    )
    needed = stage(counted.where(f"exists(array({wanted}), i -> {either})").drop("n"), "ranges")
    inside = Window.partitionBy(*by, _RANGE).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        same_keys(ranged, needed, [*by, _RANGE])
        .groupBy(*by, _RANGE, "below", "total", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    )
    hits = cells.selectExpr(*by, "v", "n", "below", "total", f"explode(filter(array({wanted}), i -> {either})) AS i")
    ends = hits.groupBy(*by, "i").agg(
        F.expr(f"max(CASE WHEN {holds.format(low)} THEN v END)").alias("lo"),
        F.expr(f"max(CASE WHEN {holds.format(high)} THEN v END)").alias("hi"),
        F.expr(f"max((i * (total - 1)) % {parts}) / {float(parts)}D").alias("w"),
    )
    points = ends.groupBy(*by).agg(F.expr("array_sort(collect_list(struct(i, lo + (hi - lo) * w AS q)))").alias("p"))
    return points.select(*groups, F.expr("transform(p, s -> s.q)").alias(out))


def budget_boundaries(
    ladder: DataFrame, groups: Sequence[str], value: str, budgets: Sequence[float]
) -> DataFrame:
    """Where the top ``budget`` share ends: boundary value, how many tied rows are still needed.

    ``ladder`` comes from :func:`running_counts` with measures ``n`` and ``pos``.
    """
    options = ladder.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    k = F.greatest(F.lit(1.0), F.bround(F.col("budget") * F.col("n_total"), 0)).cast("bigint")
    above = F.col("n_total") - F.col("n_below") - F.col("n")
    pos_above = F.col("pos_total") - F.col("pos_below") - F.col("pos")
    sized = options.withColumn("k", k).withColumn("n_above", above).withColumn("pos_above", pos_above)
    return sized.where((F.col("n_above") < F.col("k")) & (F.col("k") <= F.col("n_above") + F.col("n"))).select(
        *groups,
        "budget",
        "k",
        F.col(value).alias("boundary"),
        "n_above",
        "pos_above",
        F.col("n").alias("n_tied"),
        F.col("pos").alias("pos_tied"),
        F.col("pos_total"),
        "n_total",
        (F.col("k") - F.col("n_above")).alias("needed"),
    )


def rank_ties(
    tied: DataFrame, groups: Sequence[str], key: Sequence[str], seed: int
) -> DataFrame:
    """Exact random order inside each group by key digest, column ``tie_rank`` from 1.

    Digests are uniform, so their leading digits cut even one huge tie into equal ranges.
    """
    hashed = tied.withColumn("_digest", key_digest(seed, *key))
    ranged = hashed.withColumn(_RANGE, F.substring("_digest", 1, TIE_DIGITS))
    before = Window.partitionBy(*groups).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*groups, _RANGE)
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*groups, _RANGE, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*groups, _RANGE).orderBy("_digest", *key)
    return (
        same_keys(ranged, offsets, [*groups, _RANGE])
        .withColumn("tie_rank", F.row_number().over(inside) + F.col("_offset"))
        .drop("_digest", _RANGE, "_offset")
    )


def collapsed(scored: DataFrame, groups: Sequence[str], score: str, positives: Column) -> DataFrame:
    """(groups.., score, n, pos): rows collapsed to distinct scores in one pass and written out.

    Cells of parts of a table add up, so every order statistic of the scores follows from this table.
    """
    own = F.col(score).cast("double").alias(score)
    cells = scored.groupBy(*groups, own).agg(F.count(F.lit(1)).alias("n"), F.sum(positives.cast("bigint")).alias("pos"))
    return stage(cells, "cells")


def cell_ladder(cells: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """:func:`running_counts` of cells ``(groups.., score, n, pos)``; cells of one score add up."""
    return running_counts(cells, groups, score, {"n": F.col("n"), "pos": F.col("pos")})


def budget_hits(
    scored: DataFrame,
    groups: Sequence[str],
    key: Sequence[str],
    label: str,
    score: str,
    budgets: Sequence[float],
    seed: int,
    ladder: DataFrame | None = None,
) -> DataFrame:
    """Positives caught in the top share of each group: groups, budget, k, tp, pos_total, n_total.

    ``ladder`` is the :func:`cell_ladder` of the rows where the caller has it. ``scored`` is then read once, for the
    rows at a boundary that the budget cuts through, and twice without it.
    """
    if ladder is None:
        ladder = cell_ladder(collapsed(scored, groups, score, F.col(label)), groups, score)
    edges = stage(budget_boundaries(ladder, groups, score, budgets), "budget-edges")
    open_ties = edges.where(F.col("needed") < F.col("n_tied"))
    keep = [*groups, "budget", "needed"]
    at_line = same_keys(
        scored.withColumn("boundary", F.col(score).cast("double")),
        open_ties.select(*keep, F.col("boundary").cast("double").alias("boundary")),
        [*groups, "boundary"],
    )
    tied = stage(at_line.select(*keep, *key, label), "ties")
    caught = (
        rank_ties(tied, [*groups, "budget"], key, seed)
        .where(F.col("tie_rank") <= F.col("needed"))
        .groupBy(*groups, "budget")
        .agg(F.sum(F.col(label).cast("bigint")).alias("pos_drawn"))
    )
    from_ties = F.when(F.col("needed") == F.col("n_tied"), F.col("pos_tied")).otherwise(
        F.coalesce(F.col("pos_drawn"), F.lit(0))
    )
    return same_keys(edges, caught, [*groups, "budget"], "left").select(
        *groups, "budget", "k", (F.col("pos_above") + from_ties).alias("tp"), "pos_total", "n_total"
    )


def budget_flags(
    scored: DataFrame,
    groups: Sequence[str],
    key: Sequence[str],
    score: str,
    budget: float,
    seed: int,
) -> DataFrame:
    """``scored`` with column ``flagged``: 1 for the top share of its group, ties broken by digest.

    ``groups`` names at least one column; add a constant one to rank the whole table. ``key`` is unique inside a group.
    The last tied row that still fits is found first, so flagging compares each row with one line of its group: rows
    are neither ranked as a whole nor joined with themselves. A row without a score is not flagged.
    """
    if not groups:
        raise ValueError("budget_flags needs at least one group column")
    by = list(groups)
    ladder = cell_ladder(collapsed(scored, by, score, F.lit(0)), by, score)
    edges = stage(budget_boundaries(ladder, by, score, [budget]), "budget-edges")
    lines = edges.select(*by, F.col("boundary").cast("double").alias("_line"), "needed", "n_tied")
    own = F.col(score).cast("double")
    order = F.struct(key_digest(seed, *key), *key)
    open_ties = lines.where(F.col("needed") < F.col("n_tied"))
    ties = stage(same_keys(scored, open_ties, by).where(own == F.col("_line")).select(*by, *key, "needed"), "ties")
    last = rank_ties(ties, by, key, seed).where(F.col("tie_rank") == F.col("needed")).select(*by, order.alias("_last"))
    cut = stage(same_keys(lines, last, by, "left"), "lines")
    whole = F.col("needed") == F.col("n_tied")
    flagged = (own > F.col("_line")) | ((own == F.col("_line")) & (whole | (order <= F.col("_last"))))
    return (
        same_keys(scored, cut, by, "left")
        .withColumn("flagged", F.when(flagged, 1).otherwise(0))
        .drop("_line", "needed", "n_tied", "_last")
    )
