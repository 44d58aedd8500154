"""Fits over partitions against the same fits done by hand in memory."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import boosting as bo
from cohortlens.operators import logistic as lo
from cohortlens.plans import ladder as ld


def table(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(0.5 + x @ np.array([1.0, -2.0, 0.0, 0.7]))))
    y = (rng.random(n) < p).astype(int)
    group = np.where(np.arange(n) % 3 == 0, 7, 9)
    rows = [(int(g), [float(v) for v in r], int(t)) for g, r, t in zip(group, x, y)]
    return x, y, group, spark.createDataFrame(rows, "grp int, x array<double>, y int").repartition(5)


def test_newton_steps_solve_the_score_equations(spark):
    x, y, group, df = table(spark)
    specs = [lo.LogitSpec(f"{g} {c} {cols}", g, cols, c) for g in (7, 9) for c in (0.01, 1.0, 100.0) for cols in ((0, 1, 2, 3), (2,), ())]
    for fit in lo.fit_logits(df, specs, "grp"):
        mine = group == fit.spec.group
        z = x[mine][:, fit.spec.columns]
        p = fit.probability(x[mine])
        assert np.abs(z.T @ (p - y[mine]) + fit.coefficients / fit.spec.c).max(initial=0) < 1e-6 * mine.sum()
        assert abs((p - y[mine]).sum()) < 1e-6 * mine.sum() and fit.n_rows == mine.sum() and fit.steps < 15


def test_newton_on_separable_and_constant_columns(spark):
    df = spark.createDataFrame([(1, [float(i), 1.0], int(i > 50)) for i in range(100)], "grp int, x array<double>, y int")
    fit = lo.fit_logits(df, [lo.LogitSpec("s", 1, (0, 1), 10.0)], "grp")[0]
    assert fit.gradient < 1e-9 and (fit.probability(np.array([[0.0, 1.0], [99.0, 1.0]])).round(3) == [0, 1]).all()
    with pytest.raises(ValueError, match="no rows"):
        lo.fit_logits(df, [lo.LogitSpec("s", 2, (0,), 1.0)], "grp")


def grown_by_hand(bins, y, w, layout, spec, n_trees, start):
    """Boosting in memory, node by node."""
    margin = np.full(y.size, start)
    out = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        leaf = np.zeros(y.size)

        def split(rows, depth):
            leaf[rows] = -spec.learning_rate * g[rows].sum() / h[rows].sum()
            if depth == spec.max_depth:
                return
            best, found = 1e-10, None
            for f, size in enumerate(layout.sizes):
                for b in range(size - bool(layout.ordered[f])):
                    left = rows[bins[rows, f] <= b] if layout.ordered[f] else rows[bins[rows, f] == b]
                    right = np.setdiff1d(rows, left)
                    if min(left.size, right.size) < spec.min_rows or min(h[left].sum(), h[right].sum()) < bo.MIN_HESSIAN:
                        continue
                    gain = sum(g[r].sum() ** 2 / h[r].sum() for r in (left, right)) - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > best + 1e-9:
                        best, found = gain, (left, right)
            if found:
                for r in found:
                    split(r, depth + 1)

        split(np.arange(y.size), 0)
        margin = margin + leaf
        out.append(margin.copy())
    return out


@pytest.mark.parametrize("local_rows, driver_bytes", [(20_000, 0), (0, 1 << 25), (0, 0)])
def test_trees_by_hand(spark, monkeypatch, local_rows, driver_bytes):
    """All ways of adding histograms, several groups and configurations, blocks of two trees."""
    monkeypatch.setattr(bo, "LOCAL_ROWS", local_rows)
    monkeypatch.setattr(bo, "DRIVER_BYTES", driver_bytes)
    monkeypatch.setattr(bo, "ROWS_PER_TASK", 50)
    rng = np.random.default_rng(3)
    layouts = {1: bo.Layout(np.array([9, 2, 4]), np.array([True, True, False])), 2: bo.Layout(np.array([5, 6]), np.array([True, False]))}
    data, frames = {}, []
    for g, layout in layouts.items():
        bins = np.column_stack([rng.integers(0, s, 260) for s in layout.sizes])
        y = (rng.random(260) < 0.2 + 0.5 * (bins[:, 0] > 3) * (bins[:, -1] != 2)).astype(float)
        w = np.where(y == 1, 1.7, 1.0)
        data[g] = (bins, y, w)
        frames += [(g, i < 200, y[i], float(w[i]), bytearray(bins[i].astype("<u2").tobytes())) for i in range(260)]
    rows = spark.createDataFrame([(g, f, float(t), w, x) for g, f, t, w, x in frames], "grp int, fit boolean, y double, weight double, bins binary").repartition(4)
    specs = [bo.BoostSpec("a", 1, 3, 0.1, 10), bo.BoostSpec("b", 2, 2, 0.3, 25), bo.BoostSpec("c", 1, 2, 0.5, 5)]
    for spec, fit in zip(specs, bo.fit_boosted(rows, specs, layouts, [4, 5, 3], None, block_trees=2)):
        bins, y, w = (v[:200] for v in data[spec.group])
        want = grown_by_hand(bins, y, w, layouts[spec.group], spec, len(fit.trees), fit.start)
        assert np.allclose(np.log(fit.probability(bins) / (1 - fit.probability(bins))), want[-1])


def test_growing_stops_after_the_best_prefix(spark):
    """The held-out loss of every prefix decides; the model is the best prefix, no further than ``patience`` trees before the end."""
    rng = np.random.default_rng(9)
    bins = rng.integers(0, 8, (400, 3))
    y = (rng.random(400) < np.where(bins[:, 0] > 3, 0.7, 0.3)).astype(float)
    layout = {5: bo.Layout(np.array([8, 8, 8]), np.array([True] * 3))}
    rows = spark.createDataFrame([(5, i % 2 == 0, float(y[i]), 1.0, bytearray(bins[i].astype("<u2").tobytes())) for i in range(400)], "grp int, fit boolean, y double, weight double, bins binary")
    spec = bo.BoostSpec("a", 5, 3, 0.3, 5)
    fit = bo.fit_boosted(rows, [spec], layout, 200, 6, block_trees=4)[0]
    best = bo.best_iteration(fit.losses, 6)
    assert len(fit.trees) == best < len(fit.losses) < 200 and len(fit.losses) - best >= 6
    held = np.arange(400) % 2 == 1
    p = fit.probability(bins[held])
    assert fit.losses[best - 1] == pytest.approx(-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean())


def test_sums_of_arrays(spark):
    df = spark.createDataFrame([(i % 2, [float(i), 1.0]) for i in range(10)], "k int, v array<double>")
    assert {r["k"]: r["v"] for r in lo.summed(df, ["k"], "v").collect()} == {0: [20.0, 5.0], 1: [25.0, 5.0]}
    assert lo.summed(df.where(F.lit(False)), ["k"], "v").collect() == []


def test_a_group_that_fits_a_task_is_one_job_for_any_number_of_trees(spark, monkeypatch):
    """More rows than a level sums in full: no job a tree, and the trees of the passes over all rows."""
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 6, (24_000, 3))
    y = (rng.random(24_000) < 0.2 + 0.1 * bins[:, 0] * (bins[:, 2] != 1)).astype(float)
    layout = {3: bo.Layout(np.array([6, 6, 6]), np.array([True, True, False]))}
    data = [(3, i % 8 > 0, float(y[i]), 1.0, bytearray(bins[i].astype("<u2").tobytes())) for i in range(24_000)]
    rows = spark.createDataFrame(data, "grp int, fit boolean, y double, weight double, bins binary").repartition(3)
    specs = [bo.BoostSpec("a", 3, 4, 0.1, 20), bo.BoostSpec("b", 3, 2, 0.2, 50)]
    spark.sparkContext.setJobGroup("boosted", "")
    fits = bo.fit_boosted(rows, specs, layout, 14, 20)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs <= 6
    monkeypatch.setattr(bo, "LOCAL_ROWS", 0)
    for one, other in zip(fits, bo.fit_boosted(rows, specs, layout, 14, 20)):
        assert len(one.trees) == len(other.trees) and np.allclose(one.losses, other.losses)
        assert np.allclose(one.probability(bins[:500]), other.probability(bins[:500]))


def test_score_equations_are_summed_in_the_tasks(spark):
    """By hand, for models that solve nothing, and without a row for each value of each scored row."""
    x, y, group, df = table(spark)
    design = SimpleNamespace(design=SimpleNamespace(columns=["a", "b", "c", "d"]))
    made = ld.Prepared({7: design, 9: design}, df.withColumn("fit", F.lit(True)), [])
    fits = [lo.LogitFit(lo.LogitSpec("m", g, cols, 0.5), 0.3, np.array([0.2, -0.4][: len(cols)]), int((group == g).sum()), 1, 0.0) for g in (7, 9) for cols in ((0, 2), (3,))]
    models = [ld.Model(f.spec.group, f"B{len(f.spec.columns)}", {"C": 0.5}, f) for f in fits]
    got = ld.score_equations(made, models)
    assert "explode(x" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["cutoff"], r["rung"], r["column"]): r["residual"] for r in got.collect()}
    want = {}
    for m, f in zip(models, fits):
        mine = group == m.cutoff
        off = f.probability(x[mine]) - y[mine]
        want[m.cutoff, m.rung, "(intercept)"] = off.sum() / f.n_rows
        want |= {(m.cutoff, m.rung, "abcd"[at]): (off @ x[mine][:, at] + b / 0.5) / f.n_rows for at, b in zip(f.spec.columns, f.coefficients)}
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-12 for k, v in want.items())


def test_joint_bins_give_the_sums_of_each_feature():
    """Large nodes are summed by joint bins of several features, small ones a feature at a time; both are plain sums."""
    rng = np.random.default_rng(6)
    layout = bo.Layout(np.array([63, 2, 300, 1, 40, 7, 2]), np.array([True, True, False, True, True, False, True]))
    assert sorted(f for pack in layout.packs for f in pack) == list(range(7)) and len(layout.packs) < 4
    bins = np.column_stack([rng.integers(0, s, 40_000) for s in layout.sizes]).astype("<u2")
    data, g, h = bo._Rows(bins, layout), rng.normal(size=40_000), rng.random(40_000)
    for rows in (np.arange(40_000), np.flatnonzero(rng.random(40_000) < 0.5), np.flatnonzero(rng.random(40_000) < 0.01)):
        want = np.zeros((3, layout.total))
        for f, start in enumerate(layout.starts):
            for k, v in enumerate((g, h, np.ones(40_000))):
                np.add.at(want[k], start + bins[rows, f].astype(int), v[rows])
        assert np.allclose(data.histogram(rows, g, h), want, rtol=0, atol=1e-9)


def test_a_cutoff_of_over_400_000_rows_is_one_job(spark):
    """As many rows as a cutoff has at some hundred megabytes: no job a level and tree."""
    n = 410_000
    cells = F.unhex(F.format_string("%02x00%02x00", F.col("id") % 7, F.xxhash64("id") % 3 + 2))
    rows = spark.range(n, numPartitions=4).select(
        F.lit(2).alias("grp"), (F.col("id") % 5 > 0).alias("fit"), (F.xxhash64("id", F.lit(1)) % 7 < F.col("id") % 7).cast("double").alias("y"), F.lit(1.0).alias("weight"), cells.alias("bins")
    )
    spark.sparkContext.setJobGroup("large", "")
    fit = bo.fit_boosted(rows, [bo.BoostSpec("a", 2, 2, 0.3, 50)], {2: bo.Layout(np.array([7, 5]), np.array([True, True]))}, 3, 2)[0]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("large"))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs <= 6 and len(fit.trees) == 3 and fit.losses[2] < fit.losses[1] < fit.losses[0]


def test_trees_route_rows_to_the_leaves_they_walk_to():
    rng = np.random.default_rng(8)
    tree, ordered = bo.Tree(2), np.array([True, False])
    tree.feature[[1, 3]], tree.bin[[1, 3]] = [0, 1], [2, 4]
    bins = rng.integers(0, 6, (50_000, 2)).astype("<u2")
    at = np.zeros(len(bins), int)
    for node, rows in tree.routed(np.ascontiguousarray(bins.T), ordered):
        at[rows] = node
    assert (at == tree.leaves(bins, ordered)).all()


def test_bins_of_rows_come_back_from_their_column():
    bins = np.arange(12).reshape(4, 3)
    column = bo.bin_column(bins)
    assert (bo.bin_matrix(column, 3) == bins).all() and (bo.bin_matrix(column[1:3], 3) == bins[1:3]).all()
    with pytest.raises(ValueError, match="bins of other"):
        bo.bin_matrix(column, 2)
