"""Order statistics under skew against brute force, and the shape of the plans."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.catalog import load
from cohortlens.functions.hot_join import hot_join, hot_keys
from cohortlens.functions.ranking import budget_flags, exact_quantiles, running_counts, with_percent_rank
from cohortlens.functions.scalars import key_digest
from cohortlens.functions.normal import two_sided_p
from cohortlens.operators import bootstrap as bs
from cohortlens.operators import importance as im
from cohortlens.operators import quantile_cells as qc
from cohortlens.operators import scoring as sc
from cohortlens.operators.discontinuity import jump_table
from cohortlens.operators.ordering import rank_map
from cohortlens.plans import holdout as ho

GROUPS = {"hot": 700, "mid": 200, "one": 1}


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, one value with a third of them, some NULLs."""
    rng = random.Random(7)
    data = []
    for g, n in GROUPS.items():
        for i in range(n):
            v = 0.0 if rng.random() < 0.4 else round(rng.gauss(0, 50), 2)
            data.append((g, len(data), None if g == "mid" and i % 50 == 0 else v, int(rng.random() < 0.3)))
    return spark.createDataFrame(data, "g string, id int, v double, y int").repartition(5)


def by_group(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(r)
    return out


def test_running_counts(skewed):
    rows = by_group(skewed)
    for r in running_counts(skewed, ["g"], "v", {"n": F.lit(1), "pos": F.col("y")}).collect():
        mine = [x for x in rows[r["g"]] if x["v"] is not None]
        assert r["n_below"] == sum(x["v"] < r["v"] for x in mine)
        assert r["pos_below"] == sum(x["y"] for x in mine if x["v"] < r["v"])
        assert r["n"] == sum(x["v"] == r["v"] for x in mine)
        assert (r["n_total"], r["pos_total"]) == (len(mine), sum(x["y"] for x in mine))


def test_percent_rank_and_quantiles(skewed):
    rows = by_group(skewed)
    for r in with_percent_rank(skewed, ["g"], "v", "pr").collect():
        vals = [x["v"] for x in rows[r["g"]] if x["v"] is not None]
        want = None if r["v"] is None else 0.0 if len(vals) == 1 else sum(v < r["v"] for v in vals) / (len(vals) - 1)
        assert r["pr"] == want
    for r in exact_quantiles(skewed, ["g"], "v", [0, 1, 5, 9, 10], 10, "q").collect():
        vals = [x["v"] for x in rows[r["g"]] if x["v"] is not None]
        assert np.allclose(r["q"], np.quantile(vals, [0, 0.1, 0.5, 0.9, 1]))


def test_budget_flags_split_a_large_tie(skewed):
    whole = skewed.where(F.col("v").isNotNull()).withColumn("p", F.when(F.col("v") <= 20, 0.0).otherwise(F.col("v")))
    digests = {r["id"]: r["d"] for r in whole.select("id", key_digest(42, "id").alias("d")).collect()}
    for g, rows in by_group(budget_flags(whole, ["g"], ["id"], "p", 0.6, 42)).items():
        k = max(1, round(0.6 * len(rows)))
        order = sorted(rows, key=lambda r: (-r["p"], digests[r["id"]], r["id"]))
        assert {r["id"] for r in order[:k]} == {r["id"] for r in rows if r["flagged"] == 1}


def test_rank_map_with_ties(skewed):
    rows = skewed.where(F.col("v").isNotNull())
    got = {r["id"]: r["place"] for r in rank_map(rows, "v", "id", "place").collect()}
    order = sorted(rows.collect(), key=lambda r: (-r["v"], r["id"]))
    assert got == {r["id"]: i + 1 for i, r in enumerate(order)}


def by_hand(rows, resamples, seed, size):
    """Copies of every (class, score) per resample by the two-step rule, one draw at a time."""
    rows = sorted(rows)
    scores, below = {}, 0
    for v in sorted({v for v, _ in rows}):
        n = sum(x == v for x, _ in rows)
        scores[v] = 2 * (below // size) + (n >= size)
        below += n
    out = {}
    for c in (0, 1):
        mine = [v for v, y in rows if y == c]
        starts = {}
        for i, v in enumerate(mine):
            starts.setdefault(scores[v], i)
        for b in range(1, resamples + 1):
            taken = {}
            for slot in range(len(mine)):
                at = int(bs.drawn(seed, 0, np.array([b]), c, 0, np.array([slot]), len(mine))[0, 0])
                taken[scores[mine[at]]] = taken.get(scores[mine[at]], 0) + 1
            for block, t in taken.items():
                inside = [v for v in mine if scores[v] == block]
                for slot in range(t):
                    v = inside[int(bs.drawn(seed, 1, np.array([b]), c, block + 1, np.array([slot]), len(inside))[0, 0])]
                    out[b, c, v] = out.get((b, c, v), 0) + 1
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(bs, "MIN_BLOCK", 40)


def test_bootstrap_metrics_by_hand(skewed, small_blocks):
    """Many blocks, a score of a third of the rows as a block of its own, two groups."""
    got = {(r["g"], r["b"]): r for r in bs.bootstrap_metrics(skewed, ["g"], "v", 5.0, 6, 3).collect()}
    for g, rows in by_group(skewed.where("v is not null and g != 'one'")).items():
        copies = by_hand([(r["v"], r["y"]) for r in rows], 6, 3, 40)
        pos_n = sum(r["y"] for r in rows)
        for b in range(1, 7):
            drawn = sorted((v, c) for (bb, c, v), n in copies.items() if bb == b for _ in range(n))
            assert len(drawn) == len(rows) and sum(c for _, c in drawn) == pos_n
            neg = [v for v, c in drawn if not c]
            pos = [v for v, c in drawn if c]
            r = got[g, b]
            assert r["expected_cost"] == pytest.approx((10 * sum(v < 5 for v in pos) + sum(v >= 5 for v in neg)) / len(drawn))
            assert r["auc_roc"] == pytest.approx(sum((n < p) + (n == p) / 2 for p in pos for n in neg) / len(pos) / len(neg))
            assert r["auc_pr"] == pytest.approx(sum(sum(x >= p for x in pos) / sum(v >= p for v, _ in drawn) for p in pos) / len(pos))
            assert r["brier"] == pytest.approx(sum((v - c) ** 2 for v, c in drawn) / len(drawn))
            for share, name in ((0.05, "recall_at_5pct"), (0.1, "recall_at_10pct"), (0.2, "recall_at_20pct")):
                k = max(1, round(share * len(drawn)))
                line = sorted((v for v, _ in drawn), reverse=True)[k - 1]
                above = [c for v, c in drawn if v > line]
                tied = [c for v, c in drawn if v == line]
                assert r[name] == pytest.approx((sum(above) + (k - len(above)) * sum(tied) / len(tied)) / len(pos))


def test_bootstrap_rows_of_a_composite_key(skewed, small_blocks):
    out = bs.row_draws(skewed, ["g"], ["id", "v"], 20, 1).collect()
    assert len(out) == skewed.count()
    for g, n in GROUPS.items():
        for c in (0, 1):
            mine = [r for r in out if r["g"] == g and r["y"] == c]
            assert sum(r["copies"] for r in mine) == 20 * len(mine)
            assert len(mine) < 50 or 0.55 < sum(r["present"] for r in mine) / 20 / len(mine) < 0.72
    again = bs.row_draws(skewed.repartition(3), ["g"], ["id", "v"], 20, 1)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_bootstrap_shuffles_blocks_not_rows(spark, small_blocks):
    """Ten times the rows: what the exchanges write grows with the blocks at most, and no task draws all of a hot score."""
    rows = [(float(i % 997), int(i % 3 == 0)) for i in range(2000)]
    few = spark.createDataFrame(rows, "v double, y int")
    held = bs.score_blocks(few, [], "v")
    blocks = held.select("block").distinct().count()
    cells = bs.block_draws(held, [], 50, 1).select(F.sum(F.size("draws"))).first()[0]
    assert cells == blocks * 50 and blocks <= 2000 // 40 + 2
    text = plan(bs.bootstrap_metrics(few, [], "v", 0.5, 50))
    assert "Generate explode(draws" not in text and "CartesianProduct" not in text


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NO_PAIRS = [
    "activity_features",
    "activity_volume",
    "activity_breadth",
    "average_precision",
    "base_rates",
    "cohort_exclusions",
    "density_test_binned",
    "due_not_submitted",
    "exclusion_waterfall",
    "psi_numeric",
    "rd_standard_errors",
    "recall_at_budget",
    "slice_metrics",
    "stratified_bootstrap",
    "zero_activity_summary",
]


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_cartesian_product(spark, sf_dir, name):
    text = plan(load()[0][name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonRDD" not in text and "BatchEvalPython" not in text


def test_scan_reads_whole_years_and_few_columns(spark, sf_dir):
    text = load()[0]["activity_volume"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters" in text and "LessThan(l_shipdate" not in text
    scan = [line for line in text.splitlines() if "ReadSchema" in line and "l_shipdate" in line][0]
    assert "l_comment" not in scan and "l_extendedprice" not in scan.split("ReadSchema")[1]


def test_jump_errors_do_not_depend_on_the_outcome_level(spark):
    """A constant added to the outcome changes neither the jump nor its errors."""
    rng = random.Random(3)
    data = [(float(i % 41), rng.gauss(0, 1) + (i % 41 >= 20)) for i in range(2000)]
    df = spark.createDataFrame(data, "x double, y double")
    found = [
        jump_table(df.withColumn("y", F.col("y") + F.lit(shift)), "x", "y", [20.0], [10.0]).first().asDict()
        for shift in (0.0, 1e8)
    ]
    for name, value in found[0].items():
        assert found[1][name] == pytest.approx(value, rel=1e-5), name


def test_null_group_keeps_its_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    got = {r["g"]: (r["n_total"], r["n_below"]) for r in running_counts(df, ["g"], "v", {"n": F.lit(1)}).where("v > 1").collect()}
    assert got == {None: (2, 1), "a": (1, 0)}
    assert {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "v", [1], 2, "q").collect()} == {None: [2.0], "a": [2.0]}


def test_bootstrap_refuses_equal_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "id long, y int")
    with pytest.raises(Exception, match="not unique"):
        bs.row_draws(df, [], ["id"], 2).collect()


def test_two_sided_p(spark):
    from math import erfc, sqrt

    zs = [0.0, 0.3, -1.0, 1.96, 2.82, 2.84, -5.0, 9.0, 30.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", two_sided_p(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(erfc(abs(r["z"]) / sqrt(2)), rel=1e-9)


@pytest.fixture
def no_broadcast(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(kept, ("-1", "false", "16")):
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_hot_join_deals_out_a_key_of_half_the_rows(spark, no_broadcast):
    """No task reads over twice the median, and the rows are those of a plain join, NULL keys included."""
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 5000)
    rows = spark.range(200_000).select("id", key.cast("long").alias("k"))
    lookup = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")).unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    assert len(hot_keys(rows, ["k"], 0.2)) == 1
    out = hot_join(rows, lookup, ["k"])
    sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    assert out.agg(F.count("v"), F.sum("v"), F.sum("id")).first() == rows.withColumn("v", F.coalesce(F.col("k") * 3, F.lit(-1))).agg(F.count("v"), F.sum("v"), F.sum("id")).first()


def test_hot_join_edges(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "b", 3), (None, "a", 4)], "k int, g string, x int")
    lookup = spark.createDataFrame([(1, "a", 10), (1, None, 20), (1, "a", 30)], "k int, g string, v int")
    got = sorted(map(str, hot_join(rows, lookup, ["k", "g"], "left").collect()))
    want = [(1, "a", 1, 10), (1, "a", 1, 30), (1, None, 2, 20), (2, "b", 3, None), (None, "a", 4, None)]
    assert got == sorted(f"Row(k={k!r}, g={g!r}, x={x!r}, v={v!r})" for k, g, x, v in want)
    assert hot_join(rows.where("false"), lookup, ["k", "g"]).collect() == []


@pytest.fixture
def counted(spark):
    """A table and the number of its rows that jobs have read so far; every row is counted at each read."""

    def make(df):
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema), seen

    return make


SCORES = [(i, "ab"[i % 2], None if i % 5 == 0 else f"s{i % 3}", int(i % 3 == 0), (i % 7) / 7.0) for i in range(420)]


def test_every_metric_from_two_reads(spark, counted):
    rows = spark.createDataFrame(SCORES, "id int, g string, s string, y int, p double").repartition(4)
    read, seen = counted(rows)
    got = {r["g"]: r for r in ho.evaluation_report(read, ["g"], ["id"], [0.05, 0.2]).collect()}
    assert seen.value == 2 * len(SCORES)
    digests = {r["id"]: r["d"] for r in rows.select("id", key_digest(42, "id").alias("d")).collect()}
    for g, r in got.items():
        mine = [x for x in SCORES if x[1] == g]
        best = min((sum(10 * y * (p < t) + (1 - y) * (p >= t) for *_, y, p in mine) / len(mine), t) for t in sc.GRID)
        assert (r["expected_cost"], r["threshold"]) == pytest.approx(best)
        order = sorted(mine, key=lambda x: (-x[4], digests[x[0]], x[0]))
        for name, budget in (("recall_at_5pct", 0.05), ("recall_at_20pct", 0.2)):
            k = max(1, round(budget * len(mine)))
            assert r[name] == pytest.approx(sum(x[3] for x in order[:k]) / sum(x[3] for x in mine))
        bins = {}
        for *_, y, p in mine:
            bins.setdefault(min(9, int(p * 10)), []).append((p, y))
        off = sum(abs(sum(p for p, _ in v) - sum(y for _, y in v)) for v in bins.values()) / len(mine)
        assert r["ece"] == pytest.approx(off)


def test_slices_from_two_reads(spark, counted):
    read, seen = counted(spark.createDataFrame(SCORES, "id int, g string, s string, y int, p double").repartition(4))
    got = {(r["slice"], r["value"]): r for r in ho.slice_metrics(read, 0.5, ["g", "s"], ["id"]).collect()}
    assert seen.value == 2 * len(SCORES) and len(got) == 6
    for (by, value), r in got.items():
        mine = [x for x in SCORES if (x[1] if by == "g" else x[2] or "__NULL__") == value]
        assert r["n"] == len(mine)
        assert r["expected_cost"] == pytest.approx(sum(10 * y * (p < 0.5) + (1 - y) * (p >= 0.5) for *_, y, p in mine) / len(mine))


def test_flags_without_a_join_of_rows_with_rows(spark, counted):
    read, seen = counted(spark.createDataFrame(SCORES, "id int, g string, s string, y int, p double").repartition(4))
    flags = budget_flags(read.withColumn("g", F.when(F.col("g") == "a", F.col("g"))), ["g"], ["id"], "p", 0.3, 42)
    assert "SortMergeJoin" not in plan(flags)
    got = flags.collect()
    assert seen.value == 3 * len(SCORES)
    for g in (None, "a"):
        assert sum(r["flagged"] for r in got if r["g"] == g) == 63
    unscored = spark.createDataFrame([("a", 1, None), ("a", 2, 0.5), ("b", 3, None)], "g string, id int, p double")
    assert {r["id"]: r["flagged"] for r in budget_flags(unscored, ["g"], ["id"], "p", 0.5, 42).collect()} == {1: 0, 2: 1, 3: 0}


def drawn_rows(n):
    rng = np.random.default_rng(11)
    kinds = {"normal": rng.normal(0, 1e6, n), "ties": rng.integers(0, 6, n) / 4.0, "tiny": rng.random(n) * 1e-9}
    groups, splits = np.array(["a", None], object)[(np.arange(n) % 10 == 0).astype(int)], np.where(rng.random(n) < 0.7, "train", "test")
    out = pd.DataFrame({"g": groups, "split": splits, **kinds})
    out.loc[::7, "ties"] = np.nan
    return out


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_quantile_cells_are_exact_from_two_reads(spark, counted, monkeypatch, accuracy):
    """Also with a sketch that errs by far more than the margins allow for: intervals are then widened."""
    n = 60_000
    data = drawn_rows(n)
    monkeypatch.setattr(qc, "ACCURACY", accuracy)
    names = ["normal", "ties", "tiny"]
    read, seen = counted(spark.createDataFrame(data.replace({np.nan: None}), "g string, split string, normal double, ties double, tiny double").repartition(6))
    cells, edges = qc.quantile_cells(read, ["g"], names, F.col("split") == "train", {"test_n": F.col("split") == "test"}, 10)
    assert seen.value == 2 * n or accuracy == 40 and seen.value % (2 * n) == 0
    cells = cells.toPandas()
    for r in edges.collect():
        mine = data[(data.g == r["g"]) if r["g"] else data.g.isna()]
        values = mine[mine.split == "train"][r["feature"]].dropna()
        assert np.allclose(r["edges"], np.quantile(values, np.arange(11) / 10), rtol=1e-12, atol=0)
        own = cells[(cells.feature == r["feature"]) & ((cells.g == r["g"]) if r["g"] else cells.g.isna())]
        test = mine[mine.split == "test"][r["feature"]]
        assert own[own.value.isna()].test_n.sum() == test.isna().sum()
        for edge in r["edges"][1:-1]:
            assert own[own.value < edge].test_n.sum() == (test < edge).sum()
    assert edges.count() == 6
    if accuracy == 10_000:
        assert len(cells[(cells.feature == "normal") & (cells.g == "a")]) < 0.01 * n


def test_contributions_fold_inside_the_row(spark):
    """Equal to the long form, repeated keys apart, with one exchange of one partial aggregate."""
    coefs, means = {"a": 2.0, "was_missing_a": -1.0, "k__x": 0.5, "k__y": -0.5}, {"a": 1.0, "was_missing_a": 0.5, "k__x": 0.25, "k__y": 0.75}
    rows = spark.createDataFrame([(i, i % 4 / 2, int(i % 5 == 0), int(i % 3 == 0), int(i % 3 > 0)) for i in range(50)], "id int, a double, was_missing_a int, k__x int, k__y int")
    folded = im.mean_contributions(im.folded_contributions(rows, [], coefs, means))
    long = im.grouped_contribution(im.linear_contributions(rows, ["id"], coefs, means), ["id"])
    want = {r["feature"]: r["importance"] for r in long.collect()}
    assert {r["feature"]: r["importance"] for r in folded.collect()} == pytest.approx(want) and set(want) == {"a", "k"}
    text = plan(folded)
    final = text.split("Initial Plan")[-1]
    assert final.count("Exchange") == 1 and "Expand" not in final
    assert im.mean_contributions(im.folded_contributions(rows.where("id < 0"), [], coefs, means)).count() == 0
