"""Published figures of the discontinuity study that follow from published frequencies alone."""

import math

import pytest

from cohortlens.operators import discontinuity as rd

# Frequency of each score from 30 to 50, and the size of the population
FREQUENCY = [39, 7, 25, 20, 28, 36, 45, 18, 42, 26, 143, 32, 67, 41, 75, 142, 87, 36, 109, 60, 312]
POPULATION = 23916


@pytest.fixture(scope="module")
def scores(spark):
    rest = POPULATION - sum(FREQUENCY)
    counts = [(float(30 + i), n) for i, n in enumerate(FREQUENCY)] + [(0.0, 100), (100.0, 200), (80.0, rest - 300)]
    df = spark.createDataFrame(counts, "score double, n int")
    return df.selectExpr("score", "explode(sequence(1, n)) AS i").selectExpr("score", "i % 2 AS y")


def test_density_test(scores):
    r = rd.density_test(scores, "score", 40.0, 10.0).first()
    assert r["n"] == POPULATION
    assert round(r["f_left"], 6) == 0.001413 and round(r["f_right"], 6) == 0.003659
    assert (round(r["theta"], 4), round(r["se"], 4), round(r["z"], 4)) == (0.9516, 0.1403, 6.7811)


def test_side_counts_and_donut_size(scores):
    r = rd.jump_table(scores, "score", "y", [40.0], [10.0]).first()
    assert (r["n_left"], r["n_right"]) == (247, 792)
    d = rd.donut_table(scores, "score", "y", 40.0, [10.0]).first()
    assert d["rows_dropped"] == 201 and d["rows_kept"] == POPULATION - 201


def test_heaping(scores):
    got = {r["value"]: r["ratio"] for r in rd.heaping_ratio(rd.score_histogram(scores, "score", 30, 50)).collect()}
    assert {k: round(v, 2) for k, v in got.items()} == {30: 5.57, 35: 0.99, 40: 4.93, 45: 1.75, 50: 5.20}


def test_power_and_detectable_effect(spark):
    rates = spark.createDataFrame([("all", 0.3825)], "g string, base_rate double")
    got = {r["effect_points"]: r["n_per_arm"] for r in rd.power_curve(rates, ["g"]).collect()}
    assert [got[e] for e in range(3, 11)] == [4051, 2264, 1439, 992, 723, 549, 430, 345]
    assert abs(got[1] - 36884) <= 1 and abs(got[2] - 9169) <= 1
    est = spark.createDataFrame([(0.0490, 0.0775)], "se double, robust_se double")
    r = rd.minimum_detectable_effect(est).first()
    assert round(r["mde_conventional"] * 100, 1) == 13.7 and round(r["mde_robust"] * 100, 1) == 21.7


def test_infeasible_effect_is_null(spark):
    rates = spark.createDataFrame([("g", 0.05)], "g string, base_rate double")
    got = {r["effect_points"]: r["n_per_arm"] for r in rd.power_curve(rates, ["g"]).collect()}
    assert got[4] is not None and got[5] is None and got[10] is None


def test_straight_lines_with_a_known_jump(spark):
    data = [(float(x), 2.0 + 0.1 * x + (0.7 if x >= 40 else 0.0)) for x in range(0, 81)]
    est = rd.inference(rd.jump_table(spark.createDataFrame(data, "x double, y double"), "x", "y", [40.0], [5.0, 20.0]))
    for r in est.collect():
        assert math.isclose(r["estimate"], 0.7, abs_tol=1e-9) and math.isclose(r["bias_corrected"], 0.7, abs_tol=1e-7)
        assert r["se"] < 1e-5


def test_two_sided_p(spark):
    from pyspark.sql import functions as F

    from cohortlens.functions.normal import two_sided_p

    got = spark.createDataFrame([(1.959963984540054,), (0.0,), (None,)], "z double").select(two_sided_p(F.col("z")))
    p = [r[0] for r in got.collect()]
    assert math.isclose(p[0], 0.05, rel_tol=1e-12) and p[1] == 1.0 and p[2] is None
