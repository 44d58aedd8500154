"""Cutoffs and seeds share the passes of the ladder; medians by sketch and count."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import quantile_cells as qc
from cohortlens.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from cohortlens.operators.prep import fit_design
from cohortlens.plans import ladder as ld


@pytest.fixture(scope="module")
def rows(spark):
    """Three cutoffs of 240 rows; some values are missing, one feature is constant, one level is rare."""
    rng = np.random.default_rng(12)
    out = []
    for c in (45, 90, 180):
        for i in range(240):
            v = [float(x) for x in rng.normal(size=len(NUMERIC_FEATURES)).round(1)]
            v[0], v[1] = 1.0, None if rng.random() < 0.2 else v[1]
            levels = ["rare" if i == 3 else None if rng.random() < 0.1 else "ab"[int(rng.integers(0, 2))] for _ in CATEGORICAL_FEATURES[:-1]]
            y = int(rng.random() < (0.6 if v[2] > 0 else 0.3))
            out.append((c, f"p{i % 3}", i, y, "train" if i % 4 else "validate", *v, *levels, "xyz"[i % 3]))
    schema = "cutoff int, code_presentation string, id_student int, not_completed int, split string, "
    schema += ", ".join([*(f"{f} double" for f in NUMERIC_FEATURES), *(f"{f} string" for f in CATEGORICAL_FEATURES)])
    return spark.createDataFrame(out, schema).repartition(3).cache()


def jobs_of(spark, group, make):
    spark.sparkContext.setJobGroup(group, "")
    made = make()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "")
    return n, made


def test_encoders_of_all_cutoffs_come_from_the_same_reads(spark, rows):
    one, _ = jobs_of(spark, "one cutoff", lambda: ld.fit_encoders(rows.where("cutoff = 45")))
    all_, found = jobs_of(spark, "all cutoffs", lambda: ld.fit_encoders(rows))
    assert all_ <= one + 2 and list(found) == [45, 90, 180]
    for c, encoder in found.items():
        want = fit_design(rows.where(F.col("cutoff") == c), NUMERIC_FEATURES, CATEGORICAL_FEATURES)
        assert encoder.design.columns == want.columns and encoder.design.indicators == [NUMERIC_FEATURES[1]]
        for got, plain in ((encoder.design.median, want.median), (encoder.design.mean, want.mean), (encoder.design.std, want.std)):
            assert all(got[f] == pytest.approx(plain[f], abs=1e-12) for f in NUMERIC_FEATURES)


def test_seeds_share_the_passes(spark, rows):
    """As many jobs for four seeds as for one, and the costs of fits made a seed at a time."""
    key, grid = ["code_presentation", "id_student"], [{"max_depth": 2.0, "learning_rate": 0.3, "min_rows": 20.0}]
    ladder = ld.fit_ladder(rows, "not_completed", key, c_grid=[0.1], boost_grid=grid, max_trees=6, patience=3, only=["B0", "B1", "M1"])
    one, single = jobs_of(spark, "one seed", lambda: ld.refit_at_seeds(ladder, rows, "not_completed", key, seeds=[7], patience=3).collect())
    four, found = jobs_of(spark, "four seeds", lambda: ld.refit_at_seeds(ladder, rows, "not_completed", key, seeds=[42, 7, 9, 11], patience=3).collect())
    assert four <= one + 12 and len(found) == 4 * 9
    costs = {(r["seed"], r["cutoff"], r["rung"]): r["expected_cost"] for r in found}
    assert all(costs[7, r["cutoff"], r["rung"]] == pytest.approx(r["expected_cost"], abs=1e-12) for r in single)
    assert all(costs[42, c, r] == pytest.approx(v, abs=1e-12) for (c, r), v in ladder.costs.items() if r != "M1")
    ranked = ld.seed_stability(spark.createDataFrame(found)).collect()
    assert len(ranked) == 12 and {r["seed"] for r in ranked} == {42, 7, 9, 11}


@pytest.mark.parametrize("accuracy, margins", [(10_000, (2e-4, 0.01)), (20, (0.01,)), (5, (0.0001,))])
def test_medians_are_exact(spark, monkeypatch, accuracy, margins):
    """By narrow and wide intervals, ties, missing values, and where a sketch misses its interval."""
    monkeypatch.setattr(qc, "ACCURACY", accuracy)
    monkeypatch.setattr(qc, "MARGINS", margins)
    monkeypatch.setattr(qc, "SLACK", 0)
    rng = np.random.default_rng(2)
    data = [(None if g == 2 else g, float(a), None if a < 0 else int(b), None) for g in range(3) for a, b in zip(rng.normal(size=501 + g), rng.integers(0, 4, 501 + g))]
    df = spark.createDataFrame(data, "g int, a double, b int, c double").repartition(4)
    found = {(r["g"], r["feature"]): r["median"] for r in qc.medians(df, ["g"], ["a", "b", "c"]).collect()}
    for g in (0, 1, None):
        assert found[g, "a"] == np.median([r[1] for r in data if r[0] == g])
        assert found[g, "b"] == np.median([r[2] for r in data if r[0] == g and r[2] is not None])
    assert len(found) == 6
    whole = {r["feature"]: r["median"] for r in qc.medians(df, [], ["a"]).collect()}
    assert whole == {"a": np.median([r[1] for r in data])}


def test_drift_beside_importance_reads_the_stored_features(spark, rows, monkeypatch):
    """The features of the ladder serve the drift as well; they are not made a second time."""
    from cohortlens.catalog import drift_queries as dq
    from cohortlens.catalog import ladder_queries as lq

    def again(spark, d):
        raise AssertionError("features are made again")

    stored = rows.withColumn("split", F.when(F.col("split") == "validate", "test").otherwise(F.col("split")))
    weights = spark.createDataFrame([(c, f, float(i)) for c in (45, 90, 180) for i, f in enumerate(NUMERIC_FEATURES)], "cutoff int, feature string, importance double")
    monkeypatch.setattr(lq, "features_of", again)
    monkeypatch.setattr(dq, "features_of", again)
    monkeypatch.setattr(lq, "stored_features", lambda spark, d: stored)
    monkeypatch.setattr(lq, "_ladder_importance", lambda spark, d: weights)
    assert {r["cutoff"] for r in lq._holdout_drift(spark, "").collect()} == {45, 90, 180}
