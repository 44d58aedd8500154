"""Study queries on the full specification."""

from cohortlens.catalog import load
from cohortlens.operators import discontinuity as rd
from cohortlens.operators import features

QUERIES, _ = load()


def test_balance_covers_all_characteristics(spark, sf_dir):
    rows = QUERIES["rd_study_balance_all"](spark, sf_dir).collect()
    assert {r["covariate"] for r in rows} == {
        "num_of_prev_attempts", "studied_credits", "gender", "region", "highest_education", "imd_band", "age_band", "disability"
    }


def test_every_bandwidth(spark, sf_dir):
    assert sorted(r["bandwidth"] for r in QUERIES["rd_study_bandwidths_all"](spark, sf_dir).collect()) == rd.BANDWIDTHS
    assert [r["bandwidth"] for r in QUERIES["rd_study_donut_primary"](spark, sf_dir).collect()] == [rd.PRIMARY_BANDWIDTH]


def test_drift_of_every_feature(spark, sf_dir):
    rows = QUERIES["feature_psi_report"](spark, sf_dir).collect()
    assert {(r["cutoff"], r["feature"]) for r in rows} == {
        (c, f) for c in (45, 90, 180) for f in [*features.NUMERIC_FEATURES, *features.CATEGORICAL_FEATURES]
    }
    assert all(r["psi"] >= 0 for r in rows)
