"""Sparse design matrix against the dense one, and with very many levels."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from cohortlens.operators import sparse_design as sd
from cohortlens.operators.prep import fit_design

ROWS = [(i, None if i % 4 == 0 else float(i % 9), "a b"[i % 3], None if i % 5 == 0 else f"v{i % 7}") for i in range(60)]
NEW = [(100, 3.0, "a", None), (101, None, "z", "v3"), (102, 1.0, None, "new"), (103, None, None, None)]
SCHEMA = "id int, n double, c string, d string"


def dense_of(size, indices, values):
    out = [0.0] * size
    for i, v in zip(indices, values):
        out[i] = v
    return out


@pytest.fixture(params=[sd.BROADCAST_BYTES, -1], ids=["broadcast", "dealt"])
def either_join(request, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_BYTES", request.param)


def test_same_matrix_as_the_dense_design(spark, either_join):
    fit, new = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    design = sd.fit_sparse_design(fit, ["n"], ["c", "d"])
    plain = fit_design(fit, ["n"], ["c", "d"])
    wide = plain.apply(new, ["id"])
    want = {r[0]: [float(v) for v in r[1:]] for r in wide.collect()}
    assert design.n_columns == len(plain.columns)
    got = design.apply(new, ["id"]).collect()
    assert {r["id"]: dense_of(*r["features"]) for r in got} == want
    assert all(r["features"]["indices"] == sorted(r["features"]["indices"]) for r in got)
    assert {r["id"]: list(r["features"].toArray()) for r in design.vectors(new, ["id"]).collect()} == want


def test_only_numbers_only_levels_and_no_rows(spark):
    fit = spark.createDataFrame(ROWS, SCHEMA)
    numbers = sd.fit_sparse_design(fit, ["n"], [])
    assert numbers.n_columns == 2 and len(numbers.vectors(fit, ["id"]).first()["features"].toArray()) == 2
    levels = sd.fit_sparse_design(fit, [], ["d"])
    assert levels.n_columns == 8 and levels.apply(fit, ["id"]).where("size(features.indices) = 1").count() == 60
    none = sd.fit_sparse_design(fit.where("id < 0"), [], ["d"])
    assert none.n_columns == 0 and {len(r["features"]["indices"]) for r in none.apply(fit, ["id"]).collect()} == {0}


def test_a_hundred_thousand_levels(spark):
    """Half of the rows share one level; levels are in no plan, and a model fits on the vectors."""
    n = 100_000
    level = F.when(F.col("id") % 2 == 0, F.lit("common")).otherwise(F.concat(F.lit("k"), (F.col("id") / 2).cast("long")))
    rows = spark.range(2 * n).select("id", level.alias("k"), (F.col("id") % 10).cast("double").alias("n"), (F.col("id") % 2).cast("double").alias("y"))
    design = sd.fit_sparse_design(rows, ["n"], ["k"])
    assert design.n_columns == n + 2
    made = design.apply(rows, ["id", "y"])
    assert len(made._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = made.agg(F.sum(F.size("features.indices")).alias("cells"), F.countDistinct(F.element_at("features.indices", -1)).alias("columns"), F.max(F.element_at("features.indices", -1)).alias("last")).first()
    assert (got["cells"], got["columns"], got["last"]) == (4 * n, n + 1, n + 1)
    weights = spark.range(n + 2).select(F.col("id").alias("column"), F.when(F.col("id") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("weight"))
    total = sd.scores(made.where("id < 1000"), ["id"], weights).agg(F.sum("score"), F.count("score")).first()
    assert tuple(total) == (1000.0, 1000)
    fitted = LogisticRegression(maxIter=2, labelCol="y").fit(design.vectors(rows.where("id < 20000"), ["y"]))
    assert fitted.numFeatures == n + 2 and fitted.coefficients[1] < 0
