import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm.mixing import mix_to_targets, rake

DIMS = ("source", "lang")
POWERS = {"source": 0.5, "lang": 0.0}


def dims():
    return {d: F.col(d) for d in DIMS}


def test_raking_meets_the_marginals(spark):
    rng = np.random.default_rng(7)
    cells = [(f"a{i}", f"b{j}", int(rng.integers(1, 1000))) for i in range(6) for j in range(4)]
    df = spark.createDataFrame(cells, "a string, b string, tokens long")
    targets = {
        "a": {f"a{i}": (i + 1) / 21 for i in range(6)},
        "b": {f"b{j}": s for j, s in enumerate((0.4, 0.3, 0.2, 0.1))},
    }
    frames = {d: spark.createDataFrame(list(t.items()), "value string, target double") for d, t in targets.items()}
    got, error = rake(df, frames)
    assert error <= 1e-12
    for d, t in targets.items():
        for r in got.groupBy(d).agg(F.sum("share").alias("s")).collect():
            assert r["s"] == pytest.approx(t[r[d]], abs=1e-11)


def test_contradictory_targets_end(spark):
    """Each value of one dimension has one value of the other: the last dimension is met, the error says so."""
    df = spark.createDataFrame([("x", "p", 3), ("y", "q", 1), ("z", "q", 0)], "a string, b string, tokens long")
    frames = {
        "a": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "value string, target double"),
        "b": spark.createDataFrame([("p", 0.2), ("q", 0.8)], "value string, target double"),
    }
    got, error = rake(df, frames)
    assert {r["a"]: r["share"] for r in got.collect()} == {"x": pytest.approx(0.2), "y": pytest.approx(0.8), "z": 0.0}
    assert error == pytest.approx(0.3)


def test_weights_and_draws(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}", "en" if i % 4 else "fr") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mix_to_targets(df, dims(), POWERS, 0.5, carry={"doc_id": F.col("doc_id"), "kept": F.lit("clash")})
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "probability", "weight", "kept"]
    got = out.collect()
    total = sum(r["n_tokens"] for r in got)
    assert sum(r["n_tokens"] * r["probability"] * r["weight"] for r in got) == pytest.approx(total / 2)
    for lang in ("en", "fr"):
        assert sum(r["n_tokens"] * r["probability"] * r["weight"] for r in got if r["lang"] == lang) == pytest.approx(total / 4, rel=0.02)
    for r in got:
        draw = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["kept"] == (draw < r["probability"]) and 0 < r["probability"] <= 1 <= r["weight"]


def test_edge_rows(spark):
    rows = [(1, None, None, "en"), (2, "", "s", None), (3, "a b", None, None), (3, "a b", None, None), (None, "c", "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {(r["doc_id"], r["source"], r["lang"], r["n_tokens"], r["weight"] > 0) for r in mix_to_targets(df, dims(), POWERS, 1.0, carry={"doc_id": F.col("doc_id")}).collect()}
    assert got == {(1, "(none)", "en", 0, False), (2, "s", "(none)", 0, False), (3, "(none)", "(none)", 2, True), (None, "s", "en", 1, True)}
    assert mix_to_targets(df.where("false"), dims(), POWERS, 1.0).collect() == []
    empty = df.where("doc_id < 3")
    assert {r["kept"] for r in mix_to_targets(empty, dims(), POWERS, 1.0).collect()} == {True}
