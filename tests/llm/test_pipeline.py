"""Each stage against a plain version on its own input."""

import pytest

import corpus_pipeline
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_line_spread import brute as spread
from tests.llm.test_near_duplicates import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, spark.createDataFrame(out[-1], docs.schema if name == "language" else columns), SF)
        columns = docs.schema
        out.append(docs.collect())
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_language_keeps_texts_with_letters(steps):
    assert {r["doc_id"] for r in steps[1]} == {r["doc_id"] for r in steps[0] if any(c.isalpha() for c in r["text"] or "")}


def test_lines(steps):
    want = {i: t for i, t, _, _, n in spread([(r["doc_id"], r["text"], r["source"]) for r in steps[1]], 10) if not n or t.split()}
    assert {r["doc_id"]: r["text"] for r in steps[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2] if r["text"] != by_id(steps[1])[r["doc_id"]]["text"])


def test_one_of_each_group(steps):
    want = {i for i, _, _, kept in groups([(r["doc_id"], r["text"]) for r in steps[2]], 5) if kept}
    assert {r["doc_id"] for r in steps[3]} == want


def test_benchmark(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in steps[3]], items) if not r[5]}
    assert {r["doc_id"] for r in steps[4]} == want


def test_mix_and_columns(steps):
    before = by_id(steps[4])
    assert 0 < len(steps[5]) <= len(before)
    for r in steps[5]:
        assert r["text"] == before[r["doc_id"]]["text"] and r["weight"] >= 0
    for rows in steps[1:5]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_extra_and_empty(spark):
    rows = [(1, "some words here", "en", "s", 15, 9, "x"), (2, None, None, None, None, None, None), (None, "", "en", "s", 0, 1, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, weight int, kept string"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, SF)
            assert docs.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "weight", "kept"]
        assert [r["doc_id"] for r in docs.collect()] in ([], [1])


def test_long_passage_of_one_hot_source(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(i, f"own text {i}\n{passage}", "en", "hot", 300) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_boilerplate(spark, docs, SF).collect()}
    assert got[0] == f"own text 0\n{passage}" and [got[i] for i in range(1, 6)] == [f"own text {i}" for i in range(1, 6)]


def test_menu_line_of_one_word(spark):
    docs = spark.createDataFrame([(i, f"own text {i}\nImprint", "en", f"s{i}", 18) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_boilerplate(spark, docs, SF).collect()}
    assert got == {0: "own text 0\nImprint"} | {i: f"own text {i}" for i in range(1, 10)}


def test_odd_column_names_pass_through(spark, steps):
    """Names with dots, blanks and those that stages use inside come out as they went in."""
    odd = spark.createDataFrame(steps[0][:60], "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "doc_id AS `a.b`", "1 AS `my col`", "2 AS row", "3 AS n_lines", "4 AS kept", "5 AS score"
    )
    docs = odd
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        assert docs.columns[: len(odd.columns)] == odd.columns or name == "lines"
        assert set(odd.columns) <= set(docs.columns)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert all(r["a.b"] == r["doc_id"] and r["my col"] == 1 for r in docs.collect())
