import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from cohortlens.llm import language_id as li
from cohortlens.llm.language_id import fit_languages, identify_languages, predict_languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.99


def test_label_of_a_held_out_row_is_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    turned = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, identify_languages(d).collect())) for d in (docs, turned))
    assert a == b


def test_edge_rows(spark):
    rows = [(1, "the house and the dog", "en"), (2, "der Hund und das Haus", "de"), (None, None, "de"), (3, "12 *** !", None), (4, "", "en"), (5, "UND DAS HAUS " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_languages(docs, model, keep={"doc_id": F.col("doc_id")}).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[5][0] == "de"
    assert got[None] == got[3] == got[4] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    none = docs.where("lang = 'nothing'")
    assert {r["lang_pred"] for r in predict_languages(docs, fit_languages(none)).collect()} == {"und"}
    assert predict_languages(none, model).collect() == []


def test_naive_bayes_by_hand(spark, monkeypatch):
    """Counts, weights and posteriors of a small model against the formulas, with the matrix in several parts."""
    from collections import Counter

    import numpy as np

    from cohortlens.llm import language_id as li

    monkeypatch.setattr(li, "SHARD_CLASSES", 2)
    texts = {"a": ["abba aab", "ab"], "b": ["bcbc bc, cb", "cab"], "c": ["xyz zyx xy"], "d": ["\u00e9\u00e8 \u00e9a"], "e": ["qq q", "qa"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((g, t) for g, ts in texts.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(t):
        points = np.array([ord(c) for c in t.lower()], np.int64)
        return li._grams(points, np.array([0, points.size]))[0].tolist()

    counts = {g: Counter(b for t in ts for b in grams(t)) for g, ts in texts.items()}
    ask = ["abc", "zzz xyz", "q", "\u00e9", "ab" * 5000, "\u00b2 \u00bd 12", "", None, "\u00aa"]
    got = li.predict_languages(spark.createDataFrame([(i, t) for i, t in enumerate(ask)], "i int, text string"), li.fit_languages(df), keep={"i": F.col("i")})
    for r in got.collect():
        t = ask[r["i"]]
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        scores = []
        for g, ts in texts.items():
            total = sum(counts[g].values()) + li.SMOOTHING * li.BUCKETS
            scores.append(np.log(len(ts) / len(rows)) + sum(np.log((counts[g][b] + li.SMOOTHING) / total) for b in grams(t)))
        odds = np.exp(np.array(scores) - max(scores))
        assert r["lang_pred"] == list(texts)[int(odds.argmax())] and abs(r["score"] - odds.max() / odds.sum()) < 1e-3


def test_memory_of_a_batch_does_not_grow_with_its_texts():
    texts = ["der schnelle braune fuchs springt " * 60] * 1000
    batch = pa.RecordBatch.from_pydict({"lang": ["de"] * 1000, "text": texts})
    tracemalloc.start()
    found = list(li._count(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(found[0].column("n").to_pylist()) > 1000 * 60 * 27 * 2 and peak < 25 << 20
