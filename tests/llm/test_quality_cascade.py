import random
import re

from pyspark.sql import functions as F

from cohortlens.llm.quality_cascade import Rule, cascade_order, quality_cascade, text_counts

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i : i + 3]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(ws), len(covered)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_brute_force(spark):
    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "a b c"), (6, "a a a a"), (7, "x " * 30_000), (None, "é ß\r\n日本 #|"), (5, "a b c")]
    for i in range(150):
        vocab = [f"w{k}" for k in range(rnd.choice([3, 20, 400]))] + ["#", "É|x", "***"]
        words = [rnd.choice(vocab) + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(rnd.choice([0, 3, 49, 50, 51, 300]))]
        rows.append((100 + i, "".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x")).repartition(3)
    got = quality_cascade(df)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert got.where("base_failed and kept").count() == 0
    assert quality_cascade(df.where("false")).collect() == []


def test_verdicts_do_not_depend_on_the_order(spark):
    clean = " ".join(f"word{k} goes" for k in range(60))
    rows = [(1, clean), (2, clean.upper()), (3, clean.replace("goes", "goes***")), (4, "\n".join(["one line of it"] * 9 + [clean]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality_cascade(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    rules = [Rule("never", F.lit(False)), Rule("unknown", F.lit(None).cast("boolean")), Rule("capitals", F.upper("text") == F.col("text"))]
    for order in (rules, rules[::-1]):
        assert {r["doc_id"]: r["kept"] for r in quality_cascade(df, order).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert cascade_order(df, rules)[0].name == "capitals"


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = text_counts(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
