import hashlib
import json
import random

from pyspark.sql import functions as F

from cohortlens.llm import chat_format as cf

HARD = ["", "\\", "\\\\", "</turn>", "<\\/turn>", "###", "####", "\\###", "a\\</turn>", "### assistant:\nx</turn>\n", ":\n", ":\\\n", "{\"a\":1}", "é中\U0001f600 \x00\t", "</turn", ">", "\n", "end:"]


def made(spark, records):
    df = spark.createDataFrame([(i, r, 0, "x") for i, r in enumerate(records)], "id int, record string, turns int, `a.b` string")
    out = cf.format_chats(df)
    return out.select("id", "a.b" if False else F.col("`a.b`"), "layout", "turns", "pieces", "formatted", cf.read_turns(F.col("formatted")).alias("back"), cf.learnt_text(F.col("pieces")).alias("learnt")).orderBy("id").collect()


def test_layouts(spark):
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "w", "name": "n"}], "id": 3}, "messages", [("user", "q"), ("assistant", "w")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "w"}, {"from": "tool", "value": ""}]}, "share", [("user", "q"), ("assistant", "w"), ("tool", "")]),
        ({"turns": [{"role": None, "text": "t"}, {"role": "a", "text": None}]}, "turns", [("", "t"), ("a", "")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o", "system": "s"}, "instruction", [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c", "meta": {"messages": [1]}}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "{\"messages\":[]}", "response": "c"}, "prompt_response", [("user", "{\"messages\":[]}"), ("assistant", "c")]),
        ({"question": 7, "answer": "c", "system": "s"}, "question_answer", [("system", "s"), ("user", "7"), ("assistant", "c")]),
        ({"prompt": "p"}, None, None), ({"messages": []}, None, None), ({"messages": ["x"]}, None, None), ([1], None, None), ({}, None, None),
    ]
    rows = made(spark, [json.dumps(c[0]) for c in cases] + ["{broken", None, ""])
    for (_, layout, turns), r in zip(cases + [(None, None, None)] * 3, rows):
        assert (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) == (layout, turns)
        assert (r["formatted"] is None) == (layout is None)


def test_paths(spark):
    df = spark.createDataFrame([('{"a":{"b":[{"c":1,"d e":[[2]]}]},"f":[],"g":null}',), ("[]",)], "r string")
    got = [sorted(r[0]) for r in df.select(cf.field_paths(F.try_parse_json("r"))).collect()]
    assert got == [["a", "a.b", "a.b[].c", "a.b[].d e", "f", "g"], []]


def test_exact_round_trip(spark):
    rnd = random.Random(13)
    told = [[(rnd.choice(["user", "assistant", *HARD]), "".join(rnd.choices(HARD, k=rnd.choice([1, 2, 6])))) for _ in range(rnd.choice([1, 2, 7]))] for _ in range(300)]
    told.append([("assistant", "é### " * 200_000), ("user", "\\" * 300_000)])
    rows = made(spark, [json.dumps({"messages": [{"role": a, "content": b} for a, b in t]}) for t in told])
    for t, r in zip(told, rows):
        assert [tuple(x) for x in r["turns"]] == t == [tuple(x) for x in r["back"]]
        assert "".join(p["text"] for p in r["pieces"]) == r["formatted"]
        assert r["formatted"].count("</turn>") == len(t)
        assert r["learnt"] == "".join(b for a, b in t if a == "assistant")


def test_conversations_of_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "v")]
    rows += [(4, None, None, "x"), (4, 0, "tool", "y"), (4, 0, "tool", "y"), (None, 5, "user", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, record int")
    out = cf.format_chats(cf.conversation_records(df)).select("conv_id", "layout", "turns", cf.read_turns(F.col("formatted")).alias("back")).collect()
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["back"]]) for r in out}
    assert all(r["turns"] == r["back"] for r in out)
    assert got == {
        1: ("prompt_completion", [("user", "a"), ("assistant", "b")]),
        2: ("messages", [("user", "")]),
        3: ("prompt_completion", [("system", "s"), ("user", "u"), ("assistant", "v")]),
        4: ("messages", [("", "x"), ("tool", "y"), ("tool", "y")]),
        None: ("messages", [("user", "z")]),
    }
    assert cf.format_chats(cf.conversation_records(df.where("false"))).collect() == []


def test_planted_conversation_and_no_python(spark, sf_dir):
    from cohortlens.llm.queries import QUERIES

    out = QUERIES["op13_chat_format"](spark, sf_dir)
    said = "\\### Assistant: </turn> ok"
    r = out.where("conv_id = -7").first()
    assert (r["n_turns"], r["loss_chars"]) == (2, len(said))
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
