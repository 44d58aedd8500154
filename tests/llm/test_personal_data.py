import random
import re

from cohortlens.llm.personal_data import automaton, iban, luhn, personal_data, scan

ANCHORS = automaton()


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def base(t):
    return [s for s in scan(t, ANCHORS) if s[0] in ("email", "ip", "card", "phone")]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    bits = ["a", "@", ".", "b.c", "-", " ", "1", "22", "255.", "256", "0", "+", "(", ")", "4111111111111111", "é", "+1 (234) 555-0199", "x@y.z", "%", "_", "😀", "10.0.0.1", "\n"]
    for _ in range(20_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14)))
        assert base(t) == brute(t), repr(t)


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: brute(r["text"] or "") for r in docs.collect()}
    for r in personal_data(docs).collect():
        assert [tuple(s) for s in r["spans"] if s["kind"] in ("email", "ip", "card", "phone")] == want[r["doc_id"]]


def test_added_spans():
    assert iban("DE89370400440532013000") and not iban("DE89370400440532013001")
    found = lambda t: [(k, t[s:e]) for k, s, e in scan(t, ANCHORS) if k in ("address", "account")]
    assert found("pay DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("Account number: 12-345678, thanks") == [("account", "12-345678")]
    assert found("see tel:+1-201-555-0123 or ftp://joe:pw@host.example/x") == [("address", "tel:+1-201-555-0123"), ("address", "ftp://joe:pw@host.example")]
    assert found("on account of 3 reasons; accountable 1234567; DE1 sale; tel: none; https://example.com/a") == []


def test_linear_on_long_texts():
    for t in ("1" * 400_000, "1." * 200_000, "a" * 300_000 + "@" * 1000, "@a" * 100_000, "+1((" * 100_000, "1 " * 200_000):
        assert base(t) is not None


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 2), (1, "", 2), (None, "a@b.co", 2), (None, "a@b.co", 2)], "doc_id long, text string, spans int")
    assert sorted(len(r["spans"]) for r in personal_data(df).collect()) == [0, 0, 1, 1]
    assert personal_data(df.where("false")).collect() == []


def test_nothing_lost_to_what_follows_or_to_length():
    found = lambda t: [(k, t[s:e]) for k, s, e in scan(t, ANCHORS) if k in ("address", "account")]
    code = "GB82 WEST 1234 5698 7654 32"
    for t in (f"{code} BIC NWBKGB2L", f"IBAN: {code} BIC NWBKGB2L", f"iban {code} 2024", f"Konto {code}, DE89370400440532013000 EUR"):
        assert found(t)[0] == ("account", code)
    assert found("Konto x, DE89370400440532013000 EUR 5") == [("account", "DE89370400440532013000")]
    assert found(f"{code}1") == []
    for cue in ("Social Security", "sOCIAL security", "SSN", "Account Number:"):
        assert found(f"İ {cue} 123-45-6789") == [("account", "123-45-6789")]
    phone, user, word = "+1 (201) 555 - 01 23 - 45 67", "u" * 90, "p:" * 50
    assert found(f"Tel:{phone}, Mailto:{user}@host.example") == [("address", f"Tel:{phone}"), ("address", f"Mailto:{user}@host.example")]
    assert found(f"HtTps://{user}:{word}@host.example/x") == [("address", f"HtTps://{user}:{word}@host.example")]
    for t in ("mailto:a:" * 100_000, "mailto:a:" * 100_000 + "@" + "h." * 100_000, "tel:" + "1 (" * 100_000):
        assert scan(t, ANCHORS) is not None
