import pytest

from cohortlens.llm.token_counts import VOCABULARY, encoding, token_counts


def brute(text, enc, rule):
    """Character owners of every token, found by decoding growing prefixes of bytes."""
    raw, at = text.encode(), 0
    bounds, lo = [], 0
    for part in text.split("\n") if text else []:
        bounds.append((lo, lo + len(part)))
        lo += len(part) + 1
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, outside, crossing, ids = [0] * len(bounds), 0, 0, enc.encode_ordinary(text)
    for t in ids:
        n = len(enc.decode_single_token_bytes(t))
        chars = sorted(set(char_of[at : at + n]))
        at += n
        share = {k: sum(a <= c < b for c in chars) for k, (a, b) in enumerate(bounds)}
        share = {k: v for k, v in share.items() if v}
        crossing += len(share) > 1
        if share:
            counts[{"most": max(share, key=lambda k: (share[k], -k)), "first": min(share), "last": max(share)}[rule]] += 1
        else:
            outside += 1
    assert at == len(raw)
    return len(ids), counts, outside, crossing


TEXTS = ["", None, "one line", "a\nb", "x\n\n\ny ", "\n", "é\nß日本\n😀😀 ok", "tabs\t\n  \n z", "word " * 3000, "\n".join("l%d é" % i for i in range(300)), " \n \n a\n  b\r\n"]


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_brute_force(spark, rule):
    enc = encoding(open(VOCABULARY, "rb").read())
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, sections int")
    got = {r["doc_id"]: (r["n_tokens"], [s["n_tokens"] for s in r["sections"]], r["n_outside"], r["n_crossing"]) for r in token_counts(df, rule=rule).collect()}
    assert got == {i: brute(t or "", enc, rule) for i, t in enumerate(TEXTS)}


def test_documents_keep_every_token(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc = encoding(open(VOCABULARY, "rb").read())
    want = {r["doc_id"]: brute(r["text"] or "", enc, "most") for r in docs.collect()}
    for r in token_counts(docs).collect():
        sections = [s["n_tokens"] for s in r["sections"]]
        assert (r["n_tokens"], sections, r["n_outside"], r["n_crossing"]) == want[r["doc_id"]]
        assert r["n_tokens"] == sum(sections) + r["n_outside"]
    assert token_counts(docs.where("false")).collect() == []
