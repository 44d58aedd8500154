import random
import re
from collections import Counter

from cohortlens.llm.collocations import collocations


def brute(docs, least, top, percent=80):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    out = {}
    common = {p: a for p, a in f.items() if a >= least}
    for (lang, ws), a in common.items():
        if len(ws) == 1:
            continue
        longer = [b for (x, v), b in common.items() if x == lang and len(v) > len(ws) and any(v[i : i + len(ws)] == ws for i in range(len(v)))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = [(2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    rows = []
    for lang, found in out.items():
        for i, (s, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            rows.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(rows)


def test_brute_force(spark):
    rnd = random.Random(11)
    vocab = ["the", "The", "of", "x|y", "école", "中文", "a" * 300, "b'", "c d"] + [f"w{i}" for i in range(12)]
    phrases = ["New York City hall", "new york", "of the the of", "中文 école the"]
    docs = []
    for d in range(150):
        ws = [rnd.choice(phrases) if rnd.random() < 0.3 else rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 40]))]
        docs.append(("".join(w + rnd.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", ";\r"] if rnd.random() < 0.2 else [" "]) for w in ws), rnd.choice(["en", "fr", None, "und"])))
    docs += [("the the the the the " * 30, "en"), (None, "en"), ("", None), ("\n.,", "fr"), (docs[3][0], "fr"), (docs[3][0], "fr")]
    df = spark.createDataFrame([(t, x, 1, "s") for t, x in docs], "text string, lang string, word int, `a.b` string").repartition(3)
    for least, top in ((5, 1000), (2, 7)):
        got = sorted(map(tuple, collocations(df, min_count=least, top=top).collect()))
        assert got == brute(docs, least, top)
    assert collocations(df.where("false")).collect() == []


def test_counts_beyond_64_bits_of_products(spark):
    from cohortlens.llm import collocations as c

    df = spark.createDataFrame([("a b",)] * 40, "text string").selectExpr("text", "'x' AS lang")
    got = c.collocations(df, factor=10**9).first()
    assert (got["a"], got["l"], got["r"], got["score"]) == (40, 40, 40, 10**9 // 2)
