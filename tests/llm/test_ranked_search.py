import math
import random
import re

import numpy as np

from cohortlens.llm import ranked_search as rs

RULE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(t):
    return RULE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, top=50):
    texts = [(d, split(t)) for d, t in docs]
    texts = [(d, ws) for d, ws in texts if ws]
    nd, nt = len(texts), sum(len(ws) for _, ws in texts)
    df = {}
    for _, ws in texts:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, ws in texts:
            m = 50 + 50 * len(ws) * nd // nt
            score = 0
            for w in terms & set(ws):
                tf = ws.count(w)
                score += math.floor(1000 * math.log((2 * nd + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = ["the", "The", "of", "É", "naïve", "x9", "中文"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(d, rnd.choice([" ", ", ", "_"]).join(rnd.choices(vocab, weights, k=rnd.choice([0, 1, 6, 30, 200])))) for d in range(n)]
    docs += [(7, docs[7][1]), (8, "other the w3"), (None, docs[9][1]), (901, None), (902, ""), (903, "w5 " * 3000), (904, docs[20][1]), (905, docs[20][1])]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 9])))) for i in range(9)]
    items += [(3, "w11 unheard"), (50, None), (None, "the"), (51, "unheard"), (52, "the the of"), (53, "!!")]
    return docs, items


def test_brute_force(spark):
    docs, items = corpus(12, 300)
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in docs], "doc_id long, text string, item_id int, `a.b` string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for kw in ({}, {"top": 3}, {"terms_per_pass": 10, "top": 5}):
        got = sorted(map(tuple, rs.ranked_search(df, bench, **kw).collect()), key=str)
        assert got == brute(docs, items, kw.get("top", 50))
    assert rs.ranked_search(df.where("false"), bench).collect() == []
    assert rs.ranked_search(df, bench.where("false")).collect() == []


def test_accumulators_stop_and_survivors_are_exact():
    """Many blocks and a small k: creation stops early, results are those of full scoring."""
    rnd = np.random.default_rng(5)
    weight = np.array([9000, 5000, 900, 40, 7])
    plan = rs.Plan(weight, np.arange(5), np.array([0, 5]), 4000, 400000, 4)
    ranking, every, touched = rs.Ranking(plan), [], 0
    for block in range(8):
        ids = np.arange(block * 500, block * 500 + 500)
        n = rnd.integers(20, 300, 500)
        held = rnd.random((500, 5)) < np.array([0.02, 0.1, 0.5, 0.9, 1.0])
        first = np.concatenate(([0], np.cumsum(held.sum(1))))
        terms = np.nonzero(held)[1]
        tf = rnd.integers(1, 9, terms.size)
        ranking.take(ids, n, terms, tf, first)
        for i in range(500):
            m = 50 + 50 * int(n[i]) * 4000 // 400000
            t, c = terms[first[i] : first[i + 1]], tf[first[i] : first[i + 1]]
            every.append((-sum(int(weight[a]) * (10**9 * int(b) // (1000 * int(b) + 20 * m)) for a, b in zip(t, c)), int(ids[i])))
    assert list(zip((-ranking.scores[0]).tolist(), ranking.ids[0].tolist())) == sorted(every)[:4]


def test_long_lengths_do_not_overflow():
    plan = rs.Plan(np.array([1]), np.array([0]), np.array([0, 1]), 10**11, 10**13, 1)
    n = np.array([1, 10**9])
    assert rs._length_part(n, plan).tolist() == [50 + 50 * int(v) * 10**11 // 10**13 for v in n]
