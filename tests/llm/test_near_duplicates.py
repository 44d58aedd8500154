import random
import re

import pytest

from cohortlens.llm.near_duplicates import near_duplicates


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def texts(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß", "日本", "Abc"]
    rows, base = [], None
    for i in range(160):
        if base is None or rnd.random() < 0.25:
            base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 5, 9, 30, 80, 200, 900]))]
        words = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        if rnd.random() < 0.3:
            base = words
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(1000, ""), (1001, None), (1002, " \n"), (1003, "ONE two"), (1004, "one TWO"), (1005, "x" * 300_000)]


@pytest.mark.parametrize("k", [4, 5])
def test_brute_force(spark, k):
    rows = texts(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_duplicates(df, shingle=k).collect())) == brute(rows, k)


def test_chain_without_common_centre(spark):
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(12):  # each step replaces a few words, so ends of the chain are far apart
        base[15 * i : 15 * i + 5] = [f"n{i}_{j}" for j in range(5)]
        rows.append((i, " ".join(base)))
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()))
    assert got == brute(rows, 4)


def test_large_group_of_near_copies(spark):
    """Copies with few to many edits, some sharing edits: far ones stay apart, no link is lost."""
    rnd = random.Random(4)
    base = [f"t{i}" for i in range(150)]
    rows, kin = [], []
    for i in range(260):
        words = list(rnd.choice(kin) if kin and rnd.random() < 0.3 else base)
        for _ in range(rnd.choice([1, 2, 3, 4, 6, 9])):
            words[rnd.randrange(150)] = f"n{rnd.randrange(4000)}"
        if rnd.random() < 0.1:
            kin.append(words)
        rows.append((i, " ".join(words[: rnd.choice([150, 150, 150, 110])])))
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()))
    assert got == brute(rows, 4)


def test_edge_rows(spark):
    rows = [(1, "a b c d e", None), (1, "a b c d e", "x"), (None, "a b c d e", "x"), (None, None, None), (2, "A b c D e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, True), (None, 0, None, True), (2, 1, 1, False)], key=str)
    assert near_duplicates(df.where("false")).collect() == []
