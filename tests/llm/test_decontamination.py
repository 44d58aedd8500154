import hashlib
import random
import re

from cohortlens.llm.decontamination import decontaminate

RULE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return RULE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=13):
    windows = {}
    for i, t in items:
        ws = split(t)
        n = min(len(ws), size)
        for s in range(len(ws) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(ws[s : s + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        ws, hit, found = split(t), set(), set()
        for n in sizes:
            for s in range(len(ws) - n + 1):
                ids = windows.get(tuple(ws[s : s + n]))
                if ids:
                    hit |= set(range(s, s + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(ws), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def test_brute_force(spark):
    rnd = random.Random(8)
    vocab = ["a", "b", "c", "É", "naïve", "x9", "Qu"] + [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 12, 13, 14, 40, 90])]
    items += [(20, items[9][1]), (21, None), (None, "v1 v2"), (22, "a a a a a a a a a a a a a a a"), (7, "again v3")]
    docs = []
    for d in range(60):
        ws = [rnd.choice(vocab[8:] if d % 3 else vocab) for _ in range(rnd.choice([0, 5, 30, 400]))]
        for _ in range(rnd.choice([0, 1, 3])):
            part = split(rnd.choice(items)[1])
            lo = rnd.randrange(len(part) + 1)
            ws[rnd.randrange(len(ws) + 1) : 0] = part[lo : lo + rnd.choice([12, 13, 20, 90])]
        docs.append((d, rnd.choice([" ", ", ", "--\n"]).join(ws)))
    docs += [(100, None), (101, ""), (102, "a " * 900), (3, docs[3][1]), (None, items[10][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate(df, bench).collect()), key=str) == brute(docs, items)
    assert [tuple(r)[2:4] for r in decontaminate(df, bench.where("false")).collect()] == [(0, 0)] * len(docs)
    assert decontaminate(df.where("false"), bench).collect() == []
