import random

from cohortlens.llm.line_spread import dedup_lines


def brute(rows, sites):
    """Rows (doc_id, text, source); text parts seen on enough sites stay at their first place."""
    seen, first = {}, {}
    for i, t, s in rows:
        for pos, line in enumerate((t or "").split("\n")):
            key = " ".join(line.split()).lower()
            if " " in key:
                seen.setdefault(key, set()).update([s] if s is not None else [])
                first[key] = min(first.get(key, (float("inf"), 0)), (i, pos))
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, s, 0, 0))
            continue
        kept = []
        for pos, line in enumerate(t.split("\n")):
            key = " ".join(line.split()).lower()
            if " " not in key or len(seen[key]) < sites or first[key] == (i, pos):
                kept.append(line)
        n = len(t.split("\n"))
        out.append((i, "\n".join(kept), s, n, n - len(kept)))
    return sorted(out, key=str)


def test_brute_force(spark):
    rnd = random.Random(6)
    shared = [f"shared line number {k}" for k in range(12)]
    rows = []
    for i in range(300):
        lines = [rnd.choice([*shared[: rnd.choice([2, 6, 12])], f"own line {i} {k}", "word", "", " Shared  LINE number 3 "]) for k in range(rnd.randrange(1, 9))]
        rows.append((i, "\n".join(lines), rnd.choice([None, *(f"s{k}" for k in range(14))])))
    rows += [(400, None, "s1"), (401, "", "s2"), (402, "\n\n", "s3"), (403, "w " * 100_000 + "\nshared line number 1", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for sites in (3, 10, 14):
        assert sorted(map(tuple, dedup_lines(df, sites).collect()), key=str) == brute(rows, sites)


def test_edge_rows(spark):
    rows = [(1, "a b\nc d", f"s{k}", 7) for k in range(3)] + [(None, "a b", "s9", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = dedup_lines(df, 3)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    # Equal documents keep their first lines; a NULL id comes first.
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "a b"), (1, "c d"), (1, "c d"), (1, "c d")]
    assert dedup_lines(df.where("false")).collect() == []


def test_long_lines_by_sites_and_documents(spark):
    """A long line that repeats inside one source, on a few sources or without a source stays at its first place only."""
    texts = {c: " ".join(f"{c}{k}" for k in range(50)) for c in "abcdef"}
    short = " ".join(f"g{k}" for k in range(49))
    rows = [(i, f"{texts['a']}\nown {i}", "hot") for i in range(5)]  # five documents of one site
    rows += [(10 + i, f"{texts['b']}\nown {i}", f"s{i}") for i in range(3)]  # three sites
    rows += [(20 + i, f"{texts['c']}\nown {i}", None) for i in range(4)]  # four documents without a site
    rows += [(30 + i, f"{texts['d']}\nown {i}", "hot") for i in range(3)]  # three documents of one site: not enough
    rows += [(40, f"{texts['e']}\n" * 6 + "own", "hot")]  # six times in one document: not enough
    rows += [(50, f"{texts['f']}\nown", "hot")] * 6  # rows of one document: not enough
    rows += [(60 + i, f"{short}\nown {i}", f"s{i % 9}") for i in range(20)]  # a shorter line below the spread
    rows += [(90 + i, "字" * 100 + f"和 字\nown {i}", "hot") for i in range(4)]  # a script without blanks
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(df, long_sites=3, long_docs=4).collect()}
    assert {i for i, n in got.items() if n} == {1, 2, 3, 4, 11, 12, 21, 22, 23, 91, 92, 93} and max(got.values()) == 1
    assert not any(r["n_removed"] for r in dedup_lines(df).collect())


def test_lines_of_one_word(spark):
    """Without blanks inside, a line is still counted; a blank line never is."""
    rows = [(i, f"\n  \nImprint\n版权所有翻印必究\nown{i}", f"s{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(df, one_word=True).collect()}
    assert got == {0: (rows[0][1], 0)} | {i: (f"\n  \nown{i}", 2) for i in range(1, 10)}
    assert sum(r["n_removed"] for r in dedup_lines(df, 11, one_word=True).collect()) == 0
