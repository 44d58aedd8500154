"""Compare registered queries with their SQL: python -m tests.oracle_check [--sf 0.01] [name ...]."""

from __future__ import annotations

import argparse
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(v) -> str:
    return "\\N" if v is None else repr(v)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types, row count or values; empty when equal."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} != {sorted(rel.columns)}"]
    kinds = dict(df.dtypes)
    theirs = {c: TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    problems = [f"type of {c}: {kinds[c]} != {theirs[c]}" for c in names if kinds[c] != theirs[c]]
    mine = sorted([_text(r[c]) for c in names] for r in df.select(*names).collect())
    at = [rel.columns.index(c) for c in names]
    other = sorted([_text(r[i]) for i in at] for r in rel.fetchall())
    if len(mine) != len(other):
        problems.append(f"rows {len(mine)} != {len(other)}")
    bad = [(a, b) for a, b in zip(mine, other) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {names}: {bad[0][0]} != {bad[0][1]}")
    return problems


def main(argv: list[str]) -> int:
    from cohortlens.catalog import load
    from cohortlens.functions.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    sf_dir = f"/root/testdata/sf{args.sf}"
    queries, oracles = load()
    spark = local_session("oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in args.names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                note = "ok"
            else:
                problems, note = [], f"rows only: {df.count()}"
        except Exception as exc:  # noqa: BLE001 - reported per query
            problems = [f"{type(exc).__name__}: {str(exc)[:700]}"]
        took = time.time() - start
        if problems:
            failed += 1
            print(f"FAIL {name} {took:.1f}s: {' ; '.join(problems)[:1500]}", flush=True)
        else:
            print(f"{note} {name} {took:.1f}s", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
