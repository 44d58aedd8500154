from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.catalog.fixture_sql import with_ctes
from cohortlens.functions.scalars import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query. ``sql`` may use the fixture CTEs of :mod:`fixture_sql` by name.

    Doubles are rounded on the way out, as the SQL does with ``r(..)``.
    """

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            kinds = dict(df.dtypes)
            return df.select(
                *[rounded(c, digits).alias(c) if kinds[c] == "double" else df[c] for c in df.columns]
            )

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, digits)
        return fn

    return wrap
