"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from cohortlens.catalog.registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    from cohortlens.catalog import (  # noqa: F401
        cohort_queries,
        drift_queries,
        evaluation_queries,
        feature_queries,
        ladder_queries,
        rd_queries,
        source_queries,
    )

    return QUERIES, ORACLES
