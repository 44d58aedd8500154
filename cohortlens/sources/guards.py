"""The only ways to read rows by split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values
SPLITS = ["train", "validate", "test"]
HOLDOUT = "test"


class HoldoutError(RuntimeError):
    """The holdout was asked for where it must stay closed."""


def load_split(table: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Rows of the named splits. Refuses the holdout, unknown names and an empty list."""
    if not splits:
        raise ValueError("name at least one split")
    unknown = sorted(set(splits) - set(SPLITS))
    if unknown:
        raise ValueError(f"unknown splits: {unknown}")
    if HOLDOUT in splits:
        raise HoldoutError("the holdout is closed here; use open_holdout with a reason")
    return table.where(F.col("split").isin(list(splits)))


def open_holdout(table: DataFrame, reason: str) -> DataFrame:
    """Rows of the holdout. The reason must say why it is opened."""
    if not reason.strip():
        raise HoldoutError("opening the holdout needs a reason")
    return table.where(F.col("split") == HOLDOUT)
