"""Columns by their plain name, whatever characters it has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """Column of exactly this name: dots and blanks are part of it, never a path."""
    return F.col("`" + column.replace("`", "``") + "`")
