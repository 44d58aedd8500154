"""Sparse design matrix: category levels are rows of a table, so their number is bounded by storage and not by a plan.

The columns are those of :class:`cohortlens.operators.prep.Design`: numeric features, indicators, then the levels of each
categorical feature in byte order. Use that one for a few hundred levels that models read by name, this one for ids.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hot_join import hot_join
from cohortlens.functions.scalars import null_as_token
from cohortlens.functions.session import stage
from cohortlens.operators.prep import category_levels, fit_design

#: Levels of a feature are broadcast up to this many bytes of text and positions; beyond it rows and levels are dealt by level.
BROADCAST_BYTES = 8 << 20
_LEVEL_COST = 32


def numbered_levels(levels: DataFrame, order: Sequence[str]) -> DataFrame:
    """(feature, level, column, in_feature): positions from 0 by feature in the given order and level, over all and inside a feature.

    Levels are cut into ranges, range sizes give offsets, and numbering happens inside a range.
    """
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("feature")).cast("int")
    parts = int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["_place", "level"]
    # Written out, because ranges come from a sample and must be the same for sizes and rows.
    ranged = stage(levels.withColumn("_place", place).repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "levels")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*by)
    numbered = ranged.join(offsets, "_part").withColumn("column", F.col("_offset") + F.row_number().over(inside) - 1)
    first = numbered.groupBy("feature").agg(F.min("column").alias("_first"))
    return numbered.join(first, "feature").select("feature", "level", "column", (F.col("column") - F.col("_first")).alias("in_feature"))


@dataclass(frozen=True)
class SparseDesign:
    """What fitting leaves behind: a few numbers per feature, and the levels as a stored table."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    median: Mapping[str, float]
    mean: Mapping[str, float]
    std: Mapping[str, float]
    indicators: Sequence[str]
    levels: DataFrame
    n_levels: Mapping[str, int]
    level_bytes: Mapping[str, int]

    @property
    def n_dense(self) -> int:
        return len(self.numeric) + len(self.indicators)

    @property
    def n_columns(self) -> int:
        return self.n_dense + sum(self.n_levels.values())

    def _dense(self) -> list[Column]:
        scaled = [(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(self.median[f])) - self.mean[f]) / self.std[f] for f in self.numeric]
        return scaled + [F.col(f"`{f}`").isNull().cast("double") for f in self.indicators]

    def indexed(self, df: DataFrame, keep: Sequence[str], position: str) -> DataFrame:
        """``keep``, the dense columns as array ``_dense``, and per categorical feature i its level's ``position`` as ``_at{i}``.

        An unknown level has NULL. A feature whose levels fit :data:`BROADCAST_BYTES` costs no shuffle; rows of a larger
        one are joined by level with frequent levels dealt over tasks.
        """
        named = [null_as_token(F.col(f"`{f}`")).alias(f"_level{i}") for i, f in enumerate(self.categorical)]
        rows = df.select(*[F.col(f"`{c}`") for c in keep], F.array(*self._dense()).cast("array<double>").alias("_dense"), *named)
        for i, f in enumerate(self.categorical):
            mine = self.levels.where(F.col("feature") == f).select(F.col("level").alias(f"_level{i}"), F.col(position).alias(f"_at{i}"))
            if self.level_bytes.get(f, 0) <= BROADCAST_BYTES:
                rows = rows.join(F.broadcast(mine), f"_level{i}", "left")
            else:
                rows = hot_join(stage(rows, "indexed"), mine, [f"_level{i}"], "left")
        return rows.drop(*[f"_level{i}" for i in range(len(self.categorical))])

    def apply(self, df: DataFrame, keep: Sequence[str], out: str = "features") -> DataFrame:
        """``keep`` plus ``out``, a struct (size, indices, values) of the columns that are not zero, indices ascending."""
        rows = self.indexed(df, keep, "column")
        dense = F.transform("_dense", lambda v, i: F.struct(i.cast("long").alias("i"), v.alias("v")))
        hot = [F.struct((F.col(f"_at{i}") + self.n_dense).cast("long").alias("i"), F.lit(1.0).alias("v")) for i in range(len(self.categorical))]
        cells = F.filter(F.concat(dense, F.array(*hot)) if hot else dense, lambda t: t["i"].isNotNull() & (t["v"] != 0.0))
        cell = rows.select(*[F.col(f"`{c}`") for c in keep], cells.alias("_cells"))
        parts = [
            F.lit(self.n_columns).cast("long").alias("size"),
            F.transform("_cells", lambda t: t["i"]).alias("indices"),
            F.transform("_cells", lambda t: t["v"]).alias("values"),
        ]
        return cell.select(*[F.col(f"`{c}`") for c in keep], F.struct(*parts).alias(out))

    def vectors(self, df: DataFrame, keep: Sequence[str], out: str = "features") -> DataFrame:
        """``keep`` plus one vector for ML estimators, made by ML transformers inside the JVM."""
        some = [i for i, f in enumerate(self.categorical) if self.n_levels[f]]
        known = {i: self.n_levels[self.categorical[i]] for i in some}
        at = [F.coalesce(F.col(f"_at{i}"), F.lit(known[i])).cast("double").alias(f"_at{i}") for i in some]
        dense = [F.col("_dense")[j].alias(f"_d{j}") for j in range(self.n_dense)]
        rows = self.indexed(df, keep, "in_feature").select(*[F.col(f"`{c}`") for c in keep], *dense, *at)
        inputs = [f"_d{j}" for j in range(self.n_dense)]
        if some:
            # The position after the last level stands for unknown ones and is the category that gets no column.
            largest = df.sparkSession.createDataFrame([[float(known[i]) for i in some]], ", ".join(f"_at{i} double" for i in some))
            hot = OneHotEncoder(inputCols=[f"_at{i}" for i in some], outputCols=[f"_hot{i}" for i in some], dropLast=True)
            rows = hot.fit(largest).transform(rows)
            inputs += [f"_hot{i}" for i in some]
        return VectorAssembler(inputCols=inputs, outputCol=out).transform(rows).select(*[F.col(f"`{c}`") for c in keep], out)


def fit_sparse_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], indicators: bool = True) -> SparseDesign:
    """Fit on ``df``, which should be a stored table. To the driver come a few numbers per feature and no level.

    NULL is a level of its own. No rows give no levels and, with numeric features, an error for want of a median.
    """
    stats = fit_design(df, numeric, [], indicators)
    empty = df.sparkSession.createDataFrame([], "feature string, level string, column long, in_feature long")
    levels = stage(numbered_levels(category_levels(df, categorical), categorical), "numbered") if categorical else empty
    size = F.sum(F.octet_length("level") + F.lit(_LEVEL_COST)).alias("bytes")
    counted = {r["feature"]: r for r in levels.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), size).collect()}
    return SparseDesign(
        numeric=list(numeric),
        categorical=list(categorical),
        median=stats.median,
        mean=stats.mean,
        std=stats.std,
        indicators=stats.indicators,
        levels=levels,
        n_levels={f: counted[f]["n"] if f in counted else 0 for f in categorical},
        level_bytes={f: counted[f]["bytes"] for f in counted},
    )


def scores(rows: DataFrame, keep: Sequence[str], weights: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
    """``keep`` plus the product of sparse rows with ``weights`` (column, weight); a column without a weight counts zero.

    ``keep`` identifies a row. Cells meet weights by column with frequent columns dealt over tasks, and sums combine before
    the last shuffle.
    """
    at = F.explode(F.arrays_zip(F.col(features)["indices"].alias("column"), F.col(features)["values"].alias("value")))
    cells = rows.select(*keep, at.alias("c")).select(*keep, "c.column", "c.value")
    met = hot_join(stage(cells, "cells"), weights.select("column", "weight"), ["column"], "left")
    return met.groupBy(*keep).agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias(out))
