"""Table profiles and integrity checks. Each profile is one aggregate over all its columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranking import exact_quantiles
from cohortlens.functions.scalars import count_where, safe_ratio, tolerant_numeric, unpivot_numeric


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, column count and column names per table."""
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"),
                "n_rows",
                F.lit(len(df.columns)).alias("n_columns"),
                F.lit(", ".join(df.columns)).alias("column_names"),
            )
            for name, df in tables.items()
        ]
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            for name, df in tables.items()
        ]
    )


def key_uniqueness(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows. Collapses to keys first, so a hot key is one row."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("c"))
        .agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("total_rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
        )
        .withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_keys"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column in long form. One shuffle of distinct (column, value) cells."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "v"
    )
    return (
        long.where(F.col("v").isNotNull())
        .groupBy("column_name", "v")
        .agg(F.lit(1).alias("one"))
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )


def rows_per_unit(df: DataFrame, unit: Sequence[str]) -> DataFrame:
    per = df.groupBy(*unit).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.count(F.lit(1)).alias("n_units"),
        F.min("c").alias("min_rows"),
        F.max("c").alias("max_rows"),
        F.avg(F.col("c").cast("double")).alias("mean_rows"),
    )


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts per value of many columns in one aggregate; NULL stays a value of its own."""
    long = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(by), list(columns), "column_name", "value"
    )
    return long.groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def missingness_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """True NULLs, text that is no number, and the range of what parses, per column."""
    aggs: list[Column] = []
    for c in columns:
        v = tolerant_numeric(F.col(c).cast("string"))
        aggs += [
            count_where(F.col(c).isNull()).alias(f"{c}__nulls"),
            count_where(F.col(c).isNotNull() & v.isNull()).alias(f"{c}__unparsed"),
            F.min(v).alias(f"{c}__min"),
            F.max(v).alias(f"{c}__max"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("_n").alias("n_rows"),
            F.col(f"{c}__nulls").alias("n_null"),
            F.col(f"{c}__unparsed").alias("n_unparsed"),
            F.col(f"{c}__min").alias("min_value"),
            F.col(f"{c}__max").alias("max_value"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def numeric_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, nulls, null share, min, max, mean, exact median, sample deviation per column."""
    long = unpivot_numeric(df, by, columns)
    groups = [*by, "feature"]
    v = F.col("value")
    basic = long.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_where(v.isNull()).alias("n_null"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"),
        F.when(F.count(v) > 1, F.stddev_samp(v)).alias("std_value"),
    )
    medians = exact_quantiles(long, groups, "value", [1], 2, "q").select(
        *groups, F.col("q")[0].alias("median_value")
    )
    return basic.join(medians, groups, "left").withColumn("null_share", safe_ratio("n_null", "n_rows"))


def signed_range_profile(df: DataFrame, day: str) -> DataFrame:
    return df.agg(
        F.min(day).alias("min_day"),
        F.max(day).alias("max_day"),
        count_where(F.col(day) < 0).alias("rows_before_day_0"),
    )


def presence_grid(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Which (row, column) pairs exist, as one row per ``row`` and one 0/1 column per value."""
    return df.groupBy(row).agg(
        *[F.max(F.when(F.col(column) == v, 1).otherwise(0)).alias(f"has_{v}") for v in values]
    )


def orphan_counts(checks: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows of a child table without a parent, for several references.

    The child is reduced to its distinct keys first: a hot key is checked once, not per row.
    """
    parts = []
    for name, (child, parent, key) in checks.items():
        keys = child.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
        lost = keys.join(parent.select(*key).distinct(), list(key), "left_anti")
        parts.append(
            lost.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("orphan_rows")).select(
                F.lit(name).alias("reference"), "orphan_rows"
            )
        )
    return _union(parts)


def target_correlation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of each feature with the label over rows that have the feature.

    NULL when either side does not vary. Ordered by absolute value by the caller.
    """
    long = unpivot_numeric(df, [label], features).where(F.col("value").isNotNull())
    y = F.col(label).cast("double")
    v = F.col("value")
    varies = (F.min(v) < F.max(v)) & (F.min(y) < F.max(y))
    moments = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_used"),
        F.when(varies, F.covar_pop(v, y)).alias("_c"),
        F.stddev_pop(v).alias("_sv"),
        F.stddev_pop(y).alias("_sy"),
    )
    r = F.when(F.col("_c").isNotNull(), F.try_divide(F.col("_c"), F.col("_sv") * F.col("_sy")))
    seen = df.select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")).distinct()
    return seen.join(moments, "feature", "left").select(
        "feature", F.coalesce(F.col("n_used"), F.lit(0)).alias("n_used"), r.alias("correlation")
    )


def null_share_matrix(df: DataFrame, features: Sequence[str], by: str, values: Sequence[int]) -> DataFrame:
    """Null share per feature, one column per value of ``by``."""
    long = df.select(by, *[F.col(f).isNull().cast("int").alias(f) for f in features]).unpivot(
        [by], list(features), "feature", "is_null"
    )
    return long.groupBy("feature").agg(
        *[
            F.avg(F.when(F.col(by) == v, F.col("is_null").cast("double"))).alias(f"share_{v}")
            for v in values
        ]
    )
