"""Design matrix: fitted on one table, applied to another, never refitted on what it is applied to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranking import same_keys
from cohortlens.functions.scalars import count_where, null_as_token, unpivot_text
from cohortlens.operators.importance import LEVEL_MARK, MISSING_PREFIX
from cohortlens.operators.quantile_cells import medians


def numeric_stats(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., feature, n, n_null, median, mean, std): mean and population deviation after imputation.

    Combined from the moments of the present values and the number of imputed ones, so the data
    is not imputed first. A deviation of zero becomes one. All features and groups share four reads of ``df``.
    """

    def moments(f: str) -> Column:
        v = F.col(f).cast("double")
        return F.struct(F.lit(f).alias("feature"), F.count(F.lit(1)).alias("n"), count_where(v.isNull()).alias("n_null"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v"))

    wide = df.groupBy(*by).agg(*[moments(f).alias(f"_{i}") for i, f in enumerate(features)])
    basic = wide.select(*by, F.explode(F.array(*[F.col(f"_{i}") for i in range(len(features))])).alias("t")).select(*by, "t.*").where("n > 0")
    have, gone, n = F.col("n") - F.col("n_null"), F.col("n_null"), F.col("n").cast("double")
    mean = (have * F.col("_m") + gone * F.col("median")) / n
    spread = have * (F.col("_v") + F.pow(F.col("_m") - F.col("mean"), 2.0)) + gone * F.pow(
        F.col("median") - F.col("mean"), 2.0
    )
    std = F.sqrt(spread / n)
    return (
        same_keys(basic, medians(df, by, features), [*by, "feature"], "left")
        .withColumn("mean", mean)
        .withColumn("std", F.when(std > 0, std).otherwise(1.0))
        .select(*by, "feature", "n", "n_null", "median", "mean", "std")
    )


def category_levels(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct (by.., feature, level), NULL as a level of its own."""
    return unpivot_text(df, by, features, value="level").distinct()


@dataclass(frozen=True)
class Design:
    """What fitting leaves behind: one row of numbers per feature and the known levels."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    median: Mapping[str, float]
    mean: Mapping[str, float]
    std: Mapping[str, float]
    indicators: Sequence[str]
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        """Fixed order: numeric, indicators, then levels of each categorical feature."""
        hot = [f"{f}{LEVEL_MARK}{v}" for f in self.categorical for v in self.levels[f]]
        return [*self.numeric, *[MISSING_PREFIX + f for f in self.indicators], *hot]

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` plus the design columns. A level unknown to the fit is all zeros."""
        out = [F.col(c) for c in keep]
        for f in self.numeric:
            filled = F.coalesce(F.col(f).cast("double"), F.lit(self.median[f]))
            out.append(((filled - self.mean[f]) / self.std[f]).alias(f))
        for f in self.indicators:
            out.append(F.col(f).isNull().cast("int").alias(MISSING_PREFIX + f))
        for f in self.categorical:
            for v in self.levels[f]:
                out.append((null_as_token(f) == F.lit(v)).cast("int").alias(f"{f}{LEVEL_MARK}{v}"))
        return df.select(*out)

    def assemble(self, df: DataFrame, keep: Sequence[str], out: str = "features") -> DataFrame:
        """``keep`` plus one vector column in the fixed order."""
        wide = self.apply(df, [*keep])
        plain = wide.toDF(*keep, *[f"_d{i}" for i in range(len(self.columns))])
        vec = VectorAssembler(inputCols=[f"_d{i}" for i in range(len(self.columns))], outputCol=out)
        return vec.transform(plain).select(*keep, out)


def fit_design(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], indicators: bool = True, max_levels: int | None = None
) -> Design:
    """Fit on ``df``. Comes to the driver: one row per numeric feature and the levels, which become columns.

    Every level becomes a column; ``max_levels`` lets a caller refuse more of them.
    """
    stats = {r["feature"]: r for r in numeric_stats(df, numeric).collect()} if numeric else {}
    levels: dict[str, list[str]] = {f: [] for f in categorical}
    if categorical:
        found = category_levels(df, categorical)
        found = (found if max_levels is None else found.limit(max_levels + 1)).collect()
        if max_levels is not None and len(found) > max_levels:
            raise ValueError(f"more than {max_levels} category levels, in {category_levels(df, categorical).count()}")
        for r in found:
            levels[r["feature"]].append(r["level"])
    return _design(stats, levels, numeric, categorical, indicators)


def fit_designs(df: DataFrame, by: str, numeric: Sequence[str], categorical: Sequence[str]) -> dict[int, Design]:
    """:func:`fit_design` of the rows of each value of ``by``, all from the same reads."""
    stats: dict[int, dict] = {}
    for r in numeric_stats(df, numeric, [by]).collect():
        stats.setdefault(r[by], {})[r["feature"]] = r
    levels: dict[int, dict[str, list[str]]] = {g: {f: [] for f in categorical} for g in stats}
    for r in category_levels(df, categorical, [by]).collect():
        levels[r[by]][r["feature"]].append(r["level"])
    return {g: _design(stats[g], levels[g], numeric, categorical, True) for g in sorted(stats)}


def _design(stats: Mapping, levels: Mapping[str, Sequence[str]], numeric: Sequence[str], categorical: Sequence[str], indicators: bool) -> Design:
    return Design(
        numeric=list(numeric),
        categorical=list(categorical),
        median={f: stats[f]["median"] for f in numeric},
        mean={f: stats[f]["mean"] for f in numeric},
        std={f: stats[f]["std"] for f in numeric},
        indicators=[f for f in numeric if indicators and stats[f]["n_null"] > 0],
        levels={f: sorted(v) for f, v in levels.items()},
    )
