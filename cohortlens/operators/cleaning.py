"""Typed views over raw tables and the checks that guard them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import MISSING_TOKEN, count_where, recode, sentinel_to_null

# Fixed values
BAND_FIX = {"?": None, "10-20": "10-20%"}
RAW_NAMES = [
    "student_info",
    "student_registration",
    "student_assessment",
    "assessments",
    "courses",
    "vle",
    "student_vle",
]
VIEW_NAMES = {
    "v_student_info": "info",
    "v_student_registration": "registration",
    "v_student_assessment": "submissions",
    "v_assessments": "assessments",
}


class TableSet:
    """Named relations of a study, each built when first asked for and then kept.

    Raw sets carry the seven source relations with placeholder text, typed sets the cleaned ones.
    """

    def __init__(self, **loaders: Callable[[], DataFrame]):
        self._loaders = loaders
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._loaders:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._loaders[name]()
        return self._built[name]

    def replaced(self, **frames: DataFrame) -> TableSet:
        """The same set with some of its relations given as frames."""
        rest = {n: (lambda n=n: getattr(self, n)) for n in self._loaders}
        return TableSet(**rest | {n: (lambda f=f: f) for n, f in frames.items()})

    def names(self) -> list[str]:
        return list(self._loaders)

    def all(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in self._loaders}

    def create_views(self, views: Mapping[str, str] = VIEW_NAMES) -> None:
        for view, name in views.items():
            getattr(self, name).createOrReplaceTempView(view)


def typed_views(raw: TableSet) -> TableSet:
    """Cast placeholder columns and fix the one malformed band; no filter, no join."""
    days = ("date_registration", "date_unregistration")
    return TableSet(
        info=lambda: raw.student_info.withColumn("imd_band", recode("imd_band", BAND_FIX)),
        registration=lambda: raw.student_registration.withColumns(
            {c: sentinel_to_null(c, "int") for c in days}
        ),
        submissions=lambda: raw.student_assessment.withColumn("score", sentinel_to_null("score", "double")),
        assessments=lambda: raw.assessments.withColumn("date", sentinel_to_null("date", "int")),
        courses=lambda: raw.courses,
        sites=lambda: raw.vle,
        activity=lambda: raw.student_vle,
    )


def placeholder_counts(df: DataFrame, table: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows touched by each ``(column, old value)`` rule, all rules in one pass."""
    wide = df.agg(*[count_where(F.col(c) == F.lit(v)).alias(f"r{i}") for i, (c, v) in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.lit(v).alias("old_value"),
            F.col(f"r{i}").alias("n_rows"),
        )
        for i, (c, v) in enumerate(rules)
    ]
    return wide.select(F.inline(F.array(*rows)))


def normalisation_counts(raw: TableSet) -> DataFrame:
    parts = [
        placeholder_counts(
            raw.student_registration,
            "student_registration",
            [("date_registration", MISSING_TOKEN), ("date_unregistration", MISSING_TOKEN)],
        ),
        placeholder_counts(raw.student_assessment, "student_assessment", [("score", MISSING_TOKEN)]),
        placeholder_counts(raw.assessments, "assessments", [("date", MISSING_TOKEN)]),
        placeholder_counts(
            raw.student_info, "student_info", [("imd_band", MISSING_TOKEN), ("imd_band", "10-20")]
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unexpected_values(df: DataFrame, column: str, allowed: Iterable[object]) -> DataFrame:
    """Distinct values outside the allowed set with their row counts; NULL counts as unexpected."""
    c = F.col(column)
    inside = F.coalesce(c.isin(list(allowed)), F.lit(False))
    return df.where(~inside).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def require_domain(df: DataFrame, column: str, allowed: Iterable[object]) -> DataFrame:
    """``df`` unchanged, or an error naming values the mapping does not cover."""
    found = unexpected_values(df, column, allowed)
    bad = found.orderBy(F.desc("n_rows")).limit(20).collect()
    if bad:
        raise ValueError(f"{column} has {found.count()} values outside the expected set, among them {[r[0] for r in bad]}")
    return df


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[count_where(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` unchanged, or an error naming the columns with NULLs."""
    found = null_counts(df, columns).first()
    bad = {c: found[f"null_{c}"] for c in columns if found[f"null_{c}"]}
    if bad:
        raise ValueError(f"NULL after mapping: {bad}")
    return df


