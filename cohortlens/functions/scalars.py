"""Column helpers shared by the operators. Everything here stays a plain Spark expression."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
NULL_TOKEN = "__NULL__"
MISSING_TOKEN = "?"
WILSON_Z = 1.96


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentinel_to_null(c: str | Column, to: str, token: str = MISSING_TOKEN) -> Column:
    """Placeholder becomes NULL; any other text that is not a number is an error (ANSI cast)."""
    return F.nullif(as_col(c), F.lit(token)).cast(to)


def tolerant_numeric(c: str | Column, to: str = "double") -> Column:
    """NULL for everything that does not parse."""
    return as_col(c).try_cast(to)


def recode(c: str | Column, replace: Mapping[str, str | None]) -> Column:
    """Replace listed values, keep all others."""
    c = as_col(c)
    out = c
    for old, new in replace.items():
        out = F.when(c == old, F.lit(new).cast("string")).otherwise(out)
    return out


def label_from(c: str | Column, classes: Mapping[object, Iterable[object]], default=None) -> Column:
    """Map value sets to labels. Values in no set get ``default``."""
    c = as_col(c)
    out = None
    for label, values in classes.items():
        hit = c.isin(list(values))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(F.lit(default))


def safe_ratio(num: str | Column, den: str | Column, when_zero: float | None = None) -> Column:
    """Double division; ``when_zero`` when the denominator is zero or missing."""
    num, den = as_col(num).cast("double"), F.coalesce(as_col(den).cast("double"), F.lit(0.0))
    empty = F.lit(when_zero).cast("double")
    return F.when(den == 0.0, empty).otherwise(num / den)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, for reports and comparisons."""
    return F.round(as_col(c).cast("double"), digits) + F.lit(0.0)


def null_as_token(c: str | Column) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(NULL_TOKEN))


def key_digest(seed: int | str, *key: str | Column) -> Column:
    """Reproducible pseudo-random text per key, the same on every engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[as_col(k).cast("string") for k in key]))


def hash_draw(digest: Column, size: str | Column) -> Column:
    """Integer in 1..size taken from the first 60 bits of a digest; the bias is below size / 2**60."""
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return F.pmod(number, as_col(size).cast("bigint")) + F.lit(1).cast("bigint")


def wilson_bounds(k: str | Column, n: str | Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Score interval of a rate; NULL for an empty group."""
    k, n = as_col(k).cast("double"), as_col(n).cast("double")
    n = F.when(n > 0, n)
    p = k / n
    shrink = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / shrink
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / shrink
    return centre - half, centre + half


def count_where(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def unpivot_numeric(df, keep: Sequence[str], cols: Sequence[str], name="feature", value="value"):
    """Long form (keep.., name, value) of numeric columns as doubles, one pass."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(keep), list(cols), name, value)


def unpivot_text(df, keep: Sequence[str], cols: Sequence[str], name="feature", value="value"):
    """Long form of categorical columns, NULL as its own category."""
    wide = df.select(*keep, *[null_as_token(c).alias(c) for c in cols])
    return wide.unpivot(list(keep), list(cols), name, value)
