"""Normal distribution for p-values, as column expressions and for single numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to here the series of the error function is summed, beyond it the continued fraction of its complement.
_SWITCH, _SERIES, _FRACTION = 2.0, 40, 60


def erfc(x: Column) -> Column:
    """Complementary error function of a value that is not negative."""
    square = x * x
    # Terms 2^k x^(2k) / (1 * 3 * .. * (2k + 1)) are all positive, so nothing cancels inside the sum.
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * 2.0 * square / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(_SERIES)), start, step, lambda acc: acc["sum"])
    small = 1.0 - F.lit(2.0 / math.sqrt(math.pi)) * x * F.exp(-square) * series
    tail = F.aggregate(F.sequence(F.lit(_FRACTION), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / 2.0 / acc)
    large = F.exp(-square) / F.lit(math.sqrt(math.pi)) / tail
    return F.when(x < _SWITCH, small).otherwise(large)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z.cast("double")) / math.sqrt(2.0))


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def detection_multiplier(alpha: float, power: float) -> float:
    """z of a two-sided test plus z of its power."""
    return quantile(1.0 - alpha / 2.0) + quantile(power)
