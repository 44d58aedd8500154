"""Mixing to target weights: raking of token totals to marginals, then sampling by probability.

Documents collapse to cells (one per combination of dimension values), so every later step works on
cells. Each round scales the cells to the target share of every value of one dimension after the other.
A document stays with probability min(1, ratio) of its cell and carries the rest as weight, so weighted
tokens of the sample meet the marginals in expectation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.session import stage
from cohortlens.llm.naming import named

#: Raking ends when every marginal is this close to its target, at the latest after so many rounds.
TOLERANCE, MAX_ROUNDS, ROUNDS_PER_STAGE = 1e-12, 400, 8
#: Level that stands for NULL in a dimension.
NO_LEVEL = "(none)"


def token_count(text: Column) -> Column:
    """Words of a text, runs of anything but ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def level(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NO_LEVEL))


def tempered_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(value, target): shares of the tokens, raised to ``power`` and scaled to one."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    raised = sums.select("value", F.pow("t", F.lit(power)).alias("r"))
    total = raised.agg(F.sum("r")).first()[0] or 1.0
    return raised.select("value", (F.col("r") / F.lit(total)).alias("target"))


def largest_error(cells: DataFrame, dims: Sequence[str]) -> float:
    """Largest difference between the share of a value and its target, over all dimensions."""
    gaps = [
        cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value"))
        .agg(F.sum("share").alias("got"), F.first(f"_target_{d}").alias("target"))
        for d in dims
    ]
    every = gaps[0]
    for g in gaps[1:]:
        every = every.unionByName(g)
    return every.agg(F.max(F.abs(F.col("got") - F.coalesce("target", F.lit(0.0))))).first()[0] or 0.0


def rake(
    cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS
) -> tuple[DataFrame, float]:
    """``cells`` (dimension columns, tokens) with ``share``, the fitted share of each cell, and the largest marginal error.

    Cells without tokens get share 0, as do values without a target. Targets are put on the cells once; a
    scaling step is one sum over the cells of a value. Every ``ROUNDS_PER_STAGE`` rounds the cells are written out and
    the error is looked at. Raking ends when it is within ``tolerance``, or when a stage leaves it as it was: then the
    targets contradict each other and only those of the last dimension are met; or after ``max_rounds``.
    """
    dims = list(targets)
    now = cells.withColumn("share", F.col("tokens").cast("double"))
    for dim, target in targets.items():
        now = now.join(target.select(F.col("value").alias(dim), F.col("target").alias(f"_target_{dim}")), dim, "left")
    now = stage(now, "rake-0")
    error = float("inf")
    for turn in range(1, -(-max_rounds // ROUNDS_PER_STAGE) + 1):
        for _ in range(ROUNDS_PER_STAGE):
            for dim in dims:
                total = F.sum("share").over(Window.partitionBy(dim))
                scale = F.when(total > 0, F.coalesce(f"_target_{dim}", F.lit(0.0)) / total).otherwise(0.0)
                now = now.withColumn("share", F.col("share") * scale)
        now = stage(now, f"rake-{turn}")
        before, error = error, largest_error(now, dims)
        if error <= tolerance or abs(before - error) <= tolerance:
            break
    return now.drop(*[f"_target_{d}" for d in dims]), error


def uniform_draw(key: Column, salt: str) -> Column:
    """Number in [0, 1) from the first 52 bits of a digest of the key."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_to_targets(
    docs: DataFrame,
    dims: Mapping[str, Column],
    powers: Mapping[str, float],
    fraction: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    salt: str = "mix",
    tolerance: float = TOLERANCE,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The columns of ``carry``, the dimensions, n_tokens, probability, weight and kept of every row.

    ``fraction`` is the share of all tokens wanted. NULL levels count as the level ``(none)``. A document
    without tokens has probability 1 and weight 0: it takes nothing from the mix. Rows with the same id
    share one draw. A name in ``carry`` that is also one of the result's is left out.
    """
    names = [*dims, "n_tokens", "probability", "weight", "kept"]
    taken = {c: e for c, e in (carry or {}).items() if c not in names}
    rows = docs.select(
        *[e.alias(c) for c, e in taken.items()],
        uniform_draw(named(id_col), salt).alias("_draw"),
        token_count(named(text_col).cast("string")).alias("n_tokens"),
        *[level(e).alias(d) for d, e in dims.items()],
    )
    cells = stage(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    targets = {d: stage(tempered_targets(cells, d, powers[d]), f"mix-target-{d}") for d in dims}
    fitted, _ = rake(cells, targets, tolerance)
    wanted = float(cells.agg(F.sum("tokens")).first()[0] or 0) * fraction
    ratio = F.when(F.col("tokens") > 0, F.col("share") * F.lit(wanted) / F.col("tokens")).otherwise(0.0)
    rates = stage(fitted.select(*dims, ratio.alias("_ratio")), "mix-rates")
    bare = F.col("n_tokens") == 0
    chance = F.when(bare, 1.0).otherwise(F.least(F.lit(1.0), "_ratio"))
    return (
        rows.join(rates, list(dims))
        .withColumn("probability", chance)
        .withColumn("weight", F.when(bare | (F.col("_ratio") == 0), 0.0).otherwise(F.greatest(F.lit(1.0), "_ratio")))
        .withColumn("kept", F.col("_draw") < F.col("probability"))
        .select(*taken, *names)
    )
