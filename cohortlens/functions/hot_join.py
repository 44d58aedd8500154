"""Join with a lookup table when some keys hold large shares of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a frequent-items sketch keeps; every key with more than a ``1 / TRACKED`` share of the rows is among them.
TRACKED, HOT_KEYS = 4096, 512
_SALT, _KEY = "_salt", "_hot_key"


def _hash(on: Sequence[str]) -> Column:
    # Position and NULL of each column are part of the number, as NULL equals NULL in the join.
    return F.xxhash64(*[x for c in on for x in (F.col(c).isNull(), F.col(c))])


def hot_keys(rows: DataFrame, on: Sequence[str], share: float) -> list[int]:
    """Hashes of the keys with at least ``share`` of the rows by a mergeable sketch, ``HOT_KEYS`` at most.

    One pass; what comes to the driver is bounded. A key that the sketch overrates is only dealt out for nothing.
    """
    got = rows.select(_hash(on).alias("k")).agg(F.expr(f"approx_top_k(k, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [t["item"] for t in got["top"] or [] if t["count"] >= share * got["n"]]


def hot_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", salts: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``lookup``, joined on equal key columns where NULL equals NULL; the keys appear once.

    Rows of a hot key are dealt over ``salts`` parts by a digest of the row, and its lookup rows are repeated for each part, so
    no task gets more of it than of others. Where nothing is hot this is a plain join, and Spark may broadcast a small
    ``lookup`` either way. ``rows`` is read twice and should be a stored table.
    """
    if how not in ("inner", "left"):
        raise ValueError("hot_join keeps the rows of its left side: inner or left")
    parts = salts or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(rows, on, 0.5 / parts)
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    spread = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.lit(parts))
    is_hot = _hash(on).isin(hot) if hot else F.lit(False)
    left = rows.withColumn(_SALT, F.when(is_hot, spread).otherwise(F.lit(0).cast("long")))
    right = lookup.withColumn(_SALT, F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    keys = [*on, _SALT]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on] + [F.col(_SALT) == F.col(f"_r_{_SALT}")]
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in keys], _SALT)
