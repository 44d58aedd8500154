"""Stratified bootstrap of ranking and threshold metrics without a row per (row, resample).

Rows collapse to a ladder of distinct scores, cut into at most about ``BLOCKS`` blocks of scores. Resampling has two steps with
the distribution of plain resampling inside each class. First the slots of a class draw positions of the class from
a digest of (seed, resample, class, slot); only the number that falls into each block is kept, one count for all slots of a task. Then
every block draws its number of positions among its own rows. Class sizes never change, and a lost task draws the same again.

A block knows how many copies lie below it in each resample, so it works out its share of every metric alone. What is shuffled
grows with blocks x resamples, not with rows x resamples.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.ranking import exact_quantiles, running_counts, same_keys
from cohortlens.functions.scalars import key_digest
from cohortlens.functions.session import stage
from cohortlens.operators.scoring import BUDGETS, HEADLINE_RATIO

# Fixed values
INTERVAL_STEPS = [25, 975]
INTERVAL_PARTS = 1000
RESAMPLES = 1000
METRICS = ["expected_cost", "auc_pr", "auc_roc", "brier", "recall_at_5pct", "recall_at_10pct", "recall_at_20pct"]

#: Blocks of a group, a bound on what is shuffled; and the fewest rows that make a block.
BLOCKS, MIN_BLOCK = 1024, 4096
#: Draws made at a time, few enough for their arrays to stay in a processor's cache; cells (resample, score) held at a time.
DRAWS_AT_ONCE, CELLS_AT_ONCE = 1 << 15, 1 << 20
#: Resamples of a class that one frame of counts holds; buckets of positions that a block is looked up by.
RESAMPLES_AT_ONCE, BUCKET_BITS = 64, 14
_MASK = np.uint64(0xFFFFFFFF)
_SHIFTED, _TIMES = (16, 15, 16), (np.uint32(0x7FEB352D), np.uint32(0x846CA68B))


def _mix(x: np.ndarray, room: np.ndarray) -> None:
    """32-bit mixing function in place."""
    for i, shift in enumerate(_SHIFTED):
        np.right_shift(x, shift, out=room)
        np.bitwise_xor(x, room, out=x)
        if i < len(_TIMES):
            np.multiply(x, _TIMES[i], out=x)


def _chained(*parts: np.ndarray | int) -> np.ndarray:
    out = np.zeros(1, np.uint32)
    for p in parts:
        out = out ^ (np.asarray(p).astype(np.uint64) & _MASK).astype(np.uint32)
        _mix(out, np.empty_like(out))
    return out


def draw_keys(seed: int, step: int, b: np.ndarray, label: int, block: int) -> np.ndarray:
    """What the two digests of a draw share in each resample, (resamples x 2)."""
    return np.stack([_chained(seed, half, step, label, block, b) for half in (0, 1)], axis=1)


def _rooms() -> tuple[np.ndarray, ...]:
    return tuple(np.empty(DRAWS_AT_ONCE, kind) for kind in (np.uint32, np.uint32, np.uint64, np.uint64))


def draw_runs(keys: np.ndarray, low: int, highs: np.ndarray, size: int, rooms: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray]]:
    """(i, j, owner, positions) of runs of at most ``DRAWS_AT_ONCE`` draws of the resamples i..j-1; ``owner`` counts from i.

    A resample draws positions 0..size-1 for its slots low..high-1, by 53 bits of two digests; the bias is below
    size / 2**53. A run lives in ``rooms`` and goes with the next one.
    """
    last = int(highs.max())
    while low < last:
        # Slots beyond 32 bits change the key, so the low part alone is hashed last.
        end = min(last, low + DRAWS_AT_ONCE, ((low >> 32) + 1) << 32)
        heads = keys ^ np.uint32(low >> 32)
        _mix(heads, np.empty_like(heads))
        slots = np.arange(low & 0xFFFFFFFF, (low & 0xFFFFFFFF) + end - low).astype(np.uint32)
        n = np.clip(highs - low, 0, end - low)
        before = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < n.size:
            j = max(i + 1, int(np.searchsorted(before, before[i] + DRAWS_AT_ONCE, "right")) - 1)
            m = int(before[j] - before[i])
            if m:
                one = j == i + 1
                owner = 0 if one else np.repeat(np.arange(j - i), n[i:j])
                slot = slots[:m] if one else slots[np.arange(m) - (before[i:j] - before[i])[owner]]
                x, y, out, whole = (r[:m] for r in rooms)
                for half in (0, 1):
                    np.bitwise_xor(heads[i, half] if one else heads[i:j, half][owner], slot, out=x)
                    _mix(x, y)
                    if half == 0:
                        np.left_shift(x, np.uint64(21), out=out, dtype=np.uint64)
                    else:
                        np.right_shift(x, 11, out=x)
                        np.add(out, x, out=out)
                np.floor_divide(out, np.uint64(size), out=whole)
                np.multiply(whole, np.uint64(size), out=whole)
                np.subtract(out, whole, out=out)
                yield i, j, owner, out.view(np.int64)
            i = j
        low = end


def drawn(seed: int, step: int, b: np.ndarray, label: int, block: int, slots: np.ndarray, size: int) -> np.ndarray:
    """Positions 0..size-1 drawn by each of consecutive slots in each resample, one row per resample."""
    rooms, low, high = _rooms(), int(slots[0]), np.array([int(slots[-1]) + 1])
    keys = draw_keys(seed, step, b, label, block)
    return np.array([np.concatenate([at.copy() for *_, at in draw_runs(k[None], low, high, size, rooms)]) for k in keys])


def score_blocks(rows: DataFrame, groups: Sequence[str], score: str, label: str = "y") -> DataFrame:
    """Ladder of distinct scores with counts per class and the block of each score.

    A score with as many rows as a block is a block of its own: all that a class draws there is that score.
    """
    y = F.col(label).cast("bigint")
    ladder = running_counts(rows, groups, score, {"n": F.lit(1), "pos": y})
    size = F.greatest(F.lit(MIN_BLOCK), F.ceil(F.col("n_total") / BLOCKS))
    block = 2 * F.floor(F.col("n_below") / size) + F.when(F.col("n") >= size, 1).otherwise(0)
    return ladder.select(
        *groups, F.col(score).alias("score"), (F.col("n") - F.col("pos")).alias("n0"), F.col("pos").alias("n1"), block.cast("long").alias("block"),
        (F.col("n_below") - F.col("pos_below")).alias("below0"), F.col("pos_below").alias("below1"),
        (F.col("n_total") - F.col("pos_total")).alias("total0"), F.col("pos_total").alias("total1"), size.cast("long").alias("size"),
    )


def _finder(starts: np.ndarray, total: int):
    """Function from positions to the last start at or below each: a table of buckets, then the few starts inside a bucket."""
    bits = max(0, int(total).bit_length() - BUCKET_BITS)
    edges = np.arange((total >> bits) + 2, dtype=np.int64) << bits
    first = np.searchsorted(starts, edges[:-1], "right") - 1
    inside = int((np.searchsorted(starts, edges[1:] - 1, "right") - 1 - first).max())
    # Blocks with hardly a row of the class lie many to a bucket.
    if inside > 6:
        return lambda at: np.searchsorted(starts, at, "right") - 1
    following = np.append(starts[1:], total)

    def found(at: np.ndarray) -> np.ndarray:
        out = first[at >> bits]
        for _ in range(inside):
            out += at >= following[out]
        return out

    return found


def _block_counts(seed: int, resamples: int, groups: Sequence[str]):
    """Draws of each block, counted over all slots of a class that a task holds; they come in order of group and class."""

    def counts(of: tuple, ids: np.ndarray, cells: np.ndarray) -> Iterator[pd.DataFrame]:
        for lo in range(0, resamples, RESAMPLES_AT_ONCE):
            b, at = np.nonzero(cells[lo : lo + RESAMPLES_AT_ONCE])
            out = pd.DataFrame({"b": b + lo + 1, "block": ids[at], "label": of[-1], "t": cells[b + lo, at]})
            for g, v in zip(groups, of):
                out[g] = v
            yield out[[*groups, "b", "block", "label", "t"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rooms, last = _rooms(), None
        for row in (r for f in frames for r in f.itertuples(index=False)):
            of = (*(getattr(row, g) for g in groups), row.label)
            # Where a group is NULL, as NaN, each chunk is counted alone.
            if of != last:
                if last is not None:
                    yield from counts(last, ids, cells)
                last, ids, total = of, np.array(row.blocks, np.int64), int(row.total)
                find = _finder(np.array(row.starts, np.int64), total)
                keys = draw_keys(seed, 0, np.arange(1, resamples + 1), row.label, 0)
                cells = np.zeros((resamples, ids.size), np.int64)
            for i, j, owner, at in draw_runs(keys, int(row.low), np.full(resamples, row.high), total, rooms):
                cells[i:j] += np.bincount(owner * ids.size + find(at), minlength=(j - i) * ids.size).reshape(j - i, -1)
        if last is not None:
            yield from counts(last, ids, cells)

    return run


def block_draws(ladder: DataFrame, groups: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """(groups.., block, draws): per resample b the copies of each class in the block and below it."""
    by, kinds = list(groups), dict(ladder.dtypes)
    blocks = ladder.groupBy(*by, "block").agg(
        F.min("below0").alias("below0"), F.min("below1").alias("below1"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        F.first("total0").alias("total0"), F.first("total1").alias("total1"), F.first("size").alias("size"),
    )
    held = [
        blocks.where(F.col(f"n{c}") > 0).groupBy(*by, F.lit(c).alias("label")).agg(
            F.first(f"total{c}").alias("total"), F.first("size").alias("size"),
            F.array_sort(F.collect_list(F.struct(F.col(f"below{c}").alias("start"), "block"))).alias("s"),
        )
        for c in (0, 1)
    ]
    lows = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("size"))).alias("low")
    chunks = held[0].unionByName(held[1]).select(*by, "label", "total", "size", F.col("s.start").alias("starts"), F.col("s.block").alias("blocks"), lows)
    chunks = chunks.withColumn("high", F.least("total", F.col("low") + F.col("size"))).repartition(
        int(ladder.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ).sortWithinPartitions(*by, "label")
    fields = ", ".join([*(f"{g} {kinds[g]}" for g in by), "b long, block long, label int, t long"])
    found = chunks.mapInPandas(_block_counts(seed, resamples, by), fields).groupBy(*by, "b", "block").agg(
        *[F.coalesce(F.sum(F.when(F.col("label") == c, F.col("t"))), F.lit(0)).alias(f"t{c}") for c in (0, 1)]
    )
    # A block that nothing fell into still has copies below it.
    every = blocks.select(*by, "block").withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(resamples).cast("long"))))
    full = same_keys(every, found, [*by, "b", "block"], "left").fillna(0, ["t0", "t1"])
    before = Window.partitionBy(*by, "b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = full.select(*by, "block", "b", "t0", "t1", *[F.coalesce(F.sum(f"t{c}").over(before), F.lit(0)).alias(f"u{c}") for c in (0, 1)])
    return cells.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("b", "t0", "t1", "u0", "u1"))).alias("draws"))


def _with_draws(ladder: DataFrame, groups: Sequence[str], resamples: int, seed: int, *more: str) -> DataFrame:
    """One row per block: its scores with their counts, and its draws. Blocks are at most about ``BLOCKS`` a group."""
    by = [*groups, "block"]
    entries = ladder.groupBy(*by, "total0", "total1", *more).agg(F.array_sort(F.collect_list(F.struct("score", "n0", "n1"))).alias("s"))
    parts = [F.col(f"s.{c}").alias(c) for c in ("score", "n0", "n1")]
    drawn_ = block_draws(ladder, groups, resamples, seed)
    names = [F.col(f"draws.{c}").alias(c) for c in ("b", "t0", "t1", "u0", "u1")]
    # The rows are small and the work on each is not: without a number of parts they would be merged into a few.
    tasks = int(ladder.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return same_keys(entries, drawn_, by).select(*by, "total0", "total1", *more, *parts, *names).repartition(tasks)


def _copies(row, seed: int, rows_at: slice) -> list[np.ndarray]:
    """Copies of each score of a block in some resamples, (resamples x scores) for each class."""
    b, rooms = np.array(row.b, np.int64)[rows_at], _rooms()
    out = []
    for c, counts, taken in ((0, row.n0, row.t0), (1, row.n1, row.t1)):
        sizes, t = np.array(counts, np.int64), np.array(taken, np.int64)[rows_at]
        copies = np.zeros((b.size, sizes.size), np.int64)
        if sizes.size == 1:
            copies[:, 0] = t
        elif sizes.any():
            held = np.flatnonzero(sizes)
            total, first = int(sizes.sum()), np.cumsum(sizes[held]) - sizes[held]
            for i, j, owner, at in draw_runs(draw_keys(seed, 1, b, c, row.block + 1), 0, t, total, rooms):
                rows = np.bincount(owner * total + at, minlength=(j - i) * total).reshape(j - i, -1)
                copies[i:j, held] += rows if held.size == total else np.add.reduceat(rows, first, axis=1)
        out.append(copies)
    return out


def _resamples_at_once(row) -> Iterator[slice]:
    step = max(1, CELLS_AT_ONCE // max(1, len(row.score)))
    for lo in range(0, len(row.b), step):
        yield slice(lo, lo + step)


def _metric_parts(seed: int, budgets: Sequence[float], groups: Sequence[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (r for f in frames for r in f.itertuples(index=False)):
            p = np.array(row.score, float)
            for at in _resamples_at_once(row):
                neg, pos = _copies(row, seed, at)
                below0 = np.array(row.u0, np.int64)[at, None] + np.cumsum(neg, axis=1) - neg
                below1 = np.array(row.u1, np.int64)[at, None] + np.cumsum(pos, axis=1) - pos
                both, n = neg + pos, row.total0 + row.total1
                shown, caught = n - below0 - below1, row.total1 - below1
                flagged = p >= row.threshold
                part = {
                    "b": np.array(row.b, np.int64)[at],
                    "fn": (pos * ~flagged).sum(axis=1),
                    "fp": (neg * flagged).sum(axis=1),
                    "ap": (pos * caught / np.maximum(shown, 1)).sum(axis=1),
                    "auc": (pos * (below0 + neg / 2)).sum(axis=1),
                    "sq": (pos * (p - 1) ** 2 + neg * p**2).sum(axis=1),
                }
                for i, budget in enumerate(budgets):
                    k = max(1, round(budget * n))
                    above, pos_above = shown - both, caught - pos
                    line = (above < k) & (k <= shown) & (both > 0)
                    part[f"tp_{i}"] = np.where(line, pos_above + (k - above) * pos / np.maximum(both, 1), 0.0).sum(axis=1)
                out = pd.DataFrame(part)
                for g in (*groups, "total0", "total1"):
                    out[g] = getattr(row, g)
                yield out[[*groups, "total0", "total1", *part]]

    return run


def bootstrap_metrics(
    rows: DataFrame,
    groups: Sequence[str],
    score: str,
    threshold: float | str,
    resamples: int = RESAMPLES,
    seed: int = 42,
    label: str = "y",
    budgets: Sequence[float] = BUDGETS,
) -> DataFrame:
    """(groups.., b, expected_cost, auc_pr, auc_roc, brier, recall_at_<n>pct..) of every resample.

    ``threshold`` is a number or a column that is constant in a group. Scores equal to the one at a budget line share
    what is left of it in proportion, the mean over random orders. Single-class groups get NULL ranking metrics, recall included.
    """
    by = list(groups)
    kinds = dict(rows.dtypes)
    ladder = stage(score_blocks(rows, by, score, label), "bootstrap-ladder")
    held = _with_draws(ladder, by, resamples, seed)
    if isinstance(threshold, str):
        lines = rows.groupBy(*by).agg(F.first(F.col(threshold).cast("double")).alias("threshold"))
        held = same_keys(held, lines, by) if by else held.crossJoin(F.broadcast(lines))
    else:
        held = held.withColumn("threshold", F.lit(float(threshold)))
    tps = [f"tp_{i}" for i in range(len(budgets))]
    fields = [*(f"{g} {kinds[g]}" for g in by), "total0 long, total1 long, b long, fn long, fp long, ap double, auc double, sq double"]
    fields += [f"{t} double" for t in tps]
    parts = held.mapInPandas(_metric_parts(seed, budgets, by), ", ".join(fields))
    sums = parts.groupBy(*by, "b", "total0", "total1").agg(*[F.sum(c).alias(c) for c in ("fn", "fp", "ap", "auc", "sq", *tps)])
    n0, n1 = F.col("total0"), F.col("total1")
    two = (n0 > 0) & (n1 > 0)
    return sums.select(
        *by,
        "b",
        ((HEADLINE_RATIO * F.col("fn") + F.col("fp")) / (n0 + n1)).alias("expected_cost"),
        F.when(two, F.col("ap") / n1).alias("auc_pr"),
        F.when(two, F.col("auc") / (n0 * n1)).alias("auc_roc"),
        (F.col("sq") / (n0 + n1)).alias("brier"),
        *[F.when(two, F.col(t) / n1).alias(f"recall_at_{round(x * 100)}pct") for t, x in zip(tps, budgets)],
    )


def intervals(per_resample: DataFrame, groups: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """2.5 and 97.5 percentiles of each metric over the resamples."""
    long = per_resample.select(*groups, *metrics).unpivot(list(groups), list(metrics), "metric", "value")
    by = [*groups, "metric"]
    q = exact_quantiles(long, by, "value", INTERVAL_STEPS, INTERVAL_PARTS, "q")
    return q.select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def paired_costs(
    rows: DataFrame, groups: Sequence[str], first: str, second: str, t_first: Column, t_second: Column, resamples: int = RESAMPLES, seed: int = 42, label: str = "y"
) -> DataFrame:
    """(groups.., b, cost_first, cost_second, difference) of two scores on the same resamples.

    Rows only matter by which of the two flags them, so the ladder has four steps and the resamples are those of these steps.
    """
    flags = F.when(F.col(first) >= t_first, 2).otherwise(0) + F.when(F.col(second) >= t_second, 1).otherwise(0)
    cells = rows.select(*groups, label, flags.alias("score"))
    by = list(groups)
    ladder = stage(score_blocks(cells, by, "score", label), "bootstrap-flags")
    held = _with_draws(ladder, by, resamples, seed)
    kinds = dict(rows.dtypes)
    fields = [*(f"{g} {kinds[g]}" for g in by), "total0 long, total1 long, b long, c1 long, c2 long"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (r for f in frames for r in f.itertuples(index=False)):
            flag = np.array(row.score, np.int64)
            for at in _resamples_at_once(row):
                neg, pos = _copies(row, seed, at)
                hit = [(flag & 2) > 0, (flag & 1) > 0]
                costs = [(HEADLINE_RATIO * pos * ~h + neg * h).sum(axis=1) for h in hit]
                out = pd.DataFrame({"b": np.array(row.b, np.int64)[at], "c1": costs[0], "c2": costs[1]})
                for g in (*by, "total0", "total1"):
                    out[g] = getattr(row, g)
                yield out[[*by, "total0", "total1", "b", "c1", "c2"]]

    sums = held.mapInPandas(run, ", ".join(fields)).groupBy(*by, "b", "total0", "total1").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    n = F.col("total0") + F.col("total1")
    return sums.select(*by, "b", (F.col("c1") / n).alias("cost_first"), (F.col("c2") / n).alias("cost_second")).withColumn(
        "difference", F.col("cost_first") - F.col("cost_second")
    )


def row_draws(rows: DataFrame, groups: Sequence[str], key: Sequence[str], resamples: int = RESAMPLES, seed: int = 42, label: str = "y") -> DataFrame:
    """(groups.., key.., label, copies, present): how often a row was drawn over all resamples and in how many.

    Rows are ordered by a digest of the whole key, of any columns; the key must be unique in a group.
    """
    by = list(groups)
    number = F.conv(F.substring(key_digest(0, *key), 1, 13), 16, 10).cast("long")
    placed = rows.select(*by, *key, label, number.alias("score"))
    ladder = stage(score_blocks(placed, by, "score", label), "bootstrap-rows")
    twice = F.raise_error(F.concat(F.lit("bootstrap key is not unique: "), F.col("score").cast("string")))
    ladder = ladder.withColumn("n1", F.when(F.col("n0") + F.col("n1") > 1, twice.cast("long")).otherwise(F.col("n1")))
    kinds = dict(rows.dtypes)
    fields = ", ".join([*(f"{g} {kinds[g]}" for g in by), "score long, copies long, present long"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (r for f in frames for r in f.itertuples(index=False)):
            copies = present = 0
            for at in _resamples_at_once(row):
                both = sum(_copies(row, seed, at))
                copies, present = copies + both.sum(axis=0), present + (both > 0).sum(axis=0)
            out = pd.DataFrame({"score": np.array(row.score, np.int64), "copies": copies, "present": present})
            for g in by:
                out[g] = getattr(row, g)
            yield out[[*by, "score", "copies", "present"]]

    found = _with_draws(ladder, by, resamples, seed).mapInPandas(run, fields)
    return same_keys(placed, found, [*by, "score"]).drop("score")


def interval_verdict(lo: Column, hi: Column) -> Column:
    return F.when(hi < 0, "first cheaper").when(lo > 0, "second cheaper").otherwise("not separated")
