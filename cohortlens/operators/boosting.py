"""Boosted trees by histograms, many configurations in the same passes.

Rows hold the bin of each feature and the margins of every configuration. A level of a tree is one aggregate: tasks
sum gradient, second derivative and count per (configuration, node, feature, bin), Spark adds these histograms, and the best split
of each node is found where its histogram is. Trees grow in blocks; inside a block margins follow from the few trees of the
block, at its end they are written out. Validation loss is scored for every prefix of the block's trees, so growing
stops ``patience`` trees after the best one and the model is that prefix, without another fit.

A group of at most ``LOCAL_ROWS`` rows has complete histograms inside one task; there configurations are dealt over tasks instead
of rows, each task grows all trees of its configuration by the same splits and stops by the same losses, and one job fits them all.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.session import stage
from cohortlens.operators.logistic import summed

BLOCK_TREES = 10
MIN_HESSIAN = 1e-3
#: Rows that make a partition of their own, so a small table is not spread over more tasks than it pays for.
ROWS_PER_TASK = 20_000
#: A group of so few rows, fitted and held out, is copied to a task for each of its configurations: some 200 bytes a row there at 36 features.
LOCAL_ROWS = 3_000_000
#: A node of so many rows sums its smaller child only; the other child is what is left of the node.
SUBTRACT_ROWS = 4_096
#: A node of so many rows is summed by joint bins of features; the sums of each feature follow from the joint ones.
JOINT_ROWS = 4_096
#: Joint bins of a pack of features: three sums of that many numbers stay in a core's cache.
JOINT_CELLS = 4_096
#: Rows that are summed at a time.
CHUNK = 1 << 14
#: Histograms of all tasks of a pass come to the driver up to this size; beyond it Spark adds them and finds the splits.
DRIVER_BYTES = 1 << 25


@dataclass(frozen=True)
class BoostSpec:
    """A configuration for the rows of ``group``."""

    name: str
    group: int
    max_depth: int
    learning_rate: float
    min_rows: int


class Tree:
    """Nodes in heap order from 1; ``feature`` is -1 at a leaf. An ordered feature goes right above ``bin``, another one unless equal."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1)
        self.feature = np.full(size, -1, np.int32)
        self.bin = np.zeros(size, np.int32)
        self.value = np.zeros(size)

    def leaves(self, bins: np.ndarray, ordered: np.ndarray, levels: int = 64) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not inner.size:
                break
            f, own = f[inner], at[inner]
            b = bins[inner, f]
            at[inner] = 2 * own + np.where(ordered[f], b > self.bin[own], b != self.bin[own])
        return at

    def sides(self, cols: np.ndarray, rows: np.ndarray, node: int, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a split node that go left and right, in the order they came; ``cols`` has a line of bins per feature."""
        f, out, n, later = self.feature[node], np.empty_like(rows), 0, []
        for at in range(0, rows.size, CHUNK):
            some = rows[at : at + CHUNK]
            bins = cols[f].take(some)
            right = bins > self.bin[node] if ordered[f] else bins != self.bin[node]
            left = some.take(np.flatnonzero(~right))
            out[n : n + left.size] = left
            n += left.size
            later.append(some.take(np.flatnonzero(right)))
        if later:
            np.concatenate(later, out=out[n:])
        return out[:n], out[n:]

    def routed(self, cols: np.ndarray, ordered: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, its rows) for all rows of ``cols``."""
        todo = [(1, np.arange(cols.shape[1]))]
        while todo:
            node, rows = todo.pop()
            if not rows.size:
                continue
            if self.feature[node] < 0:
                yield node, rows
            else:
                todo += zip((2 * node, 2 * node + 1), self.sides(cols, rows, node, ordered))


@dataclass(frozen=True)
class Layout:
    """Bins of a group's features: where each begins in a histogram, and which features are ordered."""

    sizes: np.ndarray
    ordered: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)

    @property
    def total(self) -> int:
        return int(self.sizes.sum())

    @property
    def packs(self) -> list[list[int]]:
        """Features side by side: the bins of a pack's features are one number below ``JOINT_CELLS``, or a feature is alone."""
        packs: list[tuple[int, list[int]]] = []
        for f in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[f])
            at = next((k for k, (cells, _) in enumerate(packs) if cells * size <= JOINT_CELLS), len(packs))
            cells, some = packs[at] if at < len(packs) else (1, [])
            packs[at : at + 1] = [(cells * size, [*some, f])]
        return [some for _, some in packs]


@dataclass(frozen=True)
class BoostFit:
    spec: BoostSpec
    layout: Layout
    start: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)

    def probability(self, bins: np.ndarray) -> np.ndarray:
        margin = np.full(len(bins), self.start)
        cols = np.ascontiguousarray(bins.T, "<u2")
        for tree in self.trees:
            for node, rows in tree.routed(cols, self.layout.ordered):
                margin[rows] += tree.value[node]
        return 1.0 / (1.0 + np.exp(-margin))


def best_iteration(losses: Sequence[float], patience: int) -> int:
    """Number of trees at the lowest loss, looking no further than ``patience`` trees past it."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def bin_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Bins of the rows from a binary column of two bytes a feature."""
    first, size = column.offset, 2 * width
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * first)
    if column.null_count or (np.diff(ends) != size).any():
        raise ValueError(f"bins of other than {size} bytes")
    return np.frombuffer(column.buffers()[2], "<u2", len(column) * width, int(ends[0])).reshape(len(column), width)


def bin_column(bins: np.ndarray) -> pa.Array:
    """Binary column of two bytes a feature from the bins of the rows."""
    flat = np.ascontiguousarray(bins, "<u2")
    ends = np.arange(len(flat) + 1, dtype=np.int32) * (2 * flat.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def best_splits(hist: np.ndarray, layout: Layout, min_rows: int) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """(feature, bin, gain, sums of the left side, sums of all) for a (3, bins) histogram; feature -1 for no split."""
    first = int(layout.sizes[0]) if layout.sizes.size else 0
    whole = hist[:, :first].sum(axis=1)
    run = np.cumsum(hist, axis=1)
    feature = np.repeat(np.arange(layout.sizes.size), layout.sizes)
    before = np.concatenate((np.zeros((3, 1)), run), axis=1)[:, layout.starts[feature]]
    ordered = layout.ordered[feature]
    left = np.where(ordered, run - before, hist)
    right = whole[:, None] - left
    last = np.zeros(layout.total, bool)
    last[layout.starts + layout.sizes - 1] = True
    ok = (left[2] >= min_rows) & (right[2] >= min_rows) & (left[1] >= MIN_HESSIAN) & (right[1] >= MIN_HESSIAN) & ~(ordered & last)
    if not ok.any():
        return -1, 0, 0.0, whole, whole
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1], -np.inf)
    k = int(gain.argmax())
    if not gain[k] > 1e-10:
        return -1, 0, 0.0, whole, whole
    return int(feature[k]), int(k - layout.starts[feature[k]]), float(gain[k]), left[:, k], whole


def histogram(cols: np.ndarray, rows: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, layout: Layout) -> np.ndarray:
    """Sums of ``g``, of ``h`` and of ones for each (node, sum, bin of the layout) over ``rows``; ``cols`` has a line per feature."""
    out = np.empty((nodes, 3, layout.total))
    g, h, some = g[rows], h[rows], rows.size < cols.shape[1]
    for col, start, size in zip(cols, layout.starts, layout.sizes):
        cell = node * size + (col[rows] if some else col)
        for k, v in enumerate((g, h, None)):
            out[:, k, start : start + size] = np.bincount(cell, v, nodes * size).reshape(nodes, size)
    return out


class _Work:
    """What tasks need of the configurations that still grow: trees of the block and the one in work."""

    def __init__(self, specs, layouts, slots, block, growing, level):
        self.specs, self.layouts, self.slots, self.block, self.growing, self.level = specs, layouts, slots, block, growing, level

    def groups(self, batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
        for g in sorted({self.specs[i].group for i in self.growing}):
            mine = batch.filter(pc.equal(batch.column("grp"), g))
            if mine.num_rows:
                margins = np.asarray(mine.column("margins").flatten()).reshape(mine.num_rows, -1)
                yield g, mine, bin_matrix(mine.column("bins"), self.layouts[g].sizes.size), margins

    def of(self, g: int) -> list[int]:
        return [i for i in self.growing if self.specs[i].group == g]


def _histograms(work: _Work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, mine, bins, margins in work.groups(batch):
                layout = work.layouts[g]
                y, w = np.asarray(mine.column("y"), float), np.asarray(mine.column("weight"))
                cols = np.ascontiguousarray(bins.T)
                for i in work.of(g):
                    tree, nodes = work.growing[i], 2**work.level
                    if work.level >= work.specs[i].max_depth:
                        continue
                    margin = margins[:, work.slots[i]].copy()
                    for t in work.block[i]:
                        margin += t.value[t.leaves(bins, layout.ordered)]
                    p = 1.0 / (1.0 + np.exp(-margin))
                    at = tree.leaves(bins, layout.ordered, work.level)
                    there = np.flatnonzero(at >= nodes)
                    if not there.size:
                        continue
                    found = histogram(cols, there, at[there] - nodes, nodes, w * (p - y), w * p * (1 - p), layout)
                    sums[i] = sums.get(i, 0) + found
        rows = [(i, n, hist.ravel()) for i, found in sums.items() for n, hist in enumerate(found) if hist[2].any()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                ],
                ["config", "node", "hist"],
            )

    return run


def _split_rows(specs: Sequence[BoostSpec], layouts: Mapping[int, Layout]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                spec = specs[r.config]
                layout = layouts[spec.group]
                f, b, gain, left, whole = best_splits(np.array(r.hist).reshape(3, layout.total), layout, spec.min_rows)
                out.append((r.config, r.node, f, b, gain, *left[:2].tolist(), *whole[:2].tolist()))
            yield pd.DataFrame(out, columns=_SPLIT_NAMES)

    return run


_SPLIT_NAMES = ["config", "node", "feature", "bin", "gain", "gl", "hl", "g", "h"]
_SPLIT = "config int, node int, feature int, bin int, gain double, gl double, hl double, g double, h double"


def _prefix_losses(work: _Work):
    """Summed log-loss of the held-out rows after each tree of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, mine, bins, margins in work.groups(batch):
                y = np.asarray(mine.column("y"), float)
                for i in work.of(g):
                    margin = margins[:, work.slots[i]].copy()
                    for k, t in enumerate(work.block[i]):
                        margin += t.value[t.leaves(bins, work.layouts[g].ordered)]
                        loss = np.logaddexp(0.0, margin).sum() - y @ margin
                        sums[i, k] = sums.get((i, k), 0) + np.array([loss, y.size])
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int32()), pa.array([v[0] for v in sums.values()]), pa.array([v[1] for v in sums.values()])],
                ["config", "tree", "loss", "n"],
            )

    return run


def _moved_margins(work: _Work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, mine, bins, margins in work.groups(batch):
                margins = margins.copy()
                for i in work.of(g):
                    for t in work.block[i]:
                        margins[:, work.slots[i]] += t.value[t.leaves(bins, work.layouts[g].ordered)]
                flat = pa.ListArray.from_arrays(np.arange(len(margins) + 1, dtype=np.int32) * margins.shape[1], pa.array(margins.ravel()))
                yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in ("grp", "fit", "y", "weight", "bins")), flat], ["grp", "fit", "y", "weight", "bins", "margins"])

    return run


def fit_boosted(
    rows: DataFrame,
    specs: Sequence[BoostSpec],
    layouts: Mapping[int, Layout],
    max_trees: int | Sequence[int],
    patience: int | None,
    block_trees: int = BLOCK_TREES,
) -> list[BoostFit]:
    """Fit every configuration on the rows of its group with ``fit``; the other rows are the held-out ones.

    ``rows`` has grp, fit, y, weight and bins (two bytes a feature). Without ``patience`` all ``max_trees`` are grown, a number
    for all or one for each configuration. Classes are weighted by ``weight``; margins start at the weighted log-odds.
    """
    limits = [max_trees] * len(specs) if isinstance(max_trees, int) else list(max_trees)
    of_fit = F.col("fit")
    base = {
        r["grp"]: (r["pos"] or 0.0, r["w"], r["n"])
        for r in rows.groupBy("grp").agg(
            F.sum(F.when(of_fit & (F.col("y") == 1), F.col("weight"))).alias("pos"), F.sum(F.when(of_fit, F.col("weight"))).alias("w"), F.count(F.lit(1)).alias("n")
        ).where("w IS NOT NULL").collect()
    }
    start = {g: float(np.log(max(p, 1e-9) / max(w - p, 1e-9))) for g, (p, w, _) in base.items()}
    for s in specs:
        if s.group not in start:
            raise ValueError(f"configuration {s.name} has no rows to fit in group {s.group}")
    inside = [i for i, s in enumerate(specs) if base[s.group][2] <= LOCAL_ROWS and limits[i] > 0]
    done = _fit_inside(rows, specs, layouts, start, {g: n for g, (_, _, n) in base.items()}, limits, patience, inside) if inside else {}
    rest = [i for i in range(len(specs)) if i not in done]
    if rest:
        found = _fit_by_passes(rows, [specs[i] for i in rest], layouts, start, [limits[i] for i in rest], patience, block_trees)
        done |= dict(zip(rest, found))
    return [BoostFit(s, layouts[s.group], start[s.group], *done[i]) for i, s in enumerate(specs)]


def _fit_by_passes(rows: DataFrame, specs, layouts, start, limits: Sequence[int], patience: int | None, block_trees: int) -> list[tuple[list[Tree], list[float]]]:
    """Trees and losses of configurations of any number of rows, a level of all of them a pass."""
    slots: list[int] = []
    per_group: dict[int, int] = {}
    for s in specs:
        slots.append(per_group.get(s.group, 0))
        per_group[s.group] = slots[-1] + 1
    first = F.create_map(*[F.lit(x) for g, n in per_group.items() for x in (g, [start[g]] * n)])
    mine = rows.where(F.col("grp").isin(list(per_group)))
    tasks = max(1, min(mine.count() // ROWS_PER_TASK + len(per_group), 1 << 16))
    slim = mine.select("grp", "fit", "y", "weight", "bins", F.element_at(first, F.col("grp")).alias("margins"))
    now = stage(slim.coalesce(tasks), "margins")
    trees: list[list[Tree]] = [[] for _ in specs]
    losses: list[list[float]] = [[] for _ in specs]
    active = [i for i in range(len(specs)) if limits[i] > 0]
    while active:
        block: dict[int, list[Tree]] = {i: [] for i in active}
        wanted = {i: min(block_trees, limits[i] - len(trees[i])) for i in active}
        for _ in range(block_trees):
            grow = {i: Tree(specs[i].max_depth) for i in active if len(block[i]) < wanted[i]}
            if not grow:
                break
            _grow(now.where("fit").coalesce(tasks), tasks, specs, layouts, slots, block, grow)
            for i, tree in grow.items():
                block[i].append(tree)
        work = _Work(specs, layouts, slots, block, dict.fromkeys(active), 0)
        if patience is not None:
            found = now.where("not fit").coalesce(tasks).mapInArrow(_prefix_losses(work), "config int, tree int, loss double, n double")
            for r in found.groupBy("config", "tree").agg((F.sum("loss") / F.sum("n")).alias("loss")).orderBy("config", "tree").collect():
                losses[r["config"]].append(r["loss"])
        still = []
        for i in active:
            trees[i] += block[i]
            best = best_iteration(losses[i], patience) if patience is not None and losses[i] else len(trees[i])
            stopped = patience is not None and len(losses[i]) - best >= patience
            if stopped or len(trees[i]) >= limits[i]:
                trees[i] = trees[i][:best]
            else:
                still.append(i)
        active = still
        if active:
            work = _Work(specs, layouts, slots, block, dict.fromkeys(active), 0)
            now = stage(now.coalesce(tasks).mapInArrow(_moved_margins(work), now.schema), "margins")
    return list(zip(trees, losses))


def _splits(parts: DataFrame, size: int, specs: Sequence[BoostSpec], layouts: Mapping[int, Layout]) -> Iterator[dict]:
    """Best split of every node from partial histograms of ``size`` bytes at most."""
    if size > DRIVER_BYTES:
        for r in summed(parts, ["config", "node"], "hist").mapInPandas(_split_rows(specs, layouts), _SPLIT).collect():
            yield r.asDict()
        return
    table = parts.toArrow()
    whole: dict[tuple[int, int], np.ndarray] = {}
    for config, node, hist in zip(table.column("config").to_pylist(), table.column("node").to_pylist(), table.column("hist")):
        values = np.asarray(hist.values)
        whole[config, node] = whole[config, node] + values if (config, node) in whole else values
    for (config, node), hist in sorted(whole.items()):
        layout = layouts[specs[config].group]
        f, b, gain, left, every = best_splits(hist.reshape(3, layout.total), layout, specs[config].min_rows)
        yield dict(zip(_SPLIT_NAMES, (config, node, f, b, gain, *left[:2].tolist(), *every[:2].tolist())))


class _Rows:
    """Rows that are all here: a line of bins per feature, and for large nodes the joint bins of each pack of features."""

    def __init__(self, bins: np.ndarray, layout: Layout):
        self.layout, self.packs = layout, layout.packs
        self.cols = np.ascontiguousarray(bins.T)
        self.shapes = [self.layout.sizes[pack] for pack in self.packs]
        self.joint = np.column_stack([self._together(pack) for pack in self.packs]) if len(bins) >= JOINT_ROWS else None
        #: Rows of each joint bin among all rows, the same for every tree.
        self.counts = [] if self.joint is None else [np.bincount(col, minlength=int(np.prod(s))) for col, s in zip(self.joint.T, self.shapes)]

    def _together(self, pack: Sequence[int]) -> np.ndarray:
        out = self.cols[pack[0]].astype("<u2")
        for f in pack[1:]:
            out *= np.uint16(self.layout.sizes[f])
            out += self.cols[f]
        return out

    def histogram(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums of ``g``, of ``h`` and of ones for each bin of the layout over ``rows``."""
        layout = self.layout
        if rows.size < JOINT_ROWS:
            cells = (self.cols.take(rows, axis=1) + layout.starts[:, None]).ravel()
            weights = [np.tile(v.take(rows), len(self.cols)) for v in (g, h)]
            return np.stack([np.bincount(cells, v, layout.total) for v in (*weights, None)])
        sums = [np.zeros((3, int(np.prod(shape)))) for shape in self.shapes]
        whole = rows.size == len(self.joint)
        for at in range(0, rows.size, CHUNK):
            some = slice(at, at + CHUNK)
            block = self.joint[some] if whole else self.joint.take(rows[some], axis=0)
            values = (g[some], h[some]) if whole else (g.take(rows[some]), h.take(rows[some]), None)
            for i, total in enumerate(sums):
                cells = block[:, i].astype(np.int64)
                for k, v in enumerate(values):
                    total[k] += np.bincount(cells, v, total.shape[1])
        for total, n in zip(sums, self.counts if whole else ()):
            total[2] = n
        out = np.empty((3, layout.total))
        for pack, shape, total in zip(self.packs, self.shapes, sums):
            for f, part in zip(pack, _alone(total, shape)):
                out[:, layout.starts[f] : layout.starts[f] + layout.sizes[f]] = part
        return out


def _alone(joint: np.ndarray, shape: np.ndarray) -> Iterator[np.ndarray]:
    """Sums of each feature from (3, joint bins), the last feature's bin counting fastest."""
    if len(shape) == 1:
        yield joint
        return
    half = len(shape) // 2
    both = joint.reshape(3, int(np.prod(shape[:half])), -1)
    yield from _alone(both.sum(axis=2), shape[:half])
    yield from _alone(both.sum(axis=1), shape[half:])


def _without(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """What ``part`` leaves of a histogram; a bin without rows has no remainder of rounding either."""
    rest = whole - part
    rest[:2] = np.where(rest[2] > 0, rest[:2], 0.0)
    return rest


def grow_tree(data: _Rows, y: np.ndarray, w: np.ndarray, margin: np.ndarray, spec: BoostSpec) -> Tree:
    """One tree over rows that are all here, a level at a time; ``margin`` is moved by the leaves."""
    layout, tree = data.layout, Tree(spec.max_depth)
    g, h, every = np.empty(y.size), np.empty(y.size), np.arange(y.size)
    for at in range(0, y.size, CHUNK):
        some = slice(at, at + CHUNK)
        p = 1.0 / (1.0 + np.exp(-margin[some]))
        g[some], h[some] = w[some] * (p - y[some]), w[some] * p * (1 - p)
    level = [(1, every, data.histogram(every, g, h))] if y.size else []
    for depth in range(spec.max_depth + 1):
        below = []
        for node, rows, hist in level:
            f = -1
            if depth < spec.max_depth:
                f, b, _, left, whole = best_splits(hist, layout, spec.min_rows)
                _set_node(tree, node, spec.learning_rate, f, b, *left[:2].tolist(), *whole[:2].tolist())
            if f < 0:
                margin[rows] += tree.value[node]
                continue
            sides = tree.sides(data.cols, rows, node, layout.ordered)
            hists: list[np.ndarray | None] = [None, None]
            if depth + 1 < spec.max_depth:
                small = int(sides[0].size > sides[1].size)
                hists[small] = data.histogram(sides[small], g, h)
                hists[1 - small] = _without(hist, hists[small]) if rows.size >= SUBTRACT_ROWS else data.histogram(sides[1 - small], g, h)
            below += zip((2 * node, 2 * node + 1), sides, hists)
        level = below
    return tree


def _set_node(tree: Tree, at: int, rate: float, feature: int, bin_: int, gl: float, hl: float, g: float, h: float) -> bool:
    tree.value[at] = -rate * g / h if h > 0 else 0.0
    if feature < 0:
        return False
    tree.feature[at], tree.bin[at] = feature, bin_
    tree.value[2 * at] = -rate * gl / hl
    tree.value[2 * at + 1] = -rate * (g - gl) / (h - hl)
    return True


def _packed(layouts: Mapping[int, Layout]):
    """Rows of a group as one row of bytes a batch, numbered by task and place; a byte a bin where that is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for at, batch in enumerate(batches):
            for g in sorted(layouts):
                mine = batch.filter(pc.equal(batch.column("grp"), g))
                if not mine.num_rows:
                    continue
                bins = bin_matrix(mine.column("bins"), layouts[g].sizes.size).astype(_bin_type(layouts[g]))
                fit = np.asarray(mine.column("fit").cast(pa.int8()))
                y, w = np.asarray(mine.column("y"), float), np.asarray(mine.column("weight"), float)
                yield pa.RecordBatch.from_pydict(
                    {"grp": pa.array([g], pa.int32()), "task": pa.array([task], pa.int32()), "place": pa.array([at], pa.int32())}
                    | {n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(_PACKED, (fit, y, w, bins))}
                )

    return run


_PACKED = ["fit", "y", "weight", "bins"]


def _bin_type(layout: Layout) -> str:
    return "<u1" if layout.sizes.size and layout.sizes.max() <= 256 else "<u2"


def _all_trees(specs, layouts, start, limits: Sequence[int], patience: int | None):
    """Trees and held-out losses of each configuration whose packed rows come in."""

    def fitted(i: int, chunks: list[tuple]) -> tuple[list[Tree], list[float]]:
        spec, layout = specs[i], layouts[specs[i].group]
        fit, y, w, bins = (np.concatenate([np.frombuffer(c[k], t) for c in sorted(chunks)]) for k, t in zip(range(2, 6), ("i1", float, float, _bin_type(layout))))
        fit, bins = fit.astype(bool), bins.reshape(y.size, layout.sizes.size)
        held, held_y = np.ascontiguousarray(bins[~fit].T), y[~fit]
        data, y, w = _Rows(bins[fit], layout), y[fit], w[fit]
        margin, held_margin = np.full(y.size, start[spec.group]), np.full(held_y.size, start[spec.group])
        trees: list[Tree] = []
        losses: list[float] = []
        best = 0
        while len(trees) < limits[i]:
            tree = grow_tree(data, y, w, margin, spec)
            trees.append(tree)
            if patience is None or not held_y.size:
                continue
            for node, rows in tree.routed(held, layout.ordered):
                held_margin[rows] += tree.value[node]
            losses.append(float((np.logaddexp(0.0, held_margin).sum() - held_y @ held_margin) / held_y.size))
            best = len(losses) - 1 if losses[-1] < losses[best] else best
            if len(losses) - 1 - best >= patience:
                break
        return trees[: best + 1] if losses else trees, losses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                chunks.setdefault(r["config"], []).append((r["task"], r["place"], *(r[n] for n in _PACKED)))
        for i in sorted(chunks):
            trees, losses = fitted(i, chunks.pop(i))
            parts = [np.concatenate([getattr(t, n) for t in trees] or [np.zeros(0)]) for n in ("feature", "bin", "value")]
            yield pa.RecordBatch.from_pydict(
                {"config": pa.array([i], pa.int32()), "n": pa.array([len(trees)], pa.int32()), "losses": pa.array([losses], pa.list_(pa.float64()))}
                | {n: pa.array([v.astype(t).tobytes()], pa.binary()) for n, v, t in zip(("feature", "bin", "value"), parts, ("<i4", "<i4", "<f8"))}
            )

    return run


def _fit_inside(rows: DataFrame, specs, layouts, start, size: Mapping[int, int], limits: Sequence[int], patience: int | None, inside: Sequence[int]) -> dict[int, tuple[list[Tree], list[float]]]:
    """Trees and losses of the configurations of groups whose rows fit a task: one job, a task for each, the longest first."""
    order = sorted(inside, key=lambda i: (specs[i].learning_rate, -size[specs[i].group], -specs[i].max_depth, specs[i].min_rows, i))
    mine: dict[int, list] = {}
    for at, i in enumerate(order):
        mine.setdefault(specs[i].group, []).append(F.struct(F.lit(i).alias("config"), F.lit(at).alias("to")))
    copies = F.create_map(*[x for g, wanted in mine.items() for x in (F.lit(g), F.array(*wanted))])
    some = rows.where(F.col("fit").isNotNull() & F.col("grp").isin(sorted(mine))).select("grp", *_PACKED)
    packed = some.mapInArrow(_packed({g: layouts[g] for g in mine}), "grp int, task int, place int, fit binary, y binary, weight binary, bins binary")
    dealt = packed.select(F.explode(F.element_at(copies, F.col("grp"))).alias("c"), "task", "place", *_PACKED).select("c.*", "task", "place", *_PACKED)
    grown = dealt.repartitionById(len(order), "to").mapInArrow(
        _all_trees(specs, layouts, start, limits, patience), "config int, n int, losses array<double>, feature binary, bin binary, value binary"
    )
    out = {}
    for r in grown.collect():
        trees, nodes = [], 2 ** (specs[r["config"]].max_depth + 1)
        arrays = [np.frombuffer(r[n], t).reshape(r["n"], nodes) for n, t in (("feature", "<i4"), ("bin", "<i4"), ("value", "<f8"))]
        for k in range(r["n"]):
            tree = Tree(specs[r["config"]].max_depth)
            tree.feature[:], tree.bin[:], tree.value[:] = (a[k] for a in arrays)
            trees.append(tree)
        out[r["config"]] = (trees, list(r["losses"]))
    return out


def _grow(rows: DataFrame, tasks: int, specs, layouts, slots, block, grow: dict[int, Tree]) -> None:
    """Grow one tree of each configuration, a level of all of them a pass; leaf values get the learning rate."""
    for level in range(max(specs[i].max_depth for i in grow)):
        work = _Work(specs, layouts, slots, block, grow, level)
        parts = rows.mapInArrow(_histograms(work), "config int, node int, hist array<double>")
        deep = [i for i in grow if level < specs[i].max_depth]
        size = tasks * sum(24 * layouts[specs[i].group].total * max(1, np.count_nonzero(grow[i].feature[2**level // 2 : 2**level] >= 0) * 2) for i in deep)
        split = 0
        for r in _splits(parts, size, specs, layouts):
            rate = specs[r["config"]].learning_rate
            split += _set_node(grow[r["config"]], 2**level + r["node"], rate, r["feature"], r["bin"], r["gl"], r["hl"], r["g"], r["h"])
        if not split:
            break
