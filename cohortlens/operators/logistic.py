"""Many L2 logistic regressions over one table in one loop of Newton steps.

A step is one pass: every task sums, for each model of its rows' group, the loss, the gradient and the Gram matrix weighted by
p (1 - p); Spark adds the sums of the tasks. What comes to the driver is one matrix per model, (columns + 1) squared numbers, whatever
the number of rows. Models of any group, column subset and strength share the passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A Gram matrix of more columns is not for the driver; wide designs are fitted by a quasi-Newton method on sparse vectors.
MAX_COLUMNS = 1024
MAX_STEPS, TOLERANCE = 60, 1e-9


@dataclass(frozen=True)
class LogitSpec:
    """A model: rows of ``group``, design columns by position, inverse penalty strength ``c``."""

    name: str
    group: int
    columns: tuple[int, ...]
    c: float


@dataclass(frozen=True)
class LogitFit:
    """Intercept and coefficients; ``gradient`` is the largest absolute score equation per row that the fit leaves."""

    spec: LogitSpec
    intercept: float
    coefficients: np.ndarray
    n_rows: int
    steps: int
    gradient: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(x[:, self.spec.columns] @ self.coefficients + self.intercept)


def _logistic(eta: np.ndarray) -> np.ndarray:
    return np.where(eta >= 0, 1.0, np.exp(np.minimum(eta, 0))) / (1.0 + np.exp(-np.abs(eta)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(specs: Sequence[LogitSpec], betas: Sequence[np.ndarray], group: str, x: str, y: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for g in {s.group for s in specs}:
                mine = batch.filter(pc.equal(batch.column(group), g))
                if not mine.num_rows:
                    continue
                values, label = matrix(mine.column(x)), np.asarray(mine.column(y), float)
                for i, spec in enumerate(specs):
                    if spec.group != g:
                        continue
                    z = np.column_stack((np.ones(label.size), values[:, spec.columns]))
                    eta = z @ betas[i]
                    p = _logistic(eta)
                    loss = np.logaddexp(0.0, eta).sum() - label @ eta
                    gram = (z * (p * (1 - p))[:, None]).T @ z
                    part = np.concatenate(([label.size, loss], z.T @ (p - label), gram.ravel()))
                    totals[i] = totals.get(i, 0) + part
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], ["model", "sums"]
            )

    return run


def summed(parts: DataFrame, by: Sequence[str], values: str) -> DataFrame:
    """Element-wise sums of an array column, combined inside tasks before the shuffle."""
    total = Summarizer.sum(array_to_vector(F.col(values)))
    return parts.groupBy(*by).agg(vector_to_array(total).alias(values))


def fit_logits(
    rows: DataFrame, specs: Sequence[LogitSpec], group: str, x: str = "x", y: str = "y", max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE
) -> list[LogitFit]:
    """Minimise, for each model, the summed logistic loss plus squared coefficients / (2 c); the intercept is free.

    ``rows`` is read once per step and should be a stored table. A step that raises the loss is halved. A model is done when
    no score equation is off by more than ``tolerance`` per row; a group without rows is an error.
    """
    wide = [s.name for s in specs if len(s.columns) > MAX_COLUMNS]
    if wide:
        raise ValueError(f"models with more than {MAX_COLUMNS} columns: {wide}")
    betas = [np.zeros(len(s.columns) + 1) for s in specs]
    moves = [np.zeros(len(s.columns) + 1) for s in specs]
    before = [np.inf] * len(specs)
    done: dict[int, LogitFit] = {}
    for step in range(max_steps + 1):
        open_ = [i for i in range(len(specs)) if i not in done]
        if not open_:
            break
        parts = rows.select(group, x, y).mapInArrow(_sums([specs[i] for i in open_], [betas[i] for i in open_], group, x, y), "model int, sums array<double>")
        found = {r["model"]: np.array(r["sums"]) for r in summed(parts, ["model"], "sums").collect()}
        for at, i in enumerate(open_):
            if at not in found:
                raise ValueError(f"model {specs[i].name} has no rows in group {specs[i].group}")
            d = betas[i].size
            n, loss, gradient, gram = found[at][0], found[at][1], found[at][2 : 2 + d], found[at][2 + d :].reshape(d, d)
            penalty = np.full(d, 1.0 / specs[i].c)
            penalty[0] = 0.0
            loss = loss + float(penalty @ betas[i] ** 2) / 2
            gradient = gradient + penalty * betas[i]
            off = float(np.abs(gradient).max()) / n
            if loss > before[i] + 1e-9 * abs(before[i]) and np.abs(moves[i]).max() > 1e-12:
                moves[i] = moves[i] / 2
                betas[i] = betas[i] - moves[i]
                continue
            before[i] = loss
            if off <= tolerance or step == max_steps:
                done[i] = LogitFit(specs[i], float(betas[i][0]), betas[i][1:], int(n), step, off)
                continue
            moves[i] = -np.linalg.lstsq(gram + np.diag(penalty), gradient, rcond=None)[0]
            betas[i] = betas[i] + moves[i]
    return [done[i] if i in done else LogitFit(s, float(betas[i][0]), betas[i][1:], 0, max_steps, float("nan")) for i, s in enumerate(specs)]
