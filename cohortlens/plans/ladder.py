"""Model ladder: five rungs from the base rate to boosted trees at every cutoff, chosen by validation cost.

All cutoffs, penalty strengths and boosting configurations are fitted in the same passes over one stored table of encoded
rows (:mod:`operators.logistic`, :mod:`operators.boosting`). Loops here run over configurations, never over rows; what
returns to the driver is a cost per configuration.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalars import null_as_token
from cohortlens.functions.session import stage
from cohortlens.operators.boosting import BoostFit, BoostSpec, Layout, best_iteration, bin_column, bin_matrix, fit_boosted
from cohortlens.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from cohortlens.operators.importance import LEVEL_MARK, MISSING_PREFIX
from cohortlens.operators.logistic import LogitFit, LogitSpec, fit_logits, matrix, summed
from cohortlens.operators.prep import Design, fit_designs
from cohortlens.operators.scoring import best_threshold, confusion, confusion_by_threshold, cost

__all__ = ["best_iteration"]

# Fixed values
RUNGS = ["B0", "B1", "B2", "B3", "M1"]
B1_NUMERIC = ["days_since_last_activity"]
B2_NUMERIC = ["num_of_prev_attempts", "studied_credits"]
B2_CATEGORICAL = ["gender", "region", "highest_education", "imd_band", "age_band", "disability"]
C_GRID = [0.001, 0.01, 0.1, 1.0, 10.0]
LEAVES_TO_DEPTH = {15: 4, 31: 5, 63: 6}
LEARNING_RATES = [0.01, 0.05, 0.1]
MIN_ROWS = [20, 50, 100]
MAX_TREES = 1000
PATIENCE = 50
BASE_SEED = 42
STABILITY_SEEDS = [42, 7, 123, 2024]
TOP_COEFFICIENTS = 15
BOOST_GRID = [
    {"max_depth": float(d), "learning_rate": r, "min_rows": float(m)}
    for d, r, m in itertools.product(LEAVES_TO_DEPTH.values(), LEARNING_RATES, MIN_ROWS)
]

#: Bins of a numeric feature, cut at quantiles of the rows that are fitted.
MAX_BINS = 63


@dataclass(frozen=True)
class Encoder:
    """How the rows of a cutoff become design columns and bins; fitted on the rows that models are fitted on."""

    design: Design
    edges: Mapping[str, Sequence[float]]

    @property
    def layout(self) -> Layout:
        """Numeric features and indicators are ordered; a category is one feature, its last bin for unknown levels."""
        d = self.design
        sizes = [len(self.edges[f]) + 1 for f in d.numeric] + [2] * len(d.indicators) + [len(d.levels[f]) + 1 for f in d.categorical]
        ordered = [True] * (len(d.numeric) + len(d.indicators)) + [False] * len(d.categorical)
        return Layout(np.array(sizes, np.int64), np.array(ordered, bool))

    def positions(self, numeric: Sequence[str], categorical: Sequence[str], indicators: bool) -> tuple[int, ...]:
        """Design columns of a choice of features."""
        wanted = set(numeric) | {MISSING_PREFIX + f for f in numeric if indicators}
        hot = tuple(f + LEVEL_MARK for f in categorical)
        return tuple(i for i, c in enumerate(self.design.columns) if c in wanted or hot and c.startswith(hot))

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        d, x, bins = self.design, [], []
        for f in d.numeric:
            v = np.asarray(batch.column(f), float)
            filled = np.where(np.isnan(v), d.median[f], v)
            x.append((filled - d.mean[f]) / d.std[f])
            bins.append(np.searchsorted(self.edges[f], filled))
        for f in d.indicators:
            missing = np.isnan(np.asarray(batch.column(f), float))
            x.append(missing.astype(float))
            bins.append(missing)
        for f in d.categorical:
            level = np.asarray(pc.fill_null(pc.index_in(batch.column(f), pa.array(d.levels[f], pa.string())), len(d.levels[f])))
            x += [(level == i).astype(float) for i in range(len(d.levels[f]))]
            bins.append(level)
        return np.column_stack(x), np.column_stack(bins).astype("<u2")


def fit_encoders(
    rows: DataFrame, cutoff: str = "cutoff", numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES
) -> dict[int, Encoder]:
    """An encoder for the rows of each cutoff, all from the same reads."""
    designs = fit_designs(rows, cutoff, numeric, categorical)
    probs = [i / MAX_BINS for i in range(1, MAX_BINS)]
    cuts = rows.groupBy(cutoff).agg(*[F.percentile_approx(F.col(f).cast("double"), probs, 10000).alias(f"_{f}") for f in numeric]).collect()
    return {r[cutoff]: Encoder(designs[r[cutoff]], {f: sorted({float(v) for v in r[f"_{f}"] or []}) for f in numeric}) for r in sorted(cuts, key=lambda r: r[cutoff])}


def encode(rows: DataFrame, encoders: Mapping[int, Encoder], keep: Sequence[str], cutoff: str = "cutoff") -> DataFrame:
    """``keep``, then x (design columns) and bins (two bytes a feature) of the rows whose cutoff has an encoder."""
    some = next(iter(encoders.values())).design
    wide = rows.where(F.col(cutoff).isin(list(encoders))).select(
        *keep, *[F.col(f).cast("double").alias(f"_{f}") for f in some.numeric], *[null_as_token(f).alias(f"_{f}") for f in some.categorical]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, encoder in encoders.items():
                mine = batch.filter(pc.equal(batch.column(cutoff), g))
                if not mine.num_rows:
                    continue
                raw = pa.RecordBatch.from_arrays(mine.columns[len(keep) :], [n[1:] for n in mine.schema.names[len(keep) :]])
                x, bins = encoder.rows(raw)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*mine.columns[: len(keep)], lists, bin_column(bins)], [*keep, "x", "bins"])

    kinds = dict(wide.dtypes)
    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "x array<double>, bins binary"])
    return wide.mapInArrow(run, fields)


@dataclass(frozen=True)
class Model:
    """A fitted rung at a cutoff: hyperparameters and what turns encoded rows into probabilities."""

    cutoff: int
    rung: str
    params: Mapping[str, float] = field(default_factory=dict)
    fitted: float | LogitFit | BoostFit = 0.0

    def probability(self, x: np.ndarray, bins: np.ndarray) -> np.ndarray:
        if isinstance(self.fitted, LogitFit):
            return self.fitted.probability(x)
        if isinstance(self.fitted, BoostFit):
            return self.fitted.probability(bins)
        return np.full(len(x), self.fitted)


def score_models(encoded: DataFrame, models: Sequence[Model], keep: Sequence[str], cutoff: str = "cutoff") -> DataFrame:
    """``keep``, model (position in ``models``), rung and p: one row for each model of the row's cutoff."""
    widths = {m.cutoff: m.fitted.layout.sizes.size for m in models if isinstance(m.fitted, BoostFit)}
    kinds = dict(encoded.dtypes)
    rows = encoded.select(*dict.fromkeys([*keep, cutoff, "x", "bins"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in sorted({m.cutoff for m in models}):
                mine = batch.filter(pc.equal(batch.column(cutoff), g))
                if not mine.num_rows:
                    continue
                x = matrix(mine.column("x"))
                bins = bin_matrix(mine.column("bins"), widths[g]) if g in widths else np.zeros((len(x), 0), np.int64)
                n = mine.num_rows
                for i, m in enumerate(models):
                    if m.cutoff == g:
                        yield pa.RecordBatch.from_arrays(
                            [*(mine.column(c) for c in keep), pa.array(np.full(n, i, np.int32)), pa.array([m.rung] * n), pa.array(m.probability(x, bins))],
                            [*keep, "model", "rung", "p"],
                        )

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "model int, rung string, p double"]))


@dataclass(frozen=True)
class Ladder:
    """Chosen models of all cutoffs with frozen thresholds; ``trials`` has (model, validation cost) of every candidate."""

    encoders: Mapping[int, Encoder]
    models: Mapping[tuple[int, str], Model]
    thresholds: Mapping[tuple[int, str], float]
    costs: Mapping[tuple[int, str], float]
    trials: Sequence[tuple[Model, float]]

    def policy(self, spark) -> DataFrame:
        """Flat frozen policy: (cutoff, rung, threshold, validate_cost, params)."""
        rows = [(c, r, self.thresholds[c, r], self.costs[c, r], dict(m.params)) for (c, r), m in self.models.items()]
        return spark.createDataFrame(rows, "cutoff int, rung string, threshold double, validate_cost double, params map<string,double>")

    def score(self, rows: DataFrame, keep: Sequence[str], cutoff: str = "cutoff") -> DataFrame:
        """``keep`` with the cutoff, rung and p of raw feature rows."""
        names = list(dict.fromkeys([cutoff, *keep]))
        return score_models(encode(rows, self.encoders, names, cutoff), list(self.models.values()), names, cutoff).drop("model")


@dataclass(frozen=True)
class Prepared:
    """Encoded rows of the splits and what encoded them; ``fit`` marks the rows that models are fitted on."""

    encoders: Mapping[int, Encoder]
    rows: DataFrame
    key: Sequence[str]


def prepare(rows: DataFrame, fit: str, label: str, key: Sequence[str], cutoff: str = "cutoff") -> Prepared:
    """Encoders from the rows where the condition ``fit`` holds, and all rows encoded, written out once.

    Positive rows weigh as many negatives as there are per positive among the fitted rows of their cutoff.
    """
    fitted = rows.where(fit)
    counts = fitted.groupBy(cutoff).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    heavy = {r[cutoff]: (r["n"] - r["pos"]) / r["pos"] if r["pos"] else 1.0 for r in counts}
    encoders = fit_encoders(fitted, cutoff)
    weights = F.create_map(*[F.lit(v) for pair in heavy.items() for v in pair])
    flagged = rows.select("*", F.expr(fit).alias("fit"), F.col(label).cast("double").alias("y"), F.col(cutoff).alias("grp"))
    coded = encode(flagged, encoders, [cutoff, "grp", *key, "fit", "y"], cutoff)
    return Prepared(encoders, stage(coded.withColumn("weight", F.when(F.col("y") == 1, F.element_at(weights, F.col("grp"))).otherwise(1.0)), "encoded"), key)


def _logits(made: Prepared, wanted: Sequence[tuple[int, str, float]]) -> list[Model]:
    """Logistic rungs (cutoff, rung, C), all in one loop."""
    if not wanted:
        return []
    choices = {"B1": (B1_NUMERIC, [], False), "B2": (B2_NUMERIC, B2_CATEGORICAL, True), "B3": (NUMERIC_FEATURES, CATEGORICAL_FEATURES, True)}
    specs = [LogitSpec(f"{r} at {c}", c, made.encoders[c].positions(*choices[r]), strength) for c, r, strength in wanted]
    fits = fit_logits(made.rows.where("fit"), specs, "grp")
    return [Model(c, r, {"C": float(strength)}, f) for (c, r, strength), f in zip(wanted, fits)]


def _boosted(made: Prepared, wanted: Sequence[tuple[int, Mapping[str, float]]], max_trees: int, patience: int | None) -> list[Model]:
    """Boosted rungs (cutoff, hyperparameters), all in one loop; ``n_trees`` among these is the number to grow."""
    if not wanted:
        return []
    specs = [BoostSpec(f"M1 at {c}", c, int(p["max_depth"]), p["learning_rate"], int(p["min_rows"])) for c, p in wanted]
    limits = [int(p["n_trees"]) if patience is None else max_trees for _, p in wanted]
    fits = fit_boosted(made.rows, specs, {c: e.layout for c, e in made.encoders.items()}, limits, patience)
    return [Model(c, "M1", {**p, "n_trees": float(len(f.trees))}, f) for (c, p), f in zip(wanted, fits)]


def _base_rates(made: Prepared) -> list[Model]:
    rates = made.rows.where("fit").groupBy("grp").agg(F.avg("y").alias("p")).orderBy("grp").collect()
    return [Model(r["grp"], "B0", {}, r["p"]) for r in rates]


def fit_base_rate(train: DataFrame, label: str, cutoff: str = "cutoff") -> DataFrame:
    """(cutoff, p): the base rate of each cutoff."""
    return train.groupBy(cutoff).agg(F.avg(F.col(label).cast("double")).alias("p"))


def fit_ladder(
    rows: DataFrame,
    label: str,
    key: Sequence[str],
    fit: str = "split = 'train'",
    c_grid: Sequence[float] = C_GRID,
    boost_grid: Sequence[Mapping[str, float]] = BOOST_GRID,
    max_trees: int = MAX_TREES,
    patience: int = PATIENCE,
    only: Sequence[str] = RUNGS,
) -> Ladder:
    """Fit where ``fit`` holds, choose hyperparameters and thresholds on the other rows; first choice wins ties."""
    made = prepare(rows, fit, label, key)
    cutoffs = sorted(made.encoders)
    models = _base_rates(made) if "B0" in only else []
    models += _logits(made, [(c, r, s) for c in cutoffs for r, grid in (("B1", [1.0]), ("B2", [1.0]), ("B3", c_grid)) if r in only for s in grid])
    if "M1" in only:
        models += _boosted(made, [(c, p) for c in cutoffs for p in boost_grid], max_trees, patience)
    return choose(made, models)


def choose(made: Prepared, models: Sequence[Model]) -> Ladder:
    """Cheapest candidate of each (cutoff, rung) on the rows that were not fitted, with its threshold."""
    scored = score_models(made.rows.where("not fit"), models, ["y"], "grp")
    best = {r["model"]: r for r in best_threshold(confusion_by_threshold(scored, ["model"]), ["model"]).collect()}
    chosen: dict[tuple[int, str], int] = {}
    for i, m in enumerate(models):
        at = (m.cutoff, m.rung)
        if at not in chosen or best[i]["expected_cost"] < best[chosen[at]]["expected_cost"]:
            chosen[at] = i
    return Ladder(
        made.encoders,
        {at: models[i] for at, i in chosen.items()},
        {at: best[i]["threshold"] for at, i in chosen.items()},
        {at: best[i]["expected_cost"] for at, i in chosen.items()},
        [(m, best[i]["expected_cost"]) for i, m in enumerate(models)],
    )


def refit(ladder: Ladder, rows: DataFrame, label: str, key: Sequence[str], fit: str = "split IN ('train', 'validate')") -> Ladder:
    """Same hyperparameters, thresholds and numbers of trees on more rows, preprocessing refitted as well."""
    made = prepare(rows.where(fit), "true", label, key)
    old = ladder.models
    models = [m for m in _base_rates(made) if (m.cutoff, "B0") in old]
    models += _logits(made, [(c, r, m.params["C"]) for (c, r), m in old.items() if isinstance(m.fitted, LogitFit)])
    models += _boosted(made, [(c, m.params) for (c, _), m in old.items() if isinstance(m.fitted, BoostFit)], MAX_TREES, None)
    return Ladder(made.encoders, {(m.cutoff, m.rung): m for m in models}, ladder.thresholds, ladder.costs, ladder.trials)


def refit_at_seeds(
    ladder: Ladder, rows: DataFrame, label: str, key: Sequence[str], seeds: Sequence[int] = STABILITY_SEEDS, fit: str = "split = 'train'", patience: int = PATIENCE
) -> DataFrame:
    """(seed, cutoff, rung, expected_cost): rungs fitted again at each seed with the chosen hyperparameters, at the frozen thresholds.

    Newton steps and trees over all rows and features draw nothing, so the seed is only the order in which the rows
    reach the tasks. Early stopping is run again, as when the hyperparameters were chosen. The rows of a seed and cutoff are a group
    of their own, so all seeds share the passes.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cutoffs = sorted({c for c, _ in ladder.models})
    groups = {i: (seed, c) for i, (seed, c) in enumerate(itertools.product(seeds, cutoffs))}
    mixed = None
    for at, seed in enumerate(seeds):
        number = F.array_position(F.array(*map(F.lit, cutoffs)), F.col("cutoff")).cast("int") + F.lit(at * len(cutoffs) - 1)
        part = rows.where(F.col("cutoff").isin(cutoffs)).repartition(tasks, F.xxhash64(F.lit(seed), *key)).withColumn("cutoff", number)
        mixed = part if mixed is None else mixed.unionByName(part)
    made = prepare(stage(mixed, "mixed"), fit, label, key)
    old = [(g, m) for g, (_, c) in groups.items() for (at, _), m in ladder.models.items() if at == c]
    models = [m for m in _base_rates(made) if (groups[m.cutoff][1], "B0") in ladder.models]
    models += _logits(made, [(g, m.rung, m.params["C"]) for g, m in old if isinstance(m.fitted, LogitFit)])
    models += _boosted(made, [(g, m.params) for g, m in old if isinstance(m.fitted, BoostFit)], MAX_TREES, patience)
    scored = score_models(made.rows.where("not fit"), models, ["grp", "y"], "grp")
    pairs = F.create_map(*[x for g, (seed, c) in groups.items() for x in (F.lit(g), F.struct(F.lit(seed).alias("seed"), F.lit(c).alias("cutoff")))])
    named = scored.withColumn("of", F.element_at(pairs, F.col("grp"))).select("of.*", "rung", "y", "p")
    return at_thresholds(named, ladder.thresholds, ["seed", "cutoff", "rung"])


def at_thresholds(scored: DataFrame, thresholds: Mapping[tuple[int, str], float], by: Sequence[str] = ("cutoff", "rung")) -> DataFrame:
    """(cutoff, rung, expected_cost) of scored rows at given thresholds; ``by`` may tell groups apart further."""
    at = F.lit(None).cast("double")
    for (c, name), t in thresholds.items():
        at = F.when((F.col("cutoff") == c) & (F.col("rung") == name), F.lit(float(t))).otherwise(at)
    return confusion(scored.withColumn("threshold", at), list(by)).select(*by, cost().alias("expected_cost"))


def _left_over(models: Sequence[Model]):
    """Sums of p - y and of (p - y) x over the rows of a task, a line for each model of these rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g in sorted({m.cutoff for m in models}):
                mine = batch.filter(pc.equal(batch.column("grp"), g))
                if not mine.num_rows:
                    continue
                x, y = matrix(mine.column("x")), np.asarray(mine.column("y"), float)
                for i, m in enumerate(models):
                    if m.cutoff == g:
                        off = m.fitted.probability(x) - y
                        sums[i] = sums.get(i, 0) + np.concatenate(([off.sum()], off @ x))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["model", "sums"]
            )

    return run


def score_equations(made: Prepared, models: Sequence[Model]) -> DataFrame:
    """(cutoff, rung, c, column, residual): what each score equation of the logistic models leaves, per row.

    Sum of (p - y) x over the fitted rows plus coefficient / c, from the rows scored again and not from the fit's own sums;
    tasks add theirs before the shuffle, so what is shuffled does not grow with the rows.
    """
    logits = [m for m in models if isinstance(m.fitted, LogitFit)]
    parts = made.rows.where("fit").select("grp", "x", "y").mapInArrow(_left_over(logits), "model int, sums array<double>")
    sums = summed(parts, ["model"], "sums").select("model", F.posexplode("sums").alias("at", "total"))
    totals = sums.select("model", (F.col("at") - 1).alias("at"), "total")
    rows = []
    for i, m in enumerate(logits):
        names = made.encoders[m.cutoff].design.columns
        rows.append((i, m.cutoff, m.rung, m.params["C"], -1, "(intercept)", 0.0, m.fitted.n_rows))
        rows += [(i, m.cutoff, m.rung, m.params["C"], at, names[at], float(w), m.fitted.n_rows) for at, w in zip(m.fitted.spec.columns, m.fitted.coefficients)]
    named = made.rows.sparkSession.createDataFrame(rows, "model int, cutoff int, rung string, c double, at int, `column` string, weight double, n int")
    both = named.join(totals, ["model", "at"], "left")
    return both.select("cutoff", "rung", "c", "column", ((F.col("total") + F.col("weight") / F.col("c")) / F.col("n")).alias("residual"))


def coefficients(ladder: Ladder, spark, rung: str = "B3") -> DataFrame:
    """(cutoff, column, coefficient) of a logistic rung."""
    rows = [
        (c, ladder.encoders[c].design.columns[at], float(w))
        for (c, r), m in ladder.models.items()
        if r == rung
        for at, w in zip(m.fitted.spec.columns, m.fitted.coefficients)
    ]
    return spark.createDataFrame(rows, "cutoff int, `column` string, coefficient double")


def top_coefficients(found: DataFrame, k: int = TOP_COEFFICIENTS) -> DataFrame:
    """The ``k`` largest by absolute value at each cutoff, ties by column."""
    order = Window.partitionBy("cutoff").orderBy(F.abs("coefficient").desc(), "column")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def fitted_params(ladder: Ladder, spark) -> DataFrame:
    """Hyperparameters read back from the fitted models: (cutoff, rung, parameter, fitted)."""
    rows = []
    for (c, name), m in ladder.models.items():
        if isinstance(m.fitted, BoostFit):
            s = m.fitted.spec
            found = {"max_depth": s.max_depth, "learning_rate": s.learning_rate, "min_rows": s.min_rows, "n_trees": len(m.fitted.trees)}
        elif isinstance(m.fitted, LogitFit):
            found = {"C": m.fitted.spec.c}
        else:
            found = {}
        rows += [(c, name, k, float(v)) for k, v in found.items()]
    return spark.createDataFrame(rows, "cutoff int, rung string, parameter string, fitted double")


def hyperparameter_guard(fitted: DataFrame, frozen: DataFrame) -> DataFrame:
    """Fitted beside frozen parameters with a match flag; a parameter on one side only is a mismatch."""
    both = fitted.join(frozen, ["cutoff", "rung", "parameter"], "full")
    return both.withColumn("matches", F.coalesce(F.abs(F.col("fitted") - F.col("frozen")) < 1e-12, F.lit(False)))


def require_frozen(checked: DataFrame) -> None:
    wrong = checked.where(~F.col("matches"))
    bad = wrong.limit(20).collect()
    if bad:
        raise ValueError(f"fitted models differ from the frozen policy in {wrong.count()} parameters, among them {bad}")


def seed_stability(costs: DataFrame) -> DataFrame:
    """Ranking of rungs by cost per cutoff and seed and whether all seeds agree. Input (seed, cutoff, rung, expected_cost)."""
    ranking = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.round("expected_cost", 12).alias("c"), "rung"))), lambda s: s["rung"]), " < "
    )
    per_seed = costs.groupBy("seed", "cutoff").agg(ranking.alias("ranking"))
    every = Window.partitionBy("cutoff")
    return per_seed.withColumn("stable", F.min("ranking").over(every) == F.max("ranking").over(every))
