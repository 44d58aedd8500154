"""Preprocessing and model ladder queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.catalog.cohort_queries import KEY, cohort_of
from cohortlens.catalog.drift_queries import psi_of
from cohortlens.catalog.feature_queries import features_of
from cohortlens.catalog.registry import query
from cohortlens.functions.session import stage
from cohortlens.operators import bootstrap as bs
from cohortlens.operators import importance as im
from cohortlens.operators import overlap as ov
from cohortlens.operators import scoring as sc
from cohortlens.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from cohortlens.operators.prep import fit_design, numeric_stats
from cohortlens.operators.sparse_design import fit_sparse_design
from cohortlens.plans import holdout as ho
from cohortlens.plans import ladder as ld
from cohortlens.sources import bindings as b

LABEL = "not_completed"

_SPLIT_SUB = """fit_rows AS (SELECT score, date_submitted::DOUBLE AS date_submitted FROM sub WHERE date_submitted < 180),
   new_rows AS (SELECT id_assessment, id_student, score, date_submitted::DOUBLE AS date_submitted FROM sub WHERE date_submitted >= 180),
   med AS (SELECT median(score) AS ms, median(date_submitted) AS md FROM fit_rows),
   st AS (SELECT ms, md, avg(coalesce(score, ms)) AS a, stddev_pop(coalesce(score, ms)) AS s, avg(date_submitted) AS ad, stddev_pop(date_submitted) AS sd FROM fit_rows, med GROUP BY ALL)"""


def _submissions(spark, d) -> tuple[DataFrame, DataFrame]:
    s = b.typed_tables(spark, d).submissions
    return s.where(F.col("date_submitted") < 180), s.where(F.col("date_submitted") >= 180)


@query(
    "median_impute_scale",
    f"""WITH {_SPLIT_SUB} SELECT id_assessment, id_student, r((coalesce(score, ms) - a) / s) AS score, r((date_submitted - ad) / sd) AS date_submitted FROM new_rows, st""",
)
def _impute(spark, d):
    fit_rows, new_rows = _submissions(spark, d)
    design = fit_design(fit_rows, ["score", "date_submitted"], [], indicators=False)
    return design.apply(new_rows, ["id_assessment", "id_student"])


@query(
    "impute_fit_stats",
    f"""WITH {_SPLIT_SUB} SELECT 'score' AS feature, (SELECT count(*) FROM fit_rows) AS n, (SELECT count(*) FROM fit_rows WHERE score IS NULL) AS n_null, r(ms) AS median, r(a) AS mean, r(s) AS std FROM st
        UNION ALL SELECT 'date_submitted', (SELECT count(*) FROM fit_rows), 0, r(md), r(ad), r(sd) FROM st""",
)
def _fit_stats(spark, d):
    return numeric_stats(_submissions(spark, d)[0], ["score", "date_submitted"])


@query(
    "missing_indicators",
    """SELECT 'was_missing_score' AS indicator, count(*) AS n_rows, count(*) FILTER (score IS NULL) AS n_missing FROM sub WHERE date_submitted >= 180""",
)
def _indicators(spark, d):
    fit_rows, new_rows = _submissions(spark, d)
    design = fit_design(fit_rows, ["score", "date_submitted"], [])
    names = [c for c in design.columns if c.startswith(im.MISSING_PREFIX)]
    out = design.apply(new_rows, []).select(*names).unpivot([], names, "indicator", "hit")
    return out.groupBy("indicator").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("hit").alias("n_missing"))


@query(
    "one_hot_fit_apply",
    """WITH long AS (SELECT code_presentation, 'imd_band' AS f, coalesce(imd_band, '__NULL__') AS v FROM info UNION ALL SELECT code_presentation, 'region', region FROM info
          UNION ALL SELECT code_presentation, 'code_presentation', code_presentation FROM info)
       SELECT f || '__' || v AS "column", (SELECT count(*) FROM long n WHERE n.f = k.f AND n.v = k.v AND n.code_presentation = '2000') AS n_ones
       FROM (SELECT DISTINCT f, v FROM long WHERE code_presentation <= '1998') k""",
)
def _one_hot(spark, d):
    info = b.typed_tables(spark, d).info
    features = ["imd_band", "region", "code_presentation"]
    design = fit_design(info.where(F.col("code_presentation") <= "1998"), [], features)
    hot = design.apply(info.where(F.col("code_presentation") == "2000"), [])
    return hot.unpivot([], design.columns, "column", "hit").groupBy("column").agg(F.sum("hit").alias("n_ones"))


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, d: str, name: str, make: Callable[[], object]):
    """What ``make`` gives, once per session and state of the input files: their names, sizes and times are part of the key."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(d)
    seen = files.select("path", "length", "modificationTime").orderBy("path")
    state = seen.agg(F.xxhash64(F.sort_array(F.collect_list(F.struct(*seen.columns))))).first()[0]
    at = (spark.sparkContext.applicationId, d, state, name)
    if at not in _KEPT:
        _KEPT[at] = make()
    return _KEPT[at]


def stored_features(spark, d) -> DataFrame:
    """Features of every cutoff as a stored table, read by every fit."""
    return kept(spark, d, "features", lambda: stage(features_of(spark, d), "features"))


def _split(spark, d, *names: str) -> DataFrame:
    return stored_features(spark, d).where(F.col("split").isin(list(names)))


def _logit_ladder(spark, d) -> tuple[ld.Ladder, ld.Prepared]:
    """Rungs B0 to B3 at every cutoff, all strengths."""

    def make():
        made = ld.prepare(_split(spark, d, "train", "validate"), "split = 'train'", LABEL, KEY)
        wanted = [(c, r, s) for c in sorted(made.encoders) for r, grid in (("B1", [1.0]), ("B2", [1.0]), ("B3", ld.C_GRID)) for s in grid]
        return ld.choose(made, ld._base_rates(made) + ld._logits(made, wanted)), made

    return kept(spark, d, "logits", make)


def ladder_of(spark, d) -> ld.Ladder:
    """The whole ladder: five rungs, five strengths, 27 boosting configurations, three cutoffs."""
    return kept(spark, d, "ladder", lambda: ld.fit_ladder(_split(spark, d, "train", "validate"), LABEL, KEY))


def refitted(spark, d) -> ld.Ladder:
    return kept(spark, d, "refit", lambda: ld.refit(ladder_of(spark, d), stored_features(spark, d), LABEL, KEY))


def predictions_of(spark, d) -> DataFrame:
    """Stored scores of the holdout: (cutoff, key.., y, split, rung, p), scored once by the refitted ladder."""
    return kept(
        spark, d, "predictions",
        lambda: stage(refitted(spark, d).score(_split(spark, d, "test"), ["cutoff", *KEY, LABEL, "split"]).withColumnRenamed(LABEL, "y"), "predictions"),
    )


def frozen_thresholds(spark, d) -> DataFrame:
    return ladder_of(spark, d).policy(spark).select("cutoff", "rung", "threshold")


_TEXT = ", ".join(f"coalesce({c}, '__NULL__') AS {c}" for c in CATEGORICAL_FEATURES if c != "code_module")
_DESIGN = f"""nums AS (SELECT * FROM (SELECT cutoff, split, code_module, code_presentation, id_student, not_completed AS y,
       {', '.join(f'{c}::DOUBLE AS {c}' for c in NUMERIC_FEATURES)} FROM feat) UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(NUMERIC_FEATURES)}))),
   med AS (SELECT cutoff, feature, median(v) AS m, count(*) FILTER (v IS NULL) AS n_null FROM nums WHERE split = 'train' GROUP BY ALL),
   st AS (SELECT cutoff, feature, m, n_null, avg(coalesce(v, m)) AS a, stddev_pop(coalesce(v, m)) AS s
          FROM nums JOIN med USING (cutoff, feature) WHERE split = 'train' GROUP BY ALL),
   z AS MATERIALIZED (SELECT cutoff, split, code_module, code_presentation, id_student, y, feature, (coalesce(v, m) - a) / CASE WHEN s > 0 THEN s ELSE 1 END AS z,
          CAST(n_null > 0 AND v IS NULL AS INTEGER) AS missing FROM nums JOIN st USING (cutoff, feature)),
   cats AS (UNPIVOT (SELECT cutoff, split, code_module AS m, code_presentation, id_student, {_TEXT}, code_module FROM feat)
          ON {', '.join(CATEGORICAL_FEATURES)} INTO NAME feature VALUE level),
   levels AS (SELECT DISTINCT cutoff, feature, level FROM cats WHERE split = 'train')"""


@query(
    "design_matrix",
    f"""WITH {_DESIGN},
       width AS (SELECT cutoff, {len(NUMERIC_FEATURES)} + count(*) FILTER (n_null > 0) + (SELECT count(*) FROM levels l WHERE l.cutoff = st.cutoff) AS n FROM st GROUP BY cutoff),
       plain AS (SELECT cutoff, code_module, code_presentation, id_student, sum(z * z) + sum(missing) AS s FROM z WHERE split = 'validate' GROUP BY ALL),
       hot AS (SELECT cutoff, m AS code_module, code_presentation, id_student, count(*) AS h FROM cats SEMI JOIN levels USING (cutoff, feature, level) WHERE split = 'validate' GROUP BY ALL)
       SELECT cutoff, code_module, code_presentation, id_student, CAST(n AS INTEGER) AS n_columns, r(s + coalesce(h, 0)) AS squared_norm
       FROM plain JOIN width USING (cutoff) LEFT JOIN hot USING (cutoff, code_module, code_presentation, id_student)""",
)
def _design(spark, d):
    encoders = ld.fit_encoders(_split(spark, d, "train"))
    rows = ld.encode(_split(spark, d, "validate"), encoders, ["cutoff", *KEY])
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return rows.select("cutoff", *KEY, F.size("x").alias("n_columns"), norm.alias("squared_norm"))


_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]
_LINES = """lines AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN l_tax <> 0.05 THEN l_discount END AS l_discount,
        CASE WHEN l_tax <> 0.02 THEN l_returnflag END AS l_returnflag, month(l_shipdate) <= 9 AS fitted FROM lineitem),
      med AS (SELECT median(l_quantity) AS mq, median(l_discount) AS md FROM lines WHERE fitted),
      st AS (SELECT mq, md, avg(l_quantity) AS aq, stddev_pop(l_quantity) AS sq, avg(coalesce(l_discount, md)) AS ad, stddev_pop(coalesce(l_discount, md)) AS sd
             FROM lines, med WHERE fitted GROUP BY ALL)"""


def _lines(spark, d) -> DataFrame:
    li = b.table(spark, d, "lineitem")
    return stage(
        li.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            F.when(F.col("l_tax") != 0.05, F.col("l_discount")).alias("l_discount"),
            F.when(F.col("l_tax") != 0.02, F.col("l_returnflag")).alias("l_returnflag"),
            (F.month("l_shipdate") <= 9).alias("fitted"),
        ),
        "lines",
    )


@query(
    "sparse_design_matrix",
    f"""WITH {_LINES}, width AS (SELECT 3 + {" + ".join(f"count(DISTINCT coalesce(CAST({c} AS VARCHAR), '__NULL__'))" for c in _IDS)} AS n FROM lines WHERE fitted),
        {", ".join(f"known{i} AS (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), '__NULL__') AS v{i} FROM lines WHERE fitted)" for i, c in enumerate(_IDS))},
        hot AS (SELECT lines.*, {" + ".join(f"CAST(v{i} IS NOT NULL AS BIGINT)" for i in range(len(_IDS)))} AS h FROM lines
                {" ".join(f"LEFT JOIN known{i} ON v{i} = coalesce(CAST({c} AS VARCHAR), '__NULL__')" for i, c in enumerate(_IDS))} WHERE NOT fitted)
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, n AS n_columns, h AS n_levels,
          r(pow((l_quantity - aq) / sq, 2) + pow((coalesce(l_discount, md) - ad) / sd, 2) + CAST(l_discount IS NULL AS INTEGER) + h) AS squared_norm
        FROM hot, st, width""",
)
def _sparse(spark, d):
    lines = _lines(spark, d)
    design = fit_sparse_design(lines.where("fitted"), ["l_quantity", "l_discount"], _IDS)
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = design.apply(lines.where("not fitted"), key)
    norm = F.aggregate("features.values", F.lit(0.0), lambda a, v: a + v * v)
    levels = F.size(F.filter("features.indices", lambda i: i >= design.n_dense)).cast("long")
    return rows.select(*key, F.col("features.size").alias("n_columns"), levels.alias("n_levels"), norm.alias("squared_norm"))


@query(
    "rung_base_rate",
    """SELECT cutoff, code_module, code_presentation, id_student, 'B0' AS rung, r(p) AS p
       FROM cohort JOIN (SELECT cutoff, avg(not_completed) AS p FROM cohort WHERE split = 'train' GROUP BY cutoff) USING (cutoff) WHERE split = 'validate'""",
)
def _b0(spark, d):
    c = stage(cohort_of(spark, d), "cohort")
    rate = ld.fit_base_rate(c.where(F.col("split") == "train"), LABEL)
    return c.where(F.col("split") == "validate").join(F.broadcast(rate), "cutoff").select("cutoff", *KEY, F.lit("B0").alias("rung"), "p")


def _rung_scores(spark, d, rung: str) -> DataFrame:
    ladder, _ = _logit_ladder(spark, d)
    some = ld.Ladder(ladder.encoders, {k: m for k, m in ladder.models.items() if k[1] == rung}, {}, {}, [])
    return some.score(_split(spark, d, "validate"), ["cutoff", *KEY, LABEL]).withColumnRenamed(LABEL, "y")


@query(
    "rung_logistic_single",
    f"""WITH RECURSIVE {_DESIGN}, pts AS MATERIALIZED (SELECT * FROM z WHERE feature = 'days_since_last_activity'),
       it AS (SELECT 0 AS step, cutoff, 0::DOUBLE AS b0, 0::DOUBLE AS b1 FROM (SELECT DISTINCT cutoff FROM pts)
         UNION ALL SELECT step + 1, cutoff, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
         FROM (SELECT step, cutoff, b0, b1, sum(p - y) AS g0, sum((p - y) * z) + b1 AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * z) AS h01, sum(p * (1 - p) * z * z) + 1 AS h11
               FROM (SELECT it.*, z, y, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM it JOIN pts ON pts.cutoff = it.cutoff WHERE split = 'train' AND step < 15)
               GROUP BY step, cutoff, b0, b1))
       SELECT p.cutoff, code_module, code_presentation, id_student, y, 'B1' AS rung, r(1 / (1 + exp(-(b0 + b1 * z)))) AS p
       FROM pts p JOIN it ON it.cutoff = p.cutoff AND step = 15 WHERE split = 'validate'""",
)
def _b1(spark, d):
    return _rung_scores(spark, d, "B1")


@query("rung_logistic_group")
def _b2(spark, d):
    return _rung_scores(spark, d, "B2")


@query(
    "logistic_score_equations",
    f"""WITH {_DESIGN}, names AS (SELECT cutoff, feature, feature AS col FROM st UNION ALL SELECT cutoff, feature, 'was_missing_' || feature FROM st WHERE n_null > 0
         UNION ALL SELECT cutoff, feature, feature || '__' || level FROM levels),
       wanted AS (SELECT 'B1' AS rung, 1.0::DOUBLE AS c UNION ALL SELECT 'B2', 1.0 UNION ALL SELECT 'B3', unnest([0.001, 0.01, 0.1, 1.0, 10.0]))
       SELECT cutoff, rung, c, col AS "column", 0::DOUBLE AS residual FROM names, wanted
       WHERE rung = 'B3' OR (rung = 'B1' AND col = 'days_since_last_activity')
          OR (rung = 'B2' AND feature IN ({', '.join(repr(f) for f in ld.B2_NUMERIC + ld.B2_CATEGORICAL)}))
       UNION ALL SELECT cutoff, rung, c, '(intercept)', 0 FROM (SELECT DISTINCT cutoff FROM st), wanted""",
)
def _equations(spark, d):
    """What the score equations of all logistic fits leave; nothing, to six digits."""
    ladder, made = _logit_ladder(spark, d)
    return ld.score_equations(made, [m for m, _ in ladder.trials])


def _trials(spark, ladder: ld.Ladder, rung: str) -> DataFrame:
    chosen = {id(m) for m in ladder.models.values()}
    rows = [
        (i, m.cutoff, m.rung, {k: float(v) for k, v in m.params.items()}, float(c), id(m) in chosen)
        for i, (m, c) in enumerate((m, c) for m, c in ladder.trials if m.rung == rung)
    ]
    schema = "trial int, cutoff int, rung string, params map<string,double>, validate_cost double, chosen boolean"
    return spark.createDataFrame(rows, schema).withColumn("params", F.to_json("params"))


@query("rung_logistic_full")
def _b3(spark, d):
    return _trials(spark, _logit_ladder(spark, d)[0], "B3")


@query("ladder_top_coefficients")
def _top_coefficients(spark, d):
    """The 15 largest coefficients of the full logistic rung at each cutoff."""
    return ld.top_coefficients(ld.coefficients(_logit_ladder(spark, d)[0], spark))


@query("rung_boosted_trees")
def _m1(spark, d):
    return _trials(spark, ladder_of(spark, d), "M1")


@query("ladder_refit")
def _refit(spark, d):
    """Holdout metrics of the refitted rungs and their costs at the frozen thresholds."""
    scored = predictions_of(spark, d)
    metrics = sc.ranking_metrics(sc.score_ladder(scored, ["cutoff", "rung"]), ["cutoff", "rung"])
    return metrics.join(ld.at_thresholds(scored, ladder_of(spark, d).thresholds), ["cutoff", "rung"])


@query("seed_stability")
def _seeds(spark, d):
    return ld.seed_stability(ld.refit_at_seeds(ladder_of(spark, d), _split(spark, d, "train", "validate"), LABEL, KEY))


@query("hyperparameter_guard")
def _guard(spark, d):
    frozen = ladder_of(spark, d).policy(spark).select("cutoff", "rung", F.explode("params").alias("parameter", "frozen"))
    return ld.hyperparameter_guard(ld.fitted_params(refitted(spark, d), spark), frozen)


@query("score_holdout")
def _holdout(spark, d):
    return predictions_of(spark, d).groupBy("cutoff", *KEY, "y").agg(
        *[F.max(F.when(F.col("rung") == r, F.col("p"))).alias(f"prob_{r}") for r in ld.RUNGS]
    )


@query("holdout_intervals")
def _holdout_intervals(spark, d):
    """Intervals of all seven metrics of every rung and cutoff on the holdout, at the frozen thresholds."""
    by = ["cutoff", "rung"]
    rows = stage(predictions_of(spark, d).join(F.broadcast(frozen_thresholds(spark, d)), by), "holdout")
    return bs.intervals(stage(bs.bootstrap_metrics(rows, by, "p", "threshold"), "resampled"), by)


def _with_features(spark, d, rung: str) -> DataFrame:
    """Stored scores of a rung beside the features of their rows; a score without a row is an error."""
    scored = predictions_of(spark, d).where(F.col("rung") == rung).select("cutoff", *KEY, "y", "rung", "p")
    test = _split(spark, d, "test").drop(LABEL)
    lost = scored.join(test.select("cutoff", *KEY), ["cutoff", *KEY], "left_anti").count()
    if lost:
        raise ValueError(f"{lost} stored scores have no feature row")
    return test.join(scored, ["cutoff", *KEY])


@query("holdout_slices")
def _holdout_slices(spark, d):
    """Slice metrics of the boosted rung on stored scores, at its frozen threshold, for every cutoff."""
    at = {c: t for (c, r), t in ladder_of(spark, d).thresholds.items() if r == "M1"}
    rows = stage(_with_features(spark, d, "M1"), "slices")
    out = None
    for c, t in sorted(at.items()):
        part = ho.slice_metrics(rows.where(F.col("cutoff") == c), t, ld.B2_CATEGORICAL, KEY).withColumn("cutoff", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


@query("holdout_decomposition")
def _holdout_decomposition(spark, d):
    """Ranking metrics by module of B3 and M1 on stored scores, and over all modules."""
    scored = predictions_of(spark, d).where(F.col("rung").isin("B3", "M1"))
    named = scored.withColumn("module", F.explode(F.array("code_module", F.lit("ALL"))))
    by = ["cutoff", "rung", "module"]
    metrics = sc.ranking_metrics(sc.score_ladder(named, by), by)
    sizes = stored_features(spark, d).withColumn("module", F.explode(F.array("code_module", F.lit("ALL")))).groupBy("cutoff", "module").agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"), F.count(F.when(F.col("split") == "validate", 1)).alias("n_validate")
    )
    return metrics.join(sizes, ["cutoff", "module"]).withColumn("ratio", F.col("auc_pr") / F.col("base_rate"))


@query("holdout_subgroups")
def _holdout_subgroups(spark, d):
    """Returning against first-time units of the holdout on stored scores of every rung, by two definitions of returning."""
    cut = max(b.DESIGN.cutoffs)
    rows = stored_features(spark, d).where(F.col("cutoff") == cut)
    s = F.col("split")
    flags = ov.seen_flags(rows.select("id_student", "split"), "id_student", {"in_train": s == "train", "in_either": s.isin("train", "validate")})
    scored = predictions_of(spark, d).where(F.col("cutoff") == cut).select("id_student", "y", "rung", "p")
    lines = frozen_thresholds(spark, d).where(F.col("cutoff") == cut).select("rung", "threshold")
    return ov.returning_performance(stage(scored, "overlap"), stage(flags, "flags"), "id_student", ["in_train", "in_either"], lines)


@query("holdout_drift_vs_importance")
def _holdout_drift(spark, d):
    """Features on top by drift from train to test that are also on top by contribution to the full logistic rung."""
    importance, drift = stage(_ladder_importance(spark, d), "importance"), stage(psi_of(stored_features(spark, d)), "psi")
    out = None
    for c in b.DESIGN.cutoffs:
        psi, imp = (x.where(F.col("cutoff") == c).drop("cutoff") for x in (drift, importance))
        part = im.drift_vs_importance(psi.select("feature", "psi"), imp).withColumn("cutoff", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


@query("ladder_importance")
def _ladder_importance(spark, d):
    """Mean absolute contribution of each feature to the full logistic rung on the holdout, checked against stored scores."""
    ladder = refitted(spark, d)
    test = ld.encode(_split(spark, d, "test"), ladder.encoders, ["cutoff", *KEY])
    out = None
    for c, encoder in sorted(ladder.encoders.items()):
        fit = ladder.models[c, "B3"].fitted
        found = im.vector_contributions(test.where(F.col("cutoff") == c), "x", encoder.design.columns, fit.coefficients, fit.intercept)
        stored = predictions_of(spark, d).where((F.col("cutoff") == c) & (F.col("rung") == "B3")).select("cutoff", *KEY, F.col("p").alias("stored"))
        checked = found.join(stored, ["cutoff", *KEY], "left").agg(
            F.count(F.when(F.col("stored").isNull(), 1)).alias("unmatched"), F.max(F.abs(F.col("stored") - F.col("p"))).alias("off")
        ).first()
        if checked["unmatched"] or checked["off"] > 1e-9:
            raise ValueError(f"contributions do not rebuild the stored scores: {checked}")
        part = im.mean_contributions(found).withColumn("cutoff", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out
