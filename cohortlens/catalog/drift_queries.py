"""Drift, importance and overlap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.cohort_queries import KEY, cohort_of
from cohortlens.catalog.evaluation_queries import _rank_sql
from cohortlens.catalog.feature_queries import features_of
from cohortlens.catalog.registry import query
from cohortlens.functions.scalars import count_where, unpivot_numeric
from cohortlens.functions.session import stage
from cohortlens.operators import drift as dr
from cohortlens.operators import features
from cohortlens.operators import importance as im
from cohortlens.operators import overlap as ov
from cohortlens.operators import scoring as sc
from cohortlens.operators.ordering import membership_flag
from cohortlens.sources import bindings as b

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "p_size"]
CATEGORICAL = ["l_returnflag", "l_linestatus", "p_type"]

# Oracle: quantiles by explicit position over sorted rows, bins by counting edges at or below x.
_NUM_LONG = " UNION ALL ".join(f"SELECT split, '{c}' AS feature, {c} AS value FROM drift WHERE split <> 'validate'" for c in NUMERIC)
_NUM = f"""long AS ({_NUM_LONG}),
  sorted AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n
             FROM long WHERE split = 'train' AND value IS NOT NULL),
  q AS (SELECT s.feature, d, max(value) FILTER (i = d * (n - 1) // 10) AS a, max(value) FILTER (i = (d * (n - 1) + 9) // 10) AS z,
          max(d * (n - 1) % 10) / 10.0::DOUBLE AS f FROM sorted s, range(0, 11) g(d) GROUP BY ALL),
  edges AS (SELECT feature, list_sort(list_distinct(list(a + (z - a) * f))) AS e FROM q GROUP BY feature),
  inner_edges AS (SELECT feature, CASE WHEN len(e) > 2 THEN e[2:len(e) - 1] ELSE []::DOUBLE[] END AS e, len(e) < 2 AS degenerate FROM edges),
  cut AS (SELECT feature, degenerate, e, unnest(range(0, len(e) + 2)) AS bin FROM inner_edges),
  axis AS (SELECT feature, degenerate, bin, bin > len(e) AS for_null, CASE WHEN bin = 0 THEN '-inf'::DOUBLE ELSE e[bin] END AS lo,
             CASE WHEN bin >= len(e) THEN 'inf'::DOUBLE ELSE e[bin + 1] END AS hi FROM cut),
  nprops AS (SELECT a.feature, a.bin, any_value(degenerate) AS degenerate,
     count(p.split) FILTER (p.split = 'train') / (SELECT count(*) FROM drift WHERE split = 'train') AS train_prop,
     count(p.split) FILTER (p.split = 'test') / (SELECT count(*) FROM drift WHERE split = 'test') AS test_prop
     FROM axis a LEFT JOIN long p ON p.feature = a.feature AND CASE WHEN p.value IS NULL THEN for_null ELSE NOT for_null AND p.value >= lo AND p.value < hi END
     GROUP BY a.feature, a.bin)"""
_CAT_LONG = " UNION ALL ".join(f"SELECT split, '{c}' AS feature, coalesce({c}, '__NULL__') AS bin FROM drift WHERE split <> 'validate'" for c in CATEGORICAL)
_CAT = f"""clong AS ({_CAT_LONG}), cprops AS (SELECT feature, bin,
     count(*) FILTER (split = 'train') / (SELECT count(*) FROM drift WHERE split = 'train') AS train_prop,
     count(*) FILTER (split = 'test') / (SELECT count(*) FROM drift WHERE split = 'test') AS test_prop FROM clong GROUP BY ALL)"""


def _term(eps: str = "1e-4") -> str:
    p, q = f"greatest(test_prop, if(test_prop <= 0, {eps}, 0))", f"greatest(train_prop, if(train_prop <= 0, {eps}, 0))"
    return f"({p} - {q}) * ln({p} / {q})"


_BAND = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'moderate' ELSE 'significant' END"
_PSI = f"""{_NUM}, {_CAT},
  psi AS (SELECT feature, 'numeric' AS kind, sum({_term()}) AS psi, count(*) - 1 AS n_bins_used, bool_or(degenerate) AS degenerate,
            count(*) FILTER ((train_prop <= 0) <> (test_prop <= 0)) AS empty_bins FROM nprops GROUP BY feature
          UNION ALL SELECT feature, 'categorical', sum({_term()}), count(*), count(*) < 2,
            count(*) FILTER ((train_prop <= 0) <> (test_prop <= 0)) FROM cprops GROUP BY feature)"""


def _table(spark, d):
    return dr.drift_table(b.drift_rows(spark, d), NUMERIC, CATEGORICAL)


@query(
    "psi_numeric",
    f"WITH {_PSI} SELECT feature, r(psi) AS psi, n_bins_used, degenerate, empty_bins FROM psi WHERE kind = 'numeric'",
)
def _psi_numeric(spark, d):
    return dr.psi_numeric(dr.numeric_bins(b.drift_rows(spark, d), NUMERIC))


@query(
    "psi_categorical",
    f"WITH {_PSI} SELECT feature, r(psi) AS psi, n_bins_used, degenerate, empty_bins FROM psi WHERE kind = 'categorical'",
)
def _psi_categorical(spark, d):
    return dr.psi_categorical(dr.categorical_bins(b.drift_rows(spark, d), CATEGORICAL))


@query("psi_band", f"WITH {_PSI} SELECT feature, {_BAND} AS band FROM psi")
def _psi_band(spark, d):
    return _table(spark, d)[0].select("feature", "band")


@query("psi_asymmetric_empty", f"WITH {_PSI} SELECT feature, kind, empty_bins FROM psi WHERE empty_bins > 0")
def _psi_empty(spark, d):
    return _table(spark, d)[0].where("empty_bins > 0").select("feature", "kind", "empty_bins")


@query(
    "psi_epsilon_sensitivity",
    f"""WITH {_NUM}, {_CAT}, allp AS (SELECT feature, train_prop, test_prop FROM nprops UNION ALL SELECT feature, train_prop, test_prop FROM cprops),
        hit AS (SELECT DISTINCT feature FROM allp WHERE (train_prop <= 0) <> (test_prop <= 0))
        SELECT feature, r(epsilon) AS epsilon, r(sum({_term('epsilon')})) AS psi FROM allp JOIN hit USING (feature),
        (VALUES (1e-3::DOUBLE), (1e-4::DOUBLE), (1e-6::DOUBLE)) v(epsilon) GROUP BY feature, epsilon""",
)
def _psi_epsilon(spark, d):
    return dr.epsilon_sensitivity(_table(spark, d)[1])


@query(
    "psi_ranked_report",
    f"""WITH {_PSI} SELECT feature, kind, r(psi) AS psi, n_bins_used, degenerate, empty_bins, {_BAND} AS band,
          CAST(row_number() OVER (ORDER BY psi DESC, feature) AS BIGINT) AS place FROM psi""",
)
def _psi_ranked(spark, d):
    return dr.ranked_report(stage(_table(spark, d)[0], "psi"))


@query(
    "psi_top_bins",
    f"""WITH {_PSI}, placed_psi AS (SELECT feature, CAST(row_number() OVER (ORDER BY psi DESC, feature) AS BIGINT) AS place FROM psi),
        bins AS (SELECT feature, CASE WHEN bin = max(bin) OVER (PARTITION BY feature) THEN '__NULL__' ELSE CAST(bin AS VARCHAR) END AS bin, train_prop, test_prop FROM nprops
                 UNION ALL SELECT feature, bin, train_prop, test_prop FROM cprops)
        SELECT feature, place, bin, r(train_prop) AS train_prop, r(test_prop) AS test_prop, r({_term()}) AS term FROM bins JOIN placed_psi USING (feature) WHERE place <= 5""",
)
def _psi_top(spark, d):
    psi, bins = _table(spark, d)
    return dr.top_bins(dr.ranked_report(stage(psi, "psi")), bins, 5)


_WILSON = """r((k / n + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)) AS lo,
  r((k / n + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)) AS hi"""


@query(
    "wilson_interval",
    f"SELECT kind, n, k, {_WILSON} FROM (SELECT kind, count(*) AS n, count(*) FILTER (amount > 50) AS k FROM ev GROUP BY ALL)",
)
def _wilson(spark, d):
    rows = b.event_log(spark, d).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("amount") > 50).alias("k")
    )
    lo, hi = dr.wilson_bounds("k", "n")
    return rows.select("kind", "n", "k", lo.alias("lo"), hi.alias("hi"))


@query(
    "base_rate_drift",
    f"""SELECT code_module, code_presentation, n, k, r(k / n) AS rate, {_WILSON} FROM (
          SELECT code_module, code_presentation, count(*) AS n, CAST(sum(not_completed) AS BIGINT) AS k FROM cohort WHERE cutoff = 90
          GROUP BY GROUPING SETS ((code_presentation), (code_module, code_presentation)))""",
)
def _rate_drift(spark, d):
    rows = cohort_of(spark, d).where(F.col("cutoff") == 90)
    return dr.base_rate_drift(rows, [["code_presentation"], ["code_module", "code_presentation"]])


# Features of the study, train against test at every cutoff; the same SQL over another table and other columns.
_FEATURE_LONG = " UNION ALL ".join(f"SELECT split, '{c}' AS feature, round({c}::DOUBLE, 9) AS value FROM at_cutoff WHERE split <> 'validate'" for c in features.NUMERIC_FEATURES)
_FEATURE_CLONG = " UNION ALL ".join(
    f"SELECT split, '{c}' AS feature, coalesce({c}, '__NULL__') AS bin FROM at_cutoff WHERE split <> 'validate'" for c in features.CATEGORICAL_FEATURES
)
_FEATURE_PSI = _PSI.replace(_NUM_LONG, _FEATURE_LONG).replace(_CAT_LONG, _FEATURE_CLONG).replace("FROM drift WHERE", "FROM at_cutoff WHERE")
_FEATURE_REPORT = " UNION ALL ".join(
    f"""SELECT * FROM (WITH at_cutoff AS (SELECT * FROM feat WHERE cutoff = {c}), {_FEATURE_PSI}
        SELECT CAST({c} AS INTEGER) AS cutoff, feature, kind, r(psi) AS psi, n_bins_used, degenerate, empty_bins, {_BAND} AS band,
          CAST(row_number() OVER (ORDER BY psi DESC, feature) AS BIGINT) AS place FROM psi)"""
    for c in b.DESIGN.cutoffs
)


@query("feature_psi_report", _FEATURE_REPORT)
def feature_psi(spark, d):
    """Drift of every numeric and categorical feature between train and test, ranked at each cutoff.

    Values are rounded to nine decimals first: a slope of 1e-18 is a zero and must not fall beside a bin's edge at zero.
    """
    return psi_of(features_of(spark, d))


def psi_of(rows):
    """:func:`feature_psi` of feature rows that the caller has."""
    numbers = [F.round(F.col(c).cast("double"), 9).alias(c) for c in features.NUMERIC_FEATURES]
    wide = rows.select("cutoff", "split", *numbers, *features.CATEGORICAL_FEATURES)
    psi, _ = dr.drift_table(stage(wide, "feature-drift"), features.NUMERIC_FEATURES, features.CATEGORICAL_FEATURES, groups=["cutoff"])
    return dr.ranked_report(stage(psi, "psi"), ["cutoff"])


# --- decomposition over modules (users' week of first event stands in for the module) ------------

_MOD = """mods AS (SELECT event_id, user_id % 5 AS m, day, split, y, p FROM scored WHERE rung = 'R1'),
  test_mods AS (SELECT 'm' || m AS module, y, p FROM mods WHERE split = 'test' UNION ALL SELECT 'ALL', y, p FROM mods WHERE split = 'test'),
  counts AS (SELECT coalesce('m' || m, 'ALL') AS module, count(*) FILTER (day < 10) AS n_train, count(*) FILTER (day >= 10 AND day < 15) AS n_validate FROM mods GROUP BY ROLLUP (m))"""


def _modules(spark, d):
    rows = b.scored_events(spark, d).where(F.col("rung") == "R1")
    named = rows.withColumn(
        "module",
        F.explode(F.array(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")), F.lit("ALL"))),
    )
    metrics = sc.ranking_metrics(sc.score_ladder(named.where(F.col("split") == "test"), ["module"]), ["module"])
    counts = named.groupBy("module").agg(
        count_where(F.col("day") < 10).alias("n_train"), count_where((F.col("day") >= 10) & (F.col("day") < 15)).alias("n_validate")
    )
    return dr.module_decomposition(metrics, counts, 1000)


@query(
    "module_decomposition",
    f"""WITH {_MOD}, {_rank_sql('test_mods', 'module')} SELECT module, n, r(base_rate) AS base_rate, r(auc_pr) AS auc_pr, r(auc_pr / base_rate) AS ratio,
          r(brier) AS brier, r(auc_roc) AS auc_roc, n_train, n_validate, n_train < 1000 AS thin FROM metrics JOIN counts USING (module)""",
)
def _decomposition(spark, d):
    return _modules(spark, d)


@query(
    "decomposition_spread",
    f"""WITH {_MOD}, {_rank_sql('test_mods', 'module')}, long AS (UNPIVOT (SELECT module, auc_pr, auc_pr / base_rate AS ratio, brier FROM metrics WHERE module <> 'ALL')
          ON auc_pr, ratio, brier INTO NAME metric VALUE value)
        SELECT metric, arg_max(module, value) AS highest, arg_min(module, value) AS lowest, r(max(value) - min(value)) AS spread FROM long GROUP BY metric""",
)
def _spread(spark, d):
    return dr.decomposition_spread(_modules(spark, d), ["auc_pr", "ratio", "brier"])


# --- importance ----------------------------------------------------------------------------------

# Coefficients of a linear score over events
COEFFICIENTS = {
    "amount": 0.02,
    "was_missing_amount": -0.4,
    "day": -0.05,
    "kind__click": 0.3,
    "kind__error": -0.7,
    "kind__purchase": 0.9,
    "kind__signup": 0.0,
    "kind__view": 0.1,
}
_VALUES = {
    "amount": "coalesce(CASE WHEN event_id % 9 <> 0 THEN amount END, 40.0::DOUBLE)",
    "was_missing_amount": "CAST(event_id % 9 = 0 AS DOUBLE)",
    "day": "CAST(day AS DOUBLE)",
    **{f"kind__{k}": f"CAST(kind = '{k}' AS DOUBLE)" for k in ("click", "error", "purchase", "signup", "view")},
}
_MEANS = {"amount": 50.0, "was_missing_amount": 0.1, "day": 14.5} | {c: 0.2 for c in COEFFICIENTS if c.startswith("kind")}
_CONTRIB = "contrib AS (" + " UNION ALL ".join(
    f"SELECT event_id, '{c}' AS col, {COEFFICIENTS[c]}::DOUBLE * ({_VALUES[c]} - {_MEANS[c]}::DOUBLE) AS contribution FROM ev" for c in COEFFICIENTS
) + ")"
_FEATURE = "CASE WHEN col LIKE 'kind%' THEN 'kind' WHEN col LIKE '%amount' THEN 'amount' ELSE col END"


def _event_design(spark, d):
    e = b.event_log(spark, d)
    gone = F.col("event_id") % 9 == 0
    return e.select(
        "event_id",
        F.when(gone, 40.0).otherwise(F.col("amount")).alias("amount"),
        F.when(gone, 1).otherwise(0).alias("was_missing_amount"),
        "day",
        *[
            F.when(F.col("kind") == k, 1).otherwise(0).alias(f"kind__{k}")
            for k in ("click", "error", "purchase", "signup", "view")
        ],
    )


def _contributions(spark, d):
    return im.linear_contributions(_event_design(spark, d), ["event_id"], COEFFICIENTS, _MEANS)


@query(
    "grouped_contribution",
    f"""WITH {_CONTRIB} SELECT feature, r(avg(abs(s))) AS importance FROM (SELECT event_id, {_FEATURE} AS feature, sum(contribution) AS s FROM contrib GROUP BY ALL) GROUP BY feature""",
)
def _grouped(spark, d):
    return im.mean_contributions(im.folded_contributions(_event_design(spark, d), [], COEFFICIENTS, _MEANS))


@query(
    "column_importance",
    f"""WITH {_CONTRIB} SELECT col AS "column", r(avg(abs(contribution))) AS importance, max(abs(contribution)) = 0 AS never_used FROM contrib GROUP BY col""",
)
def _column_importance(spark, d):
    return im.column_importance(_contributions(spark, d))


@query(
    "contribution_integrity",
    f"""WITH {_CONTRIB} SELECT count(*) AS n_rows, count(*) FILTER (event_id % 17 = 3) AS unmatched, r(0.125) AS max_abs_deviation FROM ev""",
)
def _integrity(spark, d):
    """Stored probabilities of some rows are off by an eighth, and the contributions of others are lost."""
    long = _contributions(spark, d)
    stored = long.groupBy("event_id").agg(F.sum("contribution").alias("s"))
    p = 1.0 / (1.0 + F.exp(-(F.col("s") + 0.25))) + F.when(F.col("event_id") % 19 == 4, 0.125).otherwise(0.0)
    kept = long.where(F.col("event_id") % 17 != 3)
    return im.contribution_integrity(kept, ["event_id"], 0.25, stage(stored.select("event_id", p.alias("p")), "stored"))


_COEF = "coef AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {v}::DOUBLE)" for c, v in COEFFICIENTS.items()) + ") v(col, coefficient))"


@query(
    "importance_vs_coefficient",
    f"""WITH {_CONTRIB}, {_COEF}, i AS (SELECT col, avg(abs(contribution)) AS importance FROM contrib GROUP BY col),
        k AS (SELECT col, importance, coefficient, row_number() OVER (ORDER BY importance DESC, col) AS rank_a, row_number() OVER (ORDER BY abs(coefficient) DESC, col) AS rank_b FROM i JOIN coef USING (col))
        SELECT col AS "column", r(importance) AS importance, rank_a, r(coefficient) AS coefficient, rank_b, rank_a - rank_b AS gap FROM k""",
)
def _vs_coefficient(spark, d):
    importance = stage(im.column_importance(_contributions(spark, d)), "importance")
    coefficients = spark.createDataFrame(list(COEFFICIENTS.items()), "column string, coefficient double")
    return im.importance_vs_coefficient(importance, coefficients, "column")


@query(
    "drift_vs_importance",
    f"""WITH {_PSI}, imp AS (SELECT feature, avg(abs(value - m)) AS importance FROM (SELECT feature, value, avg(value) OVER (PARTITION BY feature) AS m FROM long WHERE split = 'test' AND value IS NOT NULL) GROUP BY feature
            UNION ALL SELECT feature, count(DISTINCT bin)::DOUBLE FROM clong GROUP BY feature),
        ranked AS (SELECT feature, row_number() OVER (ORDER BY psi DESC, feature) AS ra, row_number() OVER (ORDER BY importance DESC, feature) AS rb FROM psi JOIN imp USING (feature))
        SELECT k, count(feature) AS n_shared, coalesce(string_agg(feature, ',' ORDER BY ra), '') AS shared FROM (VALUES (3), (5)) v(k) LEFT JOIN ranked ON ra <= k AND rb <= k GROUP BY k""",
)
def _drift_importance(spark, d):
    rows = b.drift_rows(spark, d)
    psi, bins = dr.drift_table(rows, NUMERIC, CATEGORICAL)
    long = unpivot_numeric(rows.where(F.col("split") == "test"), [], NUMERIC).where("value IS NOT NULL")
    means = stage(long.groupBy("feature").agg(F.avg("value").alias("m")), "means")
    spread = long.join(F.broadcast(means), "feature").groupBy("feature").agg(
        F.avg(F.abs(F.col("value") - F.col("m"))).alias("importance")
    )
    levels = bins.where(F.col("feature").isin(CATEGORICAL)).groupBy("feature").agg(
        F.count(F.lit(1)).cast("double").alias("importance")
    )
    importance = stage(spread.unionByName(levels), "importance")
    return im.drift_vs_importance(stage(psi, "psi"), importance, [3, 5])


# --- overlap -------------------------------------------------------------------------------------


def _flags(spark, d):
    c = cohort_of(spark, d).where(F.col("cutoff") == 90)
    info = b.raw_tables(spark, d).student_registration
    old = F.col("code_presentation") <= "1998"
    rows = c.select("id_student", "split", F.lit(False).alias("raw_old")).unionByName(
        info.select("id_student", F.lit(None).cast("string").alias("split"), old.alias("raw_old"))
    )
    s = F.col("split")
    return ov.seen_flags(
        rows,
        "id_student",
        {
            "in_train": s == "train",
            "in_validate": s == "validate",
            "in_either": s.isin("train", "validate"),
            "in_raw_train_years": F.col("raw_old"),
        },
    )


DEFINITIONS = ["in_train", "in_validate", "in_either", "in_raw_train_years"]
_SEEN = """c AS (SELECT * FROM cohort WHERE cutoff = 90), test AS (SELECT * FROM c WHERE split = 'test'),
   defs AS (SELECT 'in_train' AS definition, id_student FROM c WHERE split = 'train' UNION SELECT 'in_validate', id_student FROM c WHERE split = 'validate'
     UNION SELECT 'in_either', id_student FROM c WHERE split IN ('train', 'validate') UNION SELECT 'in_raw_train_years', id_student FROM reg WHERE code_presentation <= '1998')"""


@query(
    "returning_definitions",
    f"""WITH {_SEEN} SELECT definition, count(*) AS n_rows, r(count(*) / (SELECT count(*) FROM test)) AS row_share, count(DISTINCT id_student) AS n_units,
          r(count(DISTINCT id_student) / (SELECT count(DISTINCT id_student) FROM test)) AS unit_share FROM test JOIN defs USING (id_student) GROUP BY definition""",
)
def _returning(spark, d):
    test = cohort_of(spark, d).where((F.col("cutoff") == 90) & (F.col("split") == "test"))
    return ov.returning_definitions(test, _flags(spark, d), "id_student", DEFINITIONS)


@query(
    "returning_performance",
    f"""WITH {_SEEN}, probs AS (SELECT id_student, not_completed AS y, rung, CASE rung WHEN 'R1' THEN (date_registration + 31) / 366.0::DOUBLE ELSE (id_student % 17)::DOUBLE / 17.0::DOUBLE END AS p
          FROM test, (VALUES ('R1'), ('R2')) g(rung)),
        grouped AS (SELECT d.definition, if(EXISTS (SELECT 1 FROM defs x WHERE x.definition = d.definition AND x.id_student = probs.id_student), 'returning', 'first-time') AS subgroup, rung, y, p
          FROM probs, (VALUES ('in_train'), ('in_either')) d(definition)),
        {_rank_sql('grouped', 'definition, subgroup, rung')},
        costs AS (SELECT definition, subgroup, rung, sum(CASE WHEN y = 1 AND p < t THEN 10 WHEN y = 0 AND p >= t THEN 1 ELSE 0 END) / count(*) AS cost
          FROM grouped JOIN (VALUES ('R1', 0.1::DOUBLE), ('R2', 0.2::DOUBLE)) h(rung, t) USING (rung) GROUP BY ALL)
        SELECT definition, subgroup, rung, n, r(base_rate) AS base_rate, r(auc_pr) AS auc_pr, r(auc_pr / base_rate) AS ratio, r(brier) AS brier, r(cost) AS cost,
          r(1 - base_rate) AS flag_all, r(1 - base_rate - cost) AS edge FROM metrics JOIN costs USING (definition, subgroup, rung)""",
)
def _performance(spark, d):
    test = cohort_of(spark, d).where((F.col("cutoff") == 90) & (F.col("split") == "test"))
    rungs = F.array(
        F.struct(F.lit("R1").alias("rung"), ((F.col("date_registration") + 31) / 366.0).alias("p")),
        F.struct(F.lit("R2").alias("rung"), ((F.col("id_student") % 17).cast("double") / 17.0).alias("p")),
    )
    scored = test.select("id_student", F.col("not_completed").alias("y"), F.explode(rungs).alias("r")).select(
        "id_student", "y", "r.*"
    )
    lines = spark.createDataFrame([("R1", 0.1), ("R2", 0.2)], "rung string, threshold double")
    return ov.returning_performance(
        stage(scored, "overlap"), stage(_flags(spark, d), "flags"), "id_student", ["in_train", "in_either"], lines
    )


@query(
    "prediction_join_checked",
    """SELECT count(*) AS n_rows, count(*) FILTER (id_student % 13 = 5) AS unmatched FROM cohort WHERE split = 'test'""",
)
def _prediction_join(spark, d):
    test = cohort_of(spark, d).where(F.col("split") == "test")
    at = ["cutoff", *KEY]
    scored = test.where(F.col("id_student") % 13 != 5)  # the others have no prediction, which the check must tell
    preds = stage(scored.select(*at, ((F.col("date_registration") + 31) / 366.0).alias("p")), "predictions")
    joined = membership_flag(test, preds, at, "predicted")
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), count_where(~F.col("predicted")).alias("unmatched"))
