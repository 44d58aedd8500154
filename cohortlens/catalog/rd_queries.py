"""Discontinuity and power queries (bindings R and T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.cohort_queries import KEY, cohort_of
from cohortlens.catalog.registry import query
from cohortlens.functions.normal import detection_multiplier
from cohortlens.operators import cohort as ch
from cohortlens.operators import discontinuity as rd
from cohortlens.sources import bindings as b

CUTOFF, BANDWIDTH = 25.0, 10.0
PLACEBOS = [15.0, 35.0]
NUMERIC, LEVELS = ["l_discount", "l_tax"], ["l_linestatus"]

# Oracle: weighted least squares over the rows themselves, residuals row by row.


def _fit_sql(rows: str, by: str = "c, h") -> str:
    """CTEs est(by, n_left, n_right, estimate, se, bias_corrected, robust_se) over rows(by, x, y)."""

    def det(*cols: str) -> str:
        a, d, g = (c.split() for c in cols)
        return (
            f"({a[0]} * ({d[1]} * {g[2]} - {d[2]} * {g[1]}) - {d[0]} * ({a[1]} * {g[2]} - {a[2]} * {g[1]})"
            f" + {g[0]} * ({a[1]} * {d[2]} - {a[2]} * {d[1]}))"
        )

    m0, m1, m2, ty = "s0 s1 s2", "s1 s2 s3", "s2 s3 s4", "t0 t1 t2"
    full = det(m0, m1, m2)
    return f"""wr AS (SELECT {by}, y, (x - c) / h AS d, 1 - abs(x - c) / h AS w, x >= c AS rt FROM {rows} WHERE abs(x - c) < h),
      sums AS (SELECT {by}, rt, count(*) AS n, sum(w) AS s0, sum(w*d) AS s1, sum(w*d*d) AS s2, sum(w*d*d*d) AS s3, sum(w*d*d*d*d) AS s4,
         sum(w*y) AS t0, sum(w*d*y) AS t1, sum(w*d*d*y) AS t2 FROM wr GROUP BY ALL),
      coefs AS (SELECT *, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS slope, (t0 - (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) * s1) / s0 AS level,
         {det(ty, m1, m2)} / {full} AS q0, {det(m0, ty, m2)} / {full} AS q1, {det(m0, m1, ty)} / {full} AS q2,
         (s2 * s4 - s3 * s3) / {full} AS i0, (s2 * s3 - s1 * s4) / {full} AS i1, (s1 * s3 - s2 * s2) / {full} AS i2 FROM sums),
      sides AS (SELECT {by}, rt, any_value(n) AS n, any_value(level) AS level, any_value(q0) AS q0,
         sum(pow(w * (s2 - s1 * d) / (s0 * s2 - s1 * s1) * (y - level - slope * d), 2)) AS v,
         sum(pow(w * (i0 + i1 * d + i2 * d * d) * (y - q0 - q1 * d - q2 * d * d), 2)) AS qv
         FROM wr JOIN coefs USING ({by}, rt) GROUP BY {by}, rt),
      est AS (SELECT {by}, l.n AS n_left, z.n AS n_right, z.level - l.level AS estimate, sqrt(z.v + l.v) AS se, z.q0 - l.q0 AS bias_corrected,
         sqrt(z.qv + l.qv) AS robust_se FROM (FROM sides WHERE NOT rt) l JOIN (FROM sides WHERE rt) z USING ({by}))"""


_H = "spec AS (SELECT c::DOUBLE AS c, h::DOUBLE AS h FROM (VALUES (25)) a(c), (VALUES (5), (8), (10), (15), (20)) g(h))"
_SPEC = f"{_H}, rows_in AS (SELECT c, h, x, y FROM rv, spec)"
_Z = "1.959963984540054::DOUBLE"


def _rows(spark, d):
    return b.running_variable(spark, d)


def _table(spark, d):
    return rd.jump_table(_rows(spark, d), "x", "y", [CUTOFF], rd.BANDWIDTHS)


@query(
    "rd_local_linear",
    f"""WITH {_H}, rows_in AS (SELECT c, h, x, y FROM rv, spec WHERE h = 10), {_fit_sql('rows_in')} SELECT r(c) AS cutoff, r(h) AS bandwidth, r(estimate) AS estimate, n_left, n_right FROM est""",
)
def _local_linear(spark, d):
    out = rd.jump_table(_rows(spark, d), "x", "y", [CUTOFF], [BANDWIDTH])
    return out.select("cutoff", "bandwidth", "estimate", "n_left", "n_right")


@query(
    "rd_bias_corrected",
    f"WITH {_SPEC}, {_fit_sql('rows_in')} SELECT r(c) AS cutoff, r(h) AS bandwidth, r(bias_corrected) AS bias_corrected FROM est",
)
def _bias(spark, d):
    return _table(spark, d).select("cutoff", "bandwidth", "bias_corrected")


@query(
    "rd_standard_errors",
    f"""WITH {_SPEC}, {_fit_sql('rows_in')} SELECT r(c) AS cutoff, r(h) AS bandwidth, n_left, n_right, r(estimate) AS estimate, r(se) AS se,
          r(bias_corrected) AS bias_corrected, r(robust_se) AS robust_se, r(bias_corrected - {_Z} * robust_se) AS ci_lo, r(bias_corrected + {_Z} * robust_se) AS ci_hi FROM est""",
)
def _errors(spark, d):
    return rd.inference(_table(spark, d)).drop("p_conventional", "p_robust")


@query("rd_p_values")
def _p_values(spark, d):
    return rd.inference(_table(spark, d)).select("cutoff", "bandwidth", "p_conventional", "p_robust")


@query(
    "rd_bandwidth_table",
    f"WITH {_SPEC}, {_fit_sql('rows_in')} SELECT r(c) AS cutoff, r(h) AS bandwidth, r(estimate) AS estimate, n_left, n_right FROM est",
)
def _bandwidths(spark, d):
    return _table(spark, d).select("cutoff", "bandwidth", "estimate", "n_left", "n_right")


@query(
    "rd_placebo",
    f"""WITH rows_in AS (SELECT c, h, x, y FROM rv, (VALUES (15::DOUBLE, 10::DOUBLE), (35::DOUBLE, 10::DOUBLE)) s(c, h)), {_fit_sql('rows_in')}
        SELECT r(c) AS cutoff, r(h) AS bandwidth, r(estimate) AS estimate, r(se) AS se, n_left, n_right FROM est""",
)
def _placebo(spark, d):
    out = rd.jump_table(_rows(spark, d), "x", "y", PLACEBOS, [BANDWIDTH])
    return out.select("cutoff", "bandwidth", "estimate", "se", "n_left", "n_right")


@query(
    "rd_donut",
    f"""WITH rows_in AS (SELECT 25::DOUBLE AS c, 10::DOUBLE AS h, x, y FROM rv WHERE abs(x - 25) > 1), {_fit_sql('rows_in')}
        SELECT r(c) AS cutoff, r(h) AS bandwidth, r(estimate) AS estimate, r(bias_corrected) AS bias_corrected, n_left, n_right,
          (SELECT count(*) FROM rv WHERE abs(x - 25) <= 1) AS rows_dropped, (SELECT count(*) FROM rv WHERE abs(x - 25) > 1) AS rows_kept FROM est""",
)
def _donut(spark, d):
    out = rd.donut_table(_rows(spark, d), "x", "y", CUTOFF, [BANDWIDTH])
    return out.select(
        "cutoff", "bandwidth", "estimate", "bias_corrected", "n_left", "n_right", "rows_dropped", "rows_kept"
    )


@query("donut_filter", "SELECT x, count(*) AS n_rows FROM rv WHERE abs(x - 25) > 1 GROUP BY x")
def _donut_filter(spark, d):
    return rd.donut(_rows(spark, d), "x", CUTOFF).groupBy("x").agg(F.count(F.lit(1)).alias("n_rows"))


_COVARIATES = """rows_in AS (SELECT 25::DOUBLE AS c, 10::DOUBLE AS h, covariate, level_name, x, y FROM (
    SELECT 'l_discount' AS covariate, '' AS level_name, x, l_discount AS y FROM rv UNION ALL SELECT 'l_tax', '', x, l_tax FROM rv
    UNION ALL SELECT 'l_linestatus', lv, x, (coalesce(l_linestatus, '__NULL__') = lv)::INT::DOUBLE FROM rv, (SELECT DISTINCT coalesce(l_linestatus, '__NULL__') AS lv FROM rv)))"""


def _balance(spark, d):
    return rd.covariate_balance(_rows(spark, d), "x", NUMERIC, LEVELS, CUTOFF, BANDWIDTH)


@query(
    "rd_covariate_balance",
    f"""WITH {_COVARIATES}, {_fit_sql('rows_in', 'c, h, covariate, level_name')} SELECT covariate, level_name, r(estimate) AS estimate, r(se) AS se,
          r(bias_corrected) AS bias_corrected, r(robust_se) AS robust_se, n_left, n_right FROM est""",
)
def _covariates(spark, d):
    return _balance(spark, d).select(
        "covariate", "level_name", "estimate", "se", "bias_corrected", "robust_se", "n_left", "n_right"
    )


@query(
    "rd_covariate_rejections",
    f"""WITH {_COVARIATES}, {_fit_sql('rows_in', 'c, h, covariate, level_name')} SELECT count(bias_corrected) AS n_tests,
          count(*) FILTER (abs(bias_corrected / robust_se) > {_Z}) AS n_rejected FROM est""",
)
def _rejections(spark, d):
    return rd.rejections(_balance(spark, d))


_DENSITY = """hist AS (SELECT ship_year, CAST(floor(x - 25) AS BIGINT) AS bin, count(*) AS n FROM rv GROUP BY ALL),
   ends AS (SELECT ship_year, count(*) AS total, CAST(floor(min(x) - 25) AS BIGINT) AS lo, CAST(ceil(max(x) - 25) AS BIGINT) - 1 AS hi FROM rv GROUP BY ALL),
   bins AS (SELECT ship_year, total, lo, hi, unnest(range(lo, hi + 1)) AS bin FROM ends),
   closed AS (SELECT ship_year, least(bin, hi) AS bin, sum(n) AS n FROM hist JOIN ends USING (ship_year) GROUP BY ALL),
   heights AS (SELECT ship_year, total, bin + 0.5::DOUBLE AS m, 1 - abs(bin + 0.5::DOUBLE) / 10 AS w, coalesce(n, 0) / total AS f FROM bins LEFT JOIN closed USING (ship_year, bin)
      WHERE abs(bin + 0.5::DOUBLE) < 10),
   fit AS (SELECT ship_year, total, m >= 0 AS rt, (sum(w*m*m) * sum(w*f) - sum(w*m) * sum(w*m*f)) / (sum(w) * sum(w*m*m) - sum(w*m) * sum(w*m)) AS level FROM heights GROUP BY ALL),
   dens AS (SELECT ship_year, total, max(level) FILTER (NOT rt) AS f_left, max(level) FILTER (rt) AS f_right FROM fit GROUP BY ALL),
   density AS (SELECT *, ln(f_right) - ln(f_left) AS theta, sqrt(4.8::DOUBLE / (total * 10) * (1 / f_right + 1 / f_left)) AS se FROM dens)"""


def _density(spark, d):
    return rd.density_test(_rows(spark, d), "x", CUTOFF, BANDWIDTH, 1.0, ["ship_year"])


@query(
    "density_test_binned",
    f"""WITH {_DENSITY} SELECT CAST(ship_year AS INTEGER) AS ship_year, total AS n, r(f_left) AS f_left, r(f_right) AS f_right, r(theta) AS theta, r(se) AS se, r(theta / se) AS z FROM density""",
)
def _density_query(spark, d):
    return _density(spark, d)


@query(
    "score_histogram",
    """SELECT v AS value, count(x) AS n FROM range(20, 31) g(v) LEFT JOIN rv ON x = v GROUP BY v""",
)
def _histogram(spark, d):
    return rd.score_histogram(_rows(spark, d), "x", 20, 30)


@query(
    "heaping_ratio",
    """WITH h AS (SELECT v AS value, count(x) AS n FROM range(20, 31) g(v) LEFT JOIN rv ON x = v GROUP BY v)
       SELECT a.value, a.n, r(avg(z.n)) AS neighbour_mean, r(a.n / avg(z.n)) AS ratio FROM h a JOIN h z ON abs(a.value - z.value) = 1 WHERE a.value % 5 = 0 GROUP BY a.value, a.n""",
)
def _heaping(spark, d):
    return rd.heaping_ratio(rd.score_histogram(_rows(spark, d), "x", 20, 30))


# --- population on the assessment tables -----------------------------------------------------------

_FIRST = """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code_module, code_presentation ORDER BY date ASC NULLS LAST, id_assessment) AS rn
   FROM ass WHERE assessment_type = 'TMA') WHERE rn = 1),
   rdpop AS (SELECT f.code_module, f.code_presentation, f.id_assessment, f.date AS due_date, s.id_student, s.score, s.date_submitted, i.final_result,
      CAST(i.final_result IN ('Fail', 'Withdrawn') AS INTEGER) AS not_completed
      FROM firsts f JOIN sub s USING (id_assessment) JOIN info i ON i.code_module = f.code_module AND i.code_presentation = f.code_presentation AND i.id_student = s.id_student
      WHERE s.score IS NOT NULL AND s.is_banked = 0)"""


def _firsts(t):
    return rd.first_assessments(t.assessments, "TMA", ch.GROUP)


def _population(spark, d):
    t = b.typed_tables(spark, d)
    return rd.rd_population(_firsts(t), t.submissions, t.info, KEY, ch.OUTCOMES[1])


@query(
    "rd_population",
    f"""WITH {_FIRST} SELECT code_module, code_presentation, id_assessment, due_date, id_student, r(score) AS score, date_submitted, final_result, not_completed FROM rdpop""",
)
def _rd_population(spark, d):
    return _population(spark, d).select(
        "code_module",
        "code_presentation",
        "id_assessment",
        "due_date",
        "id_student",
        "score",
        "date_submitted",
        "final_result",
        "not_completed",
    )


_STUDY = f"{_FIRST}, rows_in AS (SELECT c, h, score AS x, not_completed::DOUBLE AS y FROM rdpop, (VALUES {{specs}}) s(c, h))"
_STUDY_COLUMNS = """r(c) AS cutoff, r(h) AS bandwidth, n_left, n_right, r(estimate) AS estimate, r(se) AS se, r(bias_corrected) AS bias_corrected, r(robust_se) AS robust_se"""


def _study_sql(cutoffs: list[float], bandwidths: list[float]) -> str:
    specs = ", ".join(f"({c}::DOUBLE, {h}::DOUBLE)" for c in cutoffs for h in bandwidths)
    return f"WITH {_STUDY.format(specs=specs)}, {_fit_sql('rows_in')} SELECT {_STUDY_COLUMNS} FROM est"


def _study(spark, d, cutoffs: list[float], bandwidths: list[float]):
    return rd.jump_table(_population(spark, d), "score", "not_completed", cutoffs, bandwidths)


@query("rd_study_bandwidths", _study_sql([rd.PASS_MARK], rd.BANDWIDTHS[2:]))
def _study_bandwidths(spark, d):
    """Jump of the outcome at the pass mark of the first assessment."""
    return _study(spark, d, [rd.PASS_MARK], rd.BANDWIDTHS[2:])


@query("rd_study_placebo", _study_sql(rd.PLACEBO_CUTOFFS, [rd.PRIMARY_BANDWIDTH]))
def _study_placebo(spark, d):
    return _study(spark, d, rd.PLACEBO_CUTOFFS, [rd.PRIMARY_BANDWIDTH])


@query(
    "rd_study_donut",
    f"""WITH {_FIRST}, rows_in AS (SELECT 40::DOUBLE AS c, 15::DOUBLE AS h, score AS x, not_completed::DOUBLE AS y FROM rdpop WHERE abs(score - 40) > 1),
        {_fit_sql('rows_in')} SELECT {_STUDY_COLUMNS}, (SELECT count(*) FROM rdpop WHERE abs(score - 40) <= 1) AS rows_dropped,
        (SELECT count(*) FROM rdpop WHERE abs(score - 40) > 1) AS rows_kept FROM est""",
)
def _study_donut(spark, d):
    return rd.donut_table(_population(spark, d), "score", "not_completed", rd.PASS_MARK, [15.0])


@query(
    "rd_study_balance",
    f"""WITH {_FIRST}, cov AS (SELECT p.score AS x, i.* FROM rdpop p JOIN info i USING (code_module, code_presentation, id_student)),
        rows_in AS (SELECT 40::DOUBLE AS c, 15::DOUBLE AS h, covariate, level_name, x, y FROM (
          SELECT 'num_of_prev_attempts' AS covariate, '' AS level_name, x, num_of_prev_attempts::DOUBLE AS y FROM cov
          UNION ALL SELECT 'studied_credits', '', x, studied_credits FROM cov
          UNION ALL SELECT 'gender', lv, x, (gender = lv)::INT::DOUBLE FROM cov, (SELECT DISTINCT gender AS lv FROM cov)
          UNION ALL SELECT 'age_band', lv, x, (age_band = lv)::INT::DOUBLE FROM cov, (SELECT DISTINCT age_band AS lv FROM cov))),
        {_fit_sql('rows_in', 'c, h, covariate, level_name')} SELECT covariate, level_name, r(estimate) AS estimate, r(se) AS se,
          r(bias_corrected) AS bias_corrected, r(robust_se) AS robust_se, n_left, n_right FROM est""",
)
def _study_balance(spark, d):
    found = rd.covariate_balance(
        _population(spark, d), "score", ["num_of_prev_attempts", "studied_credits"], ["gender", "age_band"], rd.PASS_MARK, 15.0
    )
    return found.select("covariate", "level_name", "estimate", "se", "bias_corrected", "robust_se", "n_left", "n_right")


# The same on the full specification: all bandwidths, the primary one, all characteristics.

STUDY_NUMERIC = ["num_of_prev_attempts", "studied_credits"]
STUDY_CATEGORICAL = ["gender", "region", "highest_education", "imd_band", "age_band", "disability"]


def _or_null_sql(rows: str, by: str = "c, h") -> str:
    """CTE fitted: _fit_sql with a row for every specification, NULL where a side has too few distinct values of x."""
    return f"""{_fit_sql(rows, by)},
      have AS (SELECT {by}, count(*) FILTER (x < c) AS n_left, count(*) FILTER (x >= c) AS n_right,
         least(count(DISTINCT x) FILTER (x < c), count(DISTINCT x) FILTER (x >= c)) AS k FROM {rows} WHERE abs(x - c) < h GROUP BY ALL),
      fitted AS (SELECT have.* EXCLUDE (k), CASE WHEN k >= 2 THEN estimate END AS estimate, CASE WHEN k >= 2 THEN se END AS se,
         CASE WHEN k >= 3 THEN bias_corrected END AS bias_corrected, CASE WHEN k >= 3 THEN robust_se END AS robust_se FROM have LEFT JOIN est USING ({by}))"""


_ALL_SPECS = ", ".join(f"({rd.PASS_MARK}::DOUBLE, {h}::DOUBLE)" for h in rd.BANDWIDTHS)


@query("rd_study_bandwidths_all", f"WITH {_STUDY.format(specs=_ALL_SPECS)}, {_or_null_sql('rows_in')} SELECT {_STUDY_COLUMNS} FROM fitted")
def _study_bandwidths_all(spark, d):
    """Jump of the outcome at the pass mark for every bandwidth of the study."""
    return _study(spark, d, [rd.PASS_MARK], rd.BANDWIDTHS)


@query(
    "rd_study_donut_primary",
    f"""WITH {_FIRST}, rows_in AS (SELECT {rd.PASS_MARK}::DOUBLE AS c, {rd.PRIMARY_BANDWIDTH}::DOUBLE AS h, score AS x, not_completed::DOUBLE AS y FROM rdpop WHERE abs(score - 40) > 1),
        {_or_null_sql('rows_in')} SELECT {_STUDY_COLUMNS}, (SELECT count(*) FROM rdpop WHERE abs(score - 40) <= 1) AS rows_dropped,
        (SELECT count(*) FROM rdpop WHERE abs(score - 40) > 1) AS rows_kept FROM fitted""",
)
def _study_donut_primary(spark, d):
    return rd.donut_table(_population(spark, d), "score", "not_completed", rd.PASS_MARK, [rd.PRIMARY_BANDWIDTH])


_STUDY_COVARIATES = " UNION ALL ".join(
    [f"SELECT '{c}' AS covariate, '' AS level_name, x, {c}::DOUBLE AS y FROM cov WHERE {c} IS NOT NULL" for c in STUDY_NUMERIC]
    + [
        f"SELECT '{c}', lv, x, (coalesce({c}, '__NULL__') = lv)::INT::DOUBLE FROM cov, (SELECT DISTINCT coalesce({c}, '__NULL__') AS lv FROM cov)"
        for c in STUDY_CATEGORICAL
    ]
)


@query(
    "rd_study_balance_all",
    f"""WITH {_FIRST}, cov AS (SELECT p.score AS x, i.* FROM rdpop p JOIN info i USING (code_module, code_presentation, id_student)),
        rows_in AS (SELECT {rd.PASS_MARK}::DOUBLE AS c, {rd.PRIMARY_BANDWIDTH}::DOUBLE AS h, covariate, level_name, x, y FROM ({_STUDY_COVARIATES})),
        {_or_null_sql('rows_in', 'c, h, covariate, level_name')} SELECT covariate, level_name, r(estimate) AS estimate, r(se) AS se,
          r(bias_corrected) AS bias_corrected, r(robust_se) AS robust_se, n_left, n_right FROM fitted""",
)
def _study_balance_all(spark, d):
    found = rd.covariate_balance(
        _population(spark, d), "score", STUDY_NUMERIC, STUDY_CATEGORICAL, rd.PASS_MARK, rd.PRIMARY_BANDWIDTH
    )
    return found.select("covariate", "level_name", "estimate", "se", "bias_corrected", "robust_se", "n_left", "n_right")


@query(
    "rd_first_assessment_listing",
    f"WITH {_FIRST} SELECT code_module, code_presentation, id_assessment, date AS due_date, r(weight) AS weight FROM firsts",
)
def _listing(spark, d):
    return _firsts(b.typed_tables(spark, d)).select(*ch.GROUP, "id_assessment", "due_date", "weight")


@query(
    "conditional_waterfall",
    f"""WITH {_FIRST} SELECT count(*) AS submission_rows, count(*) FILTER (score IS NULL) AS null_score, count(*) FILTER (score IS NOT NULL AND is_banked = 1) AS banked,
          count(*) FILTER (score IS NOT NULL AND is_banked = 0) AS retained FROM firsts JOIN sub USING (id_assessment)""",
)
def _conditional_waterfall(spark, d):
    t = b.typed_tables(spark, d)
    states = rd.submission_states(_firsts(t), t.submissions)
    s = F.col("state")
    return states.agg(
        F.count(F.lit(1)).alias("submission_rows"),
        F.count(F.when(s == "null score", 1)).alias("null_score"),
        F.count(F.when(s == "banked", 1)).alias("banked"),
        F.count(F.when(s == "retained", 1)).alias("retained"),
    )


@query(
    "rd_population_rates",
    f"""WITH {_FIRST} SELECT coalesce(code_presentation, 'TOTAL') AS code_presentation, count(*) AS n_rows, count(DISTINCT id_student) AS n_units,
          r(avg(not_completed)) AS base_rate, r(min(score)) AS min_x, r(max(score)) AS max_x FROM rdpop GROUP BY ROLLUP (code_presentation)""",
)
def _population_rates(spark, d):
    return rd.population_rates(_population(spark, d), "code_presentation", "id_student", "score")


_PZ = detection_multiplier(rd.ALPHA, rd.POWER)


@query(
    "power_curve",
    f"""WITH {_FIRST}, rates AS (SELECT coalesce(code_presentation, 'TOTAL') AS code_presentation, avg(not_completed) AS p FROM rdpop GROUP BY ROLLUP (code_presentation))
        SELECT code_presentation, r(p) AS base_rate, CAST(e AS INTEGER) AS effect_points, CASE WHEN p - e / 100 > 0 AND p - e / 100 < 1 THEN
          CAST(ceil({_PZ * _PZ!r}::DOUBLE * (p * (1 - p) + (p - e / 100) * (1 - (p - e / 100))) / ((e / 100) * (e / 100))) AS BIGINT) END AS n_per_arm FROM rates, range(1, 11) g(e)""",
)
def _power(spark, d):
    rates = rd.population_rates(_population(spark, d), "code_presentation", "id_student", "score")
    return rd.power_curve(rates, ["code_presentation"])


@query(
    "minimum_detectable_effect",
    f"""WITH {_SPEC}, {_fit_sql('rows_in')} SELECT r(c) AS cutoff, r(h) AS bandwidth, r({_PZ!r}::DOUBLE * se) AS mde_conventional, r({_PZ!r}::DOUBLE * robust_se) AS mde_robust FROM est""",
)
def _mde(spark, d):
    return rd.minimum_detectable_effect(_table(spark, d)).select(
        "cutoff", "bandwidth", "mde_conventional", "mde_robust"
    )


@query(
    "population_gap",
    f"""WITH {_FIRST}, c AS (SELECT *, EXISTS (SELECT 1 FROM rdpop p WHERE p.code_module = cohort.code_module AND p.code_presentation = cohort.code_presentation AND p.id_student = cohort.id_student) AS hit
          FROM cohort WHERE cutoff = 90)
        SELECT if(hit, 'inside', 'outside') AS part, count(*) AS n_rows, r(avg(not_completed)) AS base_rate, r(count(*) / (SELECT count(*) FROM c)) AS share FROM c GROUP BY hit
        UNION ALL SELECT 'absent from cohort', count(*), NULL, NULL FROM rdpop ANTI JOIN c USING (code_module, code_presentation, id_student)""",
)
def _gap(spark, d):
    return rd.population_gap(cohort_of(spark, d).where(F.col("cutoff") == 90), _population(spark, d), KEY)


@query(
    "declared_outcome_rule",
    f"""WITH {_DENSITY}, rows_in AS (SELECT 25::DOUBLE AS c, h, ship_year, x, y FROM rv, (VALUES (8::DOUBLE), (10::DOUBLE), (15::DOUBLE)) s(h)), {_fit_sql('rows_in', 'c, h, ship_year')}
        SELECT CAST(ship_year AS INTEGER) AS ship_year, r(h) AS bandwidth, r(bias_corrected) AS bias_corrected, r(robust_se) AS robust_se,
          CASE WHEN abs(theta / density.se) > {_Z} THEN 'O9' WHEN abs(bias_corrected) > {_Z} * robust_se THEN 'O7' ELSE 'O8' END AS outcome
        FROM est JOIN density USING (ship_year)""",
)
def _outcome(spark, d):
    est = rd.jump_table(_rows(spark, d), "x", "y", [CUTOFF], [8.0, 10.0, 15.0], ["ship_year"])
    out = rd.declared_outcome(est, _density(spark, d), ["ship_year"])
    return out.select("ship_year", "bandwidth", "bias_corrected", "robust_se", "outcome")
