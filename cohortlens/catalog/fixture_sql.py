"""DuckDB text of the fixture bindings. Oracles name the CTEs they need; ``r(x)`` rounds."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["ev"] = """
SELECT event_id, user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
       event_type AS kind, value AS amount
FROM events"""

CTES["t_all"] = """
SELECT c_mktsegment AS code_module, CAST(year(o_orderdate) AS VARCHAR) AS code_presentation,
       o_custkey AS id_student, CAST(dayofyear(o_orderdate) - 1 AS INTEGER) AS day,
       o_orderkey, o_orderstatus, o_totalprice, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority
FROM orders JOIN customer ON o_custkey = c_custkey"""

CTES["t"] = "SELECT * FROM t_all"

CTES["enrolled"] = """
SELECT code_module, code_presentation, id_student, min(day) - 30 AS first_day, max(day) AS last_day,
       max(o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS last_status
FROM t GROUP BY ALL"""

CTES["reg_raw"] = """
SELECT code_module, code_presentation, id_student, CAST(first_day AS VARCHAR) AS date_registration,
       CASE last_status WHEN 'F' THEN CAST(last_day AS VARCHAR) ELSE '?' END AS date_unregistration
FROM enrolled"""

CTES["info_raw"] = """
SELECT code_module, code_presentation, id_student,
       if(id_student % 2 = 0, 'F', 'M') AS gender, r_name AS region,
       'level ' || (c_nationkey % 4) AS highest_education,
       CASE WHEN id_student % 29 = 0 THEN '?'
            WHEN c_acctbal >= 100 AND c_acctbal < 1200 THEN '10-20'
            ELSE (10 * least(9, CAST(floor((c_acctbal + 1000.0) / 1100.0) AS INTEGER)))::VARCHAR || '-' ||
                 (10 * least(9, CAST(floor((c_acctbal + 1000.0) / 1100.0) AS INTEGER)) + 10)::VARCHAR || '%' END AS imd_band,
       ['0-35', '35-55', '55<='][1 + id_student % 3] AS age_band,
       CAST(id_student % 4 AS INTEGER) AS num_of_prev_attempts,
       CAST(30 * (1 + id_student % 5) AS INTEGER) AS studied_credits,
       if(id_student % 10 = 0, 'Y', 'N') AS disability,
       CASE last_status WHEN 'F' THEN 'Withdrawn' WHEN 'P' THEN 'Distinction'
            ELSE if(last_order % 2 = 0, 'Fail', 'Pass') END AS final_result
FROM enrolled JOIN customer ON id_student = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTES["act_all"] = """
SELECT c_mktsegment AS code_module, CAST(year(l_shipdate) AS VARCHAR) AS code_presentation,
       o_custkey AS id_student, l_partkey AS id_site, CAST(dayofyear(l_shipdate) - 1 AS INTEGER) AS date,
       CAST(l_quantity AS INTEGER) AS sum_click
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""

CTES["act"] = "SELECT * FROM act_all"

CTES["site"] = "SELECT p_partkey AS id_site, p_type AS activity_type FROM part"

CTES["ass_raw"] = """
SELECT DISTINCT code_module, code_presentation,
       CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], code_module) * 100000
            + CAST(code_presentation AS INTEGER) * 10 + priority AS BIGINT) AS id_assessment,
       CASE priority WHEN 4 THEN 'CMA' WHEN 5 THEN 'Exam' ELSE 'TMA' END AS assessment_type,
       CASE priority WHEN 4 THEN '?' ELSE CAST(60 * priority AS VARCHAR) END AS date,
       CAST(10 * priority AS DOUBLE) AS weight
FROM t"""

CTES["sub_raw"] = """
SELECT CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], code_module) * 100000
            + CAST(code_presentation AS INTEGER) * 10 + priority AS BIGINT) AS id_assessment,
       id_student, arg_min(day, o_orderkey) AS date_submitted,
       CAST(min(o_orderkey) % 20 = 0 AS INTEGER) AS is_banked,
       CASE WHEN min(o_orderkey) % 50 = 0 THEN '?'
            ELSE CAST(CAST(floor(arg_min(o_totalprice, o_orderkey) / 5000.0) AS BIGINT) AS VARCHAR) END AS score
FROM t GROUP BY code_module, code_presentation, id_student, priority"""

CTES["course"] = "SELECT DISTINCT code_module, code_presentation, 366 AS module_presentation_length FROM t"

CTES["reg"] = """
SELECT * REPLACE (TRY_CAST(date_registration AS INTEGER) AS date_registration,
                  TRY_CAST(date_unregistration AS INTEGER) AS date_unregistration) FROM reg_raw"""
CTES["info"] = """
SELECT * REPLACE (CASE imd_band WHEN '?' THEN NULL WHEN '10-20' THEN '10-20%' ELSE imd_band END AS imd_band)
FROM info_raw"""
CTES["sub"] = "SELECT * REPLACE (TRY_CAST(score AS DOUBLE) AS score) FROM sub_raw"
CTES["ass"] = "SELECT * REPLACE (TRY_CAST(date AS INTEGER) AS date) FROM ass_raw"

CTES["pop"] = """
SELECT code_module, code_presentation, id_student, date_registration, date_unregistration, final_result
FROM reg JOIN info USING (code_module, code_presentation, id_student)"""

CTES["states"] = """
SELECT pop.*, cutoff,
       CASE WHEN date_registration IS NULL THEN 'E3' WHEN date_registration > cutoff THEN 'E2'
            WHEN date_unregistration < cutoff THEN 'E1' ELSE 'kept' END AS first_exclusion
FROM pop, (VALUES (45), (90), (180)) c(cutoff)"""

CTES["cohort"] = """
SELECT * EXCLUDE (first_exclusion),
       CAST(final_result IN ('Fail', 'Withdrawn') AS INTEGER) AS not_completed,
       CASE WHEN code_presentation <= '1998' THEN 'train' WHEN code_presentation = '1999' THEN 'validate'
            ELSE 'test' END AS split
FROM states WHERE first_exclusion = 'kept'"""

# Feature oracle: everything from the rows a cohort member had before its cutoff, cutoff by cutoff.
CTES["seen"] = """
SELECT cutoff, act.* FROM cohort JOIN act USING (code_module, code_presentation, id_student) WHERE date < cutoff"""
CTES["seen_day"] = """
SELECT cutoff, code_module, code_presentation, id_student, date, sum(sum_click) AS clicks FROM seen GROUP BY ALL"""
CTES["volume"] = """
SELECT cutoff, code_module, code_presentation, id_student, sum(clicks) AS total_clicks, count(*) AS active_days,
       coalesce(sum(clicks) FILTER (date >= cutoff - 7), 0) AS clicks_last_7d, max(date) AS max_date,
       sum(clicks) FILTER (date BETWEEN 0 AND cutoff // 2 - 1) AS first_half,
       sum(clicks) FILTER (date >= cutoff // 2) AS second_half
FROM seen_day GROUP BY ALL"""
CTES["slope"] = """
SELECT cutoff, code_module, code_presentation, id_student, regr_slope(coalesce(clicks, 0), date) AS click_slope_daily
FROM (SELECT cutoff, code_module, code_presentation, id_student, unnest(range(0, cutoff)) AS date FROM cohort)
LEFT JOIN seen_day USING (cutoff, code_module, code_presentation, id_student, date) GROUP BY ALL"""
CTES["gap"] = """
SELECT cutoff, code_module, code_presentation, id_student, max(step) AS longest_activity_gap FROM (
  SELECT *, date - lag(date) OVER (PARTITION BY cutoff, code_module, code_presentation, id_student ORDER BY date) AS step
  FROM seen_day) GROUP BY ALL"""
CTES["range_of"] = """
SELECT cutoff, code_module, code_presentation, id_student, count(DISTINCT activity_type) AS distinct_activity_types,
       count(DISTINCT id_site) AS distinct_materials,
       coalesce(sum(sum_click) FILTER (activity_type IN ('PROMO', 'STANDARD')), 0) AS assessment_clicks
FROM seen LEFT JOIN site USING (id_site) GROUP BY ALL"""
CTES["handed_in"] = """
SELECT sub.*, ass.code_module, ass.code_presentation, assessment_type, ass.date AS due_date
FROM sub LEFT JOIN ass USING (id_assessment)"""
CTES["evidence"] = """
SELECT * FROM handed_in WHERE assessment_type <> 'Exam' AND coalesce(is_banked, 0) <> 1"""
CTES["work"] = """
SELECT cutoff, code_module, code_presentation, id_student, count(*) AS n_assessments_submitted,
       avg(score) AS mean_score_submitted, min(score) AS min_score_submitted,
       avg(date_submitted - due_date) AS mean_submission_lateness
FROM cohort JOIN evidence USING (code_module, code_presentation, id_student)
WHERE date_submitted < cutoff GROUP BY ALL"""
CTES["overdue"] = """
SELECT c.cutoff, c.code_module, c.code_presentation, c.id_student, count(a.id_assessment) AS n_due_not_submitted
FROM cohort c LEFT JOIN ass a ON a.code_module = c.code_module AND a.code_presentation = c.code_presentation
     AND a.assessment_type <> 'Exam' AND a.date < c.cutoff
     AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.id_assessment = a.id_assessment AND e.id_student = c.id_student
                     AND e.date_submitted < c.cutoff)
GROUP BY ALL"""
CTES["feat"] = """
SELECT cutoff, code_module, code_presentation, id_student, not_completed, split,
       gender, region, highest_education, imd_band, age_band, disability, num_of_prev_attempts, studied_credits,
       CAST(coalesce(total_clicks, 0) AS BIGINT) AS total_clicks, coalesce(active_days, 0) AS active_days,
       CAST(coalesce(clicks_last_7d, 0) AS BIGINT) AS clicks_last_7d,
       total_clicks / active_days::DOUBLE AS mean_clicks_per_active_day,
       -date_registration AS days_registered_before_start,
       cutoff - 1 - max_date AS days_since_last_activity, click_slope_daily,
       CASE WHEN first_half > 0 THEN coalesce(second_half, 0)::DOUBLE / first_half END AS second_half_click_ratio,
       longest_activity_gap, coalesce(distinct_activity_types, 0) AS distinct_activity_types,
       coalesce(distinct_materials, 0) AS distinct_materials,
       CASE WHEN total_clicks > 0 THEN assessment_clicks::DOUBLE / total_clicks ELSE 0.0::DOUBLE END AS assessment_material_share,
       coalesce(n_assessments_submitted, 0) AS n_assessments_submitted, mean_score_submitted, min_score_submitted,
       mean_submission_lateness, n_due_not_submitted,
       percent_rank() OVER (PARTITION BY cutoff, code_module, code_presentation ORDER BY coalesce(total_clicks, 0)) AS clicks_percentile,
       CASE WHEN mean_score_submitted IS NOT NULL THEN percent_rank() OVER (
            PARTITION BY cutoff, code_module, code_presentation, mean_score_submitted IS NULL
            ORDER BY mean_score_submitted) END AS score_percentile
FROM cohort
LEFT JOIN info USING (code_module, code_presentation, id_student)
LEFT JOIN volume USING (cutoff, code_module, code_presentation, id_student)
LEFT JOIN slope USING (cutoff, code_module, code_presentation, id_student)
LEFT JOIN gap USING (cutoff, code_module, code_presentation, id_student)
LEFT JOIN range_of USING (cutoff, code_module, code_presentation, id_student)
LEFT JOIN work USING (cutoff, code_module, code_presentation, id_student)
LEFT JOIN overdue USING (cutoff, code_module, code_presentation, id_student)"""

# Scored sets
CTES["scored"] = """
SELECT event_id, user_id, day, if(day < 15, 'validate', 'test') AS split, CAST(kind = 'error' AS INTEGER) AS y,
       CASE WHEN user_id % 11 <> 0 THEN 'b' || (user_id % 7) END AS band, 'w' || (day // 7) AS week, rung,
       CASE rung WHEN 'R1' THEN amount / (amount + 50.0::DOUBLE) ELSE (event_id % 101)::DOUBLE / 101.0::DOUBLE END AS p
FROM ev, (VALUES ('R1'), ('R2')) g(rung)"""
CTES["scored_cut"] = """
SELECT cutoff, event_id, user_id, if(day < 15, 'validate', 'test') AS split, CAST(kind = 'error' AS INTEGER) AS y, rung,
       CASE rung WHEN 'R1' THEN amount / (amount + 36.0::DOUBLE + cutoff)
                 ELSE (event_id * cutoff % 101)::DOUBLE / 101.0::DOUBLE END AS p
FROM ev, (VALUES ('R1'), ('R2')) g(rung), (VALUES (14), (28)) c(cutoff)"""
CTES["grid"] = "SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) g(i)"
CTES["drift"] = """
SELECT CASE WHEN year(l_shipdate) <= 1998 THEN 'train' WHEN year(l_shipdate) = 1999 THEN 'validate' ELSE 'test' END AS split,
       l_quantity, l_extendedprice, CASE WHEN l_tax <> 0.05 THEN l_discount END AS l_discount,
       CAST(p_size AS DOUBLE) AS p_size, l_returnflag, CASE WHEN l_quantity <> 13 THEN l_linestatus END AS l_linestatus,
       CASE WHEN year(l_shipdate) <= 1998 AND p_type = 'PROMO' THEN 'OTHER' ELSE p_type END AS p_type
FROM lineitem JOIN part ON l_partkey = p_partkey"""
CTES["rv"] = """
SELECT l_quantity AS x, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount, l_tax,
       CASE WHEN l_discount <> 0.03 THEN l_linestatus END AS l_linestatus, year(l_shipdate) AS ship_year
FROM lineitem"""

# r(x): bare call with balanced parentheses
_ROUND = re.compile(r"\br\(")


def _expand_rounding(sql: str, digits: int) -> str:
    out, pos = [], 0
    for m in iter(lambda: _ROUND.search(sql, pos), None):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = _expand_rounding(sql[m.end() : i - 1], digits)
        out.append(sql[pos : m.start()] + f"(round(CAST({inner} AS DOUBLE), {digits}) + 0.0)")
        pos = i
    return "".join(out) + sql[pos:]


def _needed(sql: str, own: set[str], found: list[str]) -> None:
    for name in CTES:
        if name in own or name in found:
            continue
        if re.search(rf"(?:FROM|JOIN|,)\s*\(?\s*{name}\b(?!\s*\()", sql) or re.search(rf"\b{name}\.\*", sql):
            _needed(CTES[name], own, found)
            if name not in found:
                found.append(name)


def with_ctes(sql: str, digits: int = 6) -> str:
    """Complete SQL text: the fixture CTEs that ``sql`` names, then ``sql`` itself."""
    body = _expand_rounding(sql.strip(), digits)
    own = set(re.findall(r"(\w+)\s+AS\s+(?:MATERIALIZED\s+)?\(\s*(?:SELECT|WITH|FROM)", body))
    found: list[str] = []
    _needed(body, own, found)
    if not found:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in found)
    own_list = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own_list:
        return f"WITH {own_list[1] or ''}{head},\n{body[own_list.end():]}"
    return f"WITH {head}\n{body}"
