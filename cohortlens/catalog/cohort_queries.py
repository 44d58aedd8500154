"""Cleaning, cohort and profile queries (binding T over orders, lineitem, customer, part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.registry import query
from cohortlens.functions.scalars import label_from, recode, sentinel_to_null, tolerant_numeric
from cohortlens.functions.session import stage
from cohortlens.operators import cleaning, profiling
from cohortlens.operators import cohort as ch
from cohortlens.operators.activity import first_active_day
from cohortlens.sources import bindings as b

KEY = ch.KEY


def cohort_of(spark, d):
    t = b.typed_tables(spark, d)
    return ch.cohorts(ch.population(t.registration, t.info), b.DESIGN)


def states_of(spark, d):
    t = b.typed_tables(spark, d)
    return ch.exclusion_states(ch.population(t.registration, t.info), b.DESIGN.cutoffs)


@query(
    "typed_views",
    """SELECT code_module, code_presentation, id_student, date_registration, date_unregistration,
              imd_band, num_of_prev_attempts, studied_credits, final_result
       FROM reg JOIN info USING (code_module, code_presentation, id_student)""",
)
def _typed_views(spark, d):
    b.typed_tables(spark, d).create_views()
    return spark.sql(
        """SELECT code_module, code_presentation, id_student, date_registration, date_unregistration,
                  imd_band, num_of_prev_attempts, studied_credits, final_result
           FROM v_student_registration JOIN v_student_info USING (code_module, code_presentation, id_student)"""
    )


@query(
    "sentinel_to_null",
    """SELECT code_module, code_presentation, id_student, date_registration, date_unregistration FROM reg""",
)
def _sentinel(spark, d):
    return b.raw_tables(spark, d).student_registration.select(
        *KEY,
        sentinel_to_null("date_registration", "int").alias("date_registration"),
        sentinel_to_null("date_unregistration", "int").alias("date_unregistration"),
    )


@query(
    "tolerant_numeric",
    """SELECT is_banked, count(*) AS n_rows, count(TRY_CAST(score AS DOUBLE)) AS n_parsed,
              count(*) FILTER (TRY_CAST(score AS DOUBLE) IS NULL) AS n_missing,
              r(avg(TRY_CAST(score AS DOUBLE))) AS mean_score
       FROM sub_raw GROUP BY ALL""",
)
def _tolerant(spark, d):
    s = tolerant_numeric("score")
    return (
        b.raw_tables(spark, d)
        .student_assessment.groupBy("is_banked")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(s).alias("n_parsed"),
            F.count(F.when(s.isNull(), 1)).alias("n_missing"),
            F.avg(s).alias("mean_score"),
        )
    )


@query(
    "category_recode",
    "SELECT imd_band, count(*) AS n_rows FROM info GROUP BY ALL",
)
def _recode(spark, d):
    raw = b.raw_tables(spark, d).student_info
    return raw.groupBy(recode("imd_band", cleaning.BAND_FIX).alias("imd_band")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "target_label",
    """SELECT code_module, code_presentation, id_student, final_result,
              CAST(final_result IN ('Fail', 'Withdrawn') AS INTEGER) AS not_completed,
              CASE WHEN final_result IN ('Fail', 'Withdrawn') THEN 1 ELSE 0 END AS not_completed_or_zero
       FROM info""",
)
def _target(spark, d):
    return b.typed_tables(spark, d).info.select(
        *KEY,
        "final_result",
        ch.target_label("final_result").alias("not_completed"),
        label_from("final_result", {1: ch.OUTCOMES[1]}, 0).alias("not_completed_or_zero"),
    )


@query(
    "split_label",
    """SELECT code_presentation, CASE WHEN code_presentation <= '1998' THEN 'train'
              WHEN code_presentation = '1999' THEN 'validate' WHEN code_presentation IN ('2000', '2001') THEN 'test' END AS split,
              count(*) AS n_rows
       FROM t_all GROUP BY ALL""",
)
def _split(spark, d):
    return (
        b.terms(spark, d)
        .groupBy("code_presentation")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("split", ch.split_label("code_presentation", b.DESIGN.splits))
    )


@query(
    "cohort_exclusions",
    """SELECT cutoff, code_module, code_presentation, id_student, date_registration, date_unregistration,
              final_result, not_completed, split FROM cohort""",
)
def _cohort(spark, d):
    return cohort_of(spark, d).select(
        "cutoff", *KEY, "date_registration", "date_unregistration", "final_result", "not_completed", "split"
    )


@query(
    "domain_check",
    """SELECT code_presentation, count(*) AS n_rows FROM t_all
       WHERE code_presentation NOT IN ('1995', '1996', '1997', '1998', '1999', '2000') GROUP BY ALL""",
)
def _domain(spark, d):
    return cleaning.unexpected_values(b.terms(spark, d), "code_presentation", b.EXPECTED_YEARS)


@query(
    "not_null_check",
    """SELECT count(*) AS n_rows, count(*) FILTER (not_completed IS NULL) AS null_not_completed,
              count(*) FILTER (split IS NULL) AS null_split FROM cohort""",
)
def _not_null(spark, d):
    return cleaning.null_counts(cohort_of(spark, d), ["not_completed", "split"])


@query(
    "normalisation_counts",
    """SELECT 'student_registration' AS table_name, 'date_registration' AS column_name, '?' AS old_value,
              count(*) AS n_rows FROM reg_raw WHERE date_registration = '?'
       UNION ALL SELECT 'student_registration', 'date_unregistration', '?', count(*) FROM reg_raw WHERE date_unregistration = '?'
       UNION ALL SELECT 'student_assessment', 'score', '?', count(*) FROM sub_raw WHERE score = '?'
       UNION ALL SELECT 'assessments', 'date', '?', count(*) FROM ass_raw WHERE date = '?'
       UNION ALL SELECT 'student_info', 'imd_band', '?', count(*) FROM info_raw WHERE imd_band = '?'
       UNION ALL SELECT 'student_info', 'imd_band', '10-20', count(*) FROM info_raw WHERE imd_band = '10-20'""",
)
def _normalisation(spark, d):
    return cleaning.normalisation_counts(b.raw_tables(spark, d))


@query(
    "inner_join_composite",
    """SELECT code_module, code_presentation, id_student, date_registration, date_unregistration, final_result FROM pop""",
)
def _inner_join(spark, d):
    t = b.typed_tables(spark, d)
    return ch.population(t.registration, t.info)


def _references(spark, d):
    raw = b.raw_tables(spark, d)
    return {
        "student_info -> courses": (raw.student_info, raw.courses, ch.GROUP),
        "student_registration -> student_info": (raw.student_registration, raw.student_info, KEY),
        "student_vle -> student_info": (raw.student_vle, raw.student_info, KEY),
        "student_assessment -> assessments": (raw.student_assessment, raw.assessments, ["id_assessment"]),
    }


@query(
    "orphan_counts",
    """SELECT 'student_info -> courses' AS reference, count(*) AS orphan_rows FROM info_raw ANTI JOIN course USING (code_module, code_presentation)
       UNION ALL SELECT 'student_registration -> student_info', count(*) FROM reg_raw ANTI JOIN info_raw USING (code_module, code_presentation, id_student)
       UNION ALL SELECT 'student_vle -> student_info', count(*) FROM act ANTI JOIN info_raw USING (code_module, code_presentation, id_student)
       UNION ALL SELECT 'student_assessment -> assessments', count(*) FROM sub_raw ANTI JOIN ass_raw USING (id_assessment)""",
)
def _orphans(spark, d):
    return profiling.orphan_counts(_references(spark, d))


@query(
    "row_counts",
    """SELECT 'student_info' AS table_name, count(*) AS n_rows FROM info_raw
       UNION ALL SELECT 'student_registration', count(*) FROM reg_raw
       UNION ALL SELECT 'student_assessment', count(*) FROM sub_raw
       UNION ALL SELECT 'assessments', count(*) FROM ass_raw
       UNION ALL SELECT 'courses', count(*) FROM course
       UNION ALL SELECT 'vle', count(*) FROM site
       UNION ALL SELECT 'student_vle', count(*) FROM act""",
)
def _row_counts(spark, d):
    return profiling.row_counts(b.raw_tables(spark, d).all())


@query(
    "schema_profile",
    """SELECT 'region' AS table_name, (SELECT count(*) FROM region) AS n_rows, 2 AS n_columns, 'r_regionkey, r_name' AS column_names
       UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 3, 'n_nationkey, n_name, n_regionkey'
       UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 5, 'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment'
       UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 6, 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority'
       UNION ALL SELECT 'events', (SELECT count(*) FROM events), 6, 'event_id, ts, user_id, event_type, value, props'
       UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), 4, 's_suppkey, s_name, s_nationkey, s_acctbal'
       UNION ALL SELECT 'part', (SELECT count(*) FROM part), 6, 'p_partkey, p_name, p_brand, p_type, p_size, p_retailprice'
       UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 11, 'l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate'
       UNION ALL SELECT 'documents', (SELECT count(*) FROM documents), 5, 'doc_id, text, lang, source, n_chars'
       UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings), 3, 'vec_id, embedding, label'
       UNION ALL SELECT 'pages', (SELECT count(*) FROM pages), 3, 'page_id, url, html'
       UNION ALL SELECT 'benchmark', (SELECT count(*) FROM benchmark), 2, 'item_id, text'
       UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), 3, 'doc_id, quality, toxic'
       UNION ALL SELECT 'conversations', (SELECT count(*) FROM conversations), 4, 'conv_id, turn, role, text'""",
)
def _schema_profile(spark, d):
    names = [*b.SCHEMAS, "supplier", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    return profiling.schema_profile({n: b.table(spark, d, n) for n in names})


@query(
    "key_uniqueness",
    """SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS distinct_keys,
              count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_rows
       FROM lineitem""",
)
def _key_uniqueness(spark, d):
    return profiling.key_uniqueness(b.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "distinct_counts",
    """SELECT 'code_module' AS column_name, count(DISTINCT code_module) AS n_distinct FROM act
       UNION ALL SELECT 'id_student', count(DISTINCT id_student) FROM act
       UNION ALL SELECT 'id_site', count(DISTINCT id_site) FROM act
       UNION ALL SELECT 'date', count(DISTINCT date) FROM act""",
)
def _distinct_counts(spark, d):
    return profiling.distinct_counts(
        b.raw_tables(spark, d).student_vle, ["code_module", "id_student", "id_site", "date"]
    )


@query(
    "rows_per_student",
    """SELECT count(*) AS n_units, min(c) AS min_rows, max(c) AS max_rows, r(avg(c)) AS mean_rows
       FROM (SELECT id_student, count(*) AS c FROM act GROUP BY ALL)""",
)
def _rows_per_student(spark, d):
    return profiling.rows_per_unit(b.raw_tables(spark, d).student_vle, ["id_student"])


@query(
    "value_counts",
    """SELECT column_name, value, count(*) AS n_rows FROM (
         SELECT 'gender' AS column_name, gender AS value FROM info UNION ALL SELECT 'imd_band', imd_band FROM info
         UNION ALL SELECT 'final_result', final_result FROM info UNION ALL SELECT 'region', region FROM info
         UNION ALL SELECT 'highest_education', highest_education FROM info UNION ALL SELECT 'age_band', age_band FROM info
         UNION ALL SELECT 'disability', disability FROM info)
       GROUP BY ALL""",
)
def _value_counts(spark, d):
    return profiling.value_counts(b.typed_tables(spark, d).info, ["gender", "imd_band", "final_result", "region", "highest_education", "age_band", "disability"])


@query(
    "missingness_profile",
    """SELECT c.column_name, count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_null,
              count(*) FILTER (v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL) AS n_unparsed,
              r(min(TRY_CAST(v AS DOUBLE))) AS min_value, r(max(TRY_CAST(v AS DOUBLE))) AS max_value
       FROM (SELECT 'date_submitted' AS column_name, CAST(date_submitted AS VARCHAR) AS v FROM sub_raw
             UNION ALL SELECT 'is_banked', CAST(is_banked AS VARCHAR) FROM sub_raw
             UNION ALL SELECT 'score', score FROM sub_raw) c GROUP BY ALL""",
)
def _missingness(spark, d):
    return profiling.missingness_profile(
        b.raw_tables(spark, d).student_assessment, ["date_submitted", "is_banked", "score"]
    )


@query(
    "numeric_profile",
    """SELECT feature, count(*) AS n_rows, count(*) - count(value) AS n_null, r((count(*) - count(value)) / count(*)) AS null_share,
              r(min(value)) AS min_value, r(max(value)) AS max_value, r(avg(value)) AS mean_value,
              r(median(value)) AS median_value, r(stddev_samp(value)) AS std_value
       FROM (SELECT 'score' AS feature, score AS value FROM sub UNION ALL SELECT 'date_submitted', date_submitted FROM sub)
       GROUP BY ALL""",
)
def _numeric_profile(spark, d):
    rows = stage(b.typed_tables(spark, d).submissions.select("score", "date_submitted"), "submissions")
    return profiling.numeric_profile(rows, ["score", "date_submitted"])


@query(
    "signed_range_profile",
    """SELECT min(date_registration) AS min_day, max(date_registration) AS max_day,
              count(*) FILTER (date_registration < 0) AS rows_before_day_0 FROM reg""",
)
def _signed_range(spark, d):
    return profiling.signed_range_profile(b.typed_tables(spark, d).registration, "date_registration")


@query(
    "crosstab_null_state",
    """SELECT final_result, CASE WHEN date_unregistration IS NULL THEN 'NULL' ELSE 'NOT NULL' END AS unreg_state,
              count(*) AS n_rows FROM pop GROUP BY ALL""",
)
def _crosstab(spark, d):
    t = b.typed_tables(spark, d)
    return ch.result_by_null_state(ch.population(t.registration, t.info))


@query(
    "withdrawal_conflicts",
    """SELECT count(*) FILTER (final_result = 'Withdrawn' AND date_unregistration IS NULL) AS withdrawn_without_day,
              count(*) FILTER (final_result <> 'Withdrawn' AND date_unregistration IS NOT NULL) AS day_without_withdrawal
       FROM pop""",
)
def _conflicts(spark, d):
    t = b.typed_tables(spark, d)
    return ch.withdrawal_conflicts(ch.population(t.registration, t.info))


@query(
    "presence_grid",
    """SELECT code_module, """
    + ", ".join(
        f"CAST(bool_or(code_presentation = '{y}') AS INTEGER) AS has_{y}" for y in range(1995, 2002)
    )
    + " FROM course GROUP BY ALL",
)
def _presence(spark, d):
    return profiling.presence_grid(
        b.raw_tables(spark, d).courses, "code_module", "code_presentation", b.DESIGN.presentations
    )


@query(
    "exclusion_waterfall",
    """SELECT cutoff, coalesce(code_presentation, 'TOTAL') AS code_presentation, count(*) AS start_rows,
              count(*) FILTER (first_exclusion = 'E3') AS removed_e3, count(*) FILTER (first_exclusion = 'E2') AS removed_e2,
              count(*) FILTER (first_exclusion = 'E1') AS removed_e1, count(*) FILTER (first_exclusion = 'kept') AS remaining
       FROM states GROUP BY GROUPING SETS ((cutoff, code_presentation), (cutoff))""",
)
def _waterfall(spark, d):
    return ch.exclusion_waterfall(states_of(spark, d))


@query(
    "base_rates",
    """SELECT 'cutoff+code_presentation+split' AS level, cutoff, NULL AS code_module, code_presentation, split,
              count(*) AS n_rows, r(avg(not_completed)) AS base_rate FROM cohort GROUP BY ALL
       UNION ALL SELECT 'cutoff+split', cutoff, NULL, NULL, split, count(*), r(avg(not_completed)) FROM cohort GROUP BY ALL
       UNION ALL SELECT 'cutoff+code_module+code_presentation', cutoff, code_module, code_presentation, NULL, count(*),
              r(avg(not_completed)) FROM cohort GROUP BY ALL""",
)
def _base_rates(spark, d):
    return ch.base_rates(
        cohort_of(spark, d),
        [
            ["cutoff", "code_presentation", "split"],
            ["cutoff", "split"],
            ["cutoff", "code_module", "code_presentation"],
        ],
    )


@query(
    "exclusion_share",
    """SELECT cutoff, code_presentation, e AS entering, k AS removed, r(CASE WHEN e = 0 THEN 0 ELSE k / e END) AS share FROM (
         SELECT cutoff, code_presentation, count(*) FILTER (first_exclusion IN ('E1', 'kept')) AS e,
                count(*) FILTER (first_exclusion = 'E1') AS k FROM states GROUP BY ALL)""",
)
def _exclusion_share(spark, d):
    return ch.exclusion_share(states_of(spark, d))


@query(
    "zero_activity_summary",
    """SELECT cutoff, count(*) AS total_rows, count(*) FILTER (NOT hit) AS zero_rows,
              r(avg(not_completed) FILTER (NOT hit)) AS base_rate_zero, r(avg(not_completed) FILTER (hit)) AS base_rate_rest,
              r(count(*) FILTER (NOT hit) / count(*)) AS zero_share
       FROM (SELECT c.*, EXISTS (SELECT 1 FROM act a WHERE a.code_module = c.code_module AND
               a.code_presentation = c.code_presentation AND a.id_student = c.id_student AND a.date < c.cutoff) AS hit
             FROM cohort c) GROUP BY ALL""",
)
def _zero_activity(spark, d):
    first = first_active_day(b.raw_tables(spark, d).student_vle, KEY)
    return ch.zero_activity_summary(cohort_of(spark, d), first)


@query(
    "flagged_row_counts",
    "SELECT count(*) AS flagged_rows, count(DISTINCT id_student) AS flagged_units FROM sub WHERE is_banked = 1",
)
def _flagged(spark, d):
    return ch.flagged_rows(b.typed_tables(spark, d).submissions, F.col("is_banked") == 1, "id_student")


@query(
    "first_due_per_group",
    """SELECT code_module, code_presentation, min(date) AS earliest_due, count(*) AS n_assessments
       FROM ass WHERE assessment_type = 'TMA' GROUP BY ALL""",
)
def _first_due(spark, d):
    return ch.first_due(b.typed_tables(spark, d).assessments, "TMA")


@query(
    "groups_without_due",
    """SELECT code_module, code_presentation FROM course
       EXCEPT SELECT code_module, code_presentation FROM ass WHERE assessment_type = 'CMA' AND date IS NOT NULL""",
)
def _groups_without(spark, d):
    t = b.typed_tables(spark, d)
    dated = t.assessments.where(F.col("date").isNotNull())
    return ch.groups_without(t.courses, ch.first_due(dated, "CMA"))
