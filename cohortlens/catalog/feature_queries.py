"""Activity, submission and feature queries (bindings A and T) plus ordering and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.catalog.cohort_queries import KEY, cohort_of, states_of
from cohortlens.catalog.registry import query
from cohortlens.functions.ranking import with_percent_rank
from cohortlens.functions.scalars import safe_ratio
from cohortlens.functions.session import stage
from cohortlens.operators import activity, features, profiling, submissions
from cohortlens.operators import cohort as ch
from cohortlens.operators import ordering
from cohortlens.sources import bindings as b

CUTS = list(b.DESIGN.cutoffs)


def features_of(spark, d) -> DataFrame:
    return features.feature_table(b.typed_tables(spark, d, stored=True), b.DESIGN, b.ASSESSMENT_KINDS)


# --- activity on events ----------------------------------------------------------------------


@query(
    "activity_features",
    """WITH daily AS (SELECT user_id, day, sum(amount) AS total, count(*) AS n FROM ev WHERE day < 14 GROUP BY ALL),
       stepped AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS step FROM daily),
       base AS (SELECT user_id, r(sum(total)) AS total_amount, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS active_days,
              r(sum(total) FILTER (day >= 7)) AS amount_last_7d, CAST(13 - max(day) AS INTEGER) AS days_since_last,
              max(step) AS longest_gap FROM stepped GROUP BY ALL),
       dense AS (SELECT user_id, unnest(range(0, 14)) AS day FROM base),
       sl AS (SELECT user_id, r(regr_slope(coalesce(total, 0), day)) AS slope FROM dense LEFT JOIN daily USING (user_id, day) GROUP BY ALL)
       SELECT *, r(percent_rank() OVER (ORDER BY n_events)) AS events_percentile FROM base JOIN sl USING (user_id)""",
)
def activity_features(spark, d):
    log = activity.before(b.event_log(spark, d), "day", 14)
    days = activity.daily_totals(log, ["user_id"], "day", "amount")
    order = Window.partitionBy("user_id").orderBy("day")
    stepped = days.withColumn("step", F.col("day") - F.lag("day").over(order))
    per_user = stepped.groupBy("user_id").agg(
        F.sum("day_total").alias("total_amount"),
        F.sum("day_rows").alias("n_events"),
        F.count(F.lit(1)).alias("active_days"),
        F.sum(F.when(F.col("day") >= 7, F.col("day_total"))).alias("amount_last_7d"),
        (F.lit(13) - F.max("day")).alias("days_since_last"),
        F.max("step").alias("longest_gap"),
        activity.zero_filled_slope(F.col("day"), F.col("day_total"), 14).alias("slope"),
    )
    return with_percent_rank(stage(per_user, "activity"), [], "n_events", "events_percentile")


# --- filters and small expressions -----------------------------------------------------------


@query(
    "point_in_time_filter",
    """SELECT 'event' AS source, count(*) AS n_rows, max(date) AS last_day FROM act WHERE date < 90
       UNION ALL SELECT 'submission', count(*), max(date_submitted) FROM sub WHERE date_submitted < 90
       UNION ALL SELECT 'due', count(*), max(date) FROM ass WHERE date < 90""",
)
def _point_in_time(spark, d):
    t = b.typed_tables(spark, d)
    parts = [
        activity.before(df, day, 90).agg(F.count(F.lit(1)).alias("n_rows"), F.max(day).alias("last_day")).select(
            F.lit(name).alias("source"), "n_rows", "last_day"
        )
        for name, df, day in (
            ("event", t.activity, "date"),
            ("submission", t.submissions, "date_submitted"),
            ("due", t.assessments, "date"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "half_open_window_filter",
    """SELECT code_module, count(*) FILTER (date >= 83 AND date < 90) AS rows_last_7d,
              count(*) FILTER (date >= 0 AND date < 45) AS rows_first_half,
              count(*) FILTER (date >= 45 AND date < 90) AS rows_second_half
       FROM act WHERE date < 90 GROUP BY ALL""",
)
def _windows(spark, d):
    day, c = F.col("date"), 90
    rows = activity.before(b.typed_tables(spark, d).activity, "date", c)
    return rows.groupBy("code_module").agg(
        F.count(F.when(day >= c - 7, 1)).alias("rows_last_7d"),
        F.count(F.when((day >= 0) & (day < c // 2), 1)).alias("rows_first_half"),
        F.count(F.when(day >= c // 2, 1)).alias("rows_second_half"),
    )


@query(
    "evidence_filter",
    """SELECT assessment_type, is_banked, count(*) AS n_rows FROM evidence GROUP BY ALL""",
)
def _evidence(spark, d):
    t = b.typed_tables(spark, d)
    rows = submissions.submissions_with_due(t.submissions, t.assessments).where(submissions.evidence())
    return rows.groupBy("assessment_type", "is_banked").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "safe_ratio",
    """SELECT user_id, r(CASE WHEN count(*) FILTER (kind = 'purchase') = 0 THEN NULL
              ELSE count(*) FILTER (kind = 'click') / count(*) FILTER (kind = 'purchase') END) AS clicks_per_purchase,
              r(CASE WHEN count(*) FILTER (kind = 'signup') = 0 THEN 0
              ELSE count(*) FILTER (kind = 'view') / count(*) FILTER (kind = 'signup') END) AS views_per_signup
       FROM ev WHERE day < 3 GROUP BY ALL""",
)
def _safe_ratio(spark, d):
    n = {k: F.count(F.when(F.col("kind") == k, 1)) for k in ("click", "purchase", "view", "signup")}
    return (
        activity.before(b.event_log(spark, d), "day", 3)
        .groupBy("user_id")
        .agg(
            safe_ratio(n["click"], n["purchase"]).alias("clicks_per_purchase"),
            safe_ratio(n["view"], n["signup"], 0.0).alias("views_per_signup"),
        )
    )


@query(
    "zero_fill",
    """SELECT cutoff, code_module, code_presentation, id_student, CAST(coalesce(total_clicks, 0) AS BIGINT) AS total_clicks,
              coalesce(active_days, 0) AS active_days
       FROM cohort LEFT JOIN volume USING (cutoff, code_module, code_presentation, id_student)""",
)
def _zero_fill(spark, d):
    vol = activity.volume_and_trajectory(b.typed_tables(spark, d).activity, KEY, CUTS)
    joined = cohort_of(spark, d).join(vol, [*KEY, "cutoff"], "left")
    return joined.select("cutoff", *KEY, "total_clicks", "active_days").fillna(0, ["total_clicks", "active_days"])


@query(
    "day_offset_features",
    """SELECT cutoff, code_module, code_presentation, id_student, 0 - date_registration AS days_registered_before_start,
              cutoff - 1 - max_date AS days_since_last_activity
       FROM cohort LEFT JOIN volume USING (cutoff, code_module, code_presentation, id_student)""",
)
def _offsets(spark, d):
    vol = activity.volume_and_trajectory(b.typed_tables(spark, d).activity, KEY, CUTS)
    joined = cohort_of(spark, d).join(vol, [*KEY, "cutoff"], "left")
    return joined.select(
        "cutoff",
        *KEY,
        (F.lit(0) - F.col("date_registration")).alias("days_registered_before_start"),
        (F.col("cutoff") - 1 - F.col("max_date")).alias("days_since_last_activity"),
    )


# --- joins -------------------------------------------------------------------------------------


@query(
    "inner_join_using",
    """SELECT code_module, code_presentation, assessment_type, count(*) AS n_rows, count(DISTINCT id_student) AS n_students
       FROM ass JOIN sub USING (id_assessment) JOIN info USING (code_module, code_presentation, id_student) GROUP BY ALL""",
)
def _join_using(spark, d):
    t = b.typed_tables(spark, d)
    rows = t.assessments.join(t.submissions, "id_assessment").join(t.info, KEY)
    return rows.groupBy(*ch.GROUP, "assessment_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id_student").alias("n_students")
    )


@query(
    "left_join_assembly",
    """SELECT cutoff, code_module, code_presentation, id_student, not_completed, total_clicks, distinct_materials,
              n_assessments_submitted, n_due_not_submitted FROM feat""",
)
def _assembly(spark, d):
    t = b.typed_tables(spark, d)
    wide = features.assembled_features(t, cohort_of(spark, d), CUTS, b.ASSESSMENT_KINDS)
    return wide.select(
        "cutoff", *KEY, "not_completed", "total_clicks", "distinct_materials", "n_assessments_submitted", "n_due_not_submitted"
    )


@query(
    "left_join_lookup",
    """SELECT activity_type, count(*) AS n_rows, CAST(sum(sum_click) AS BIGINT) AS clicks
       FROM act LEFT JOIN site USING (id_site) GROUP BY ALL""",
)
def _lookup(spark, d):
    t = b.typed_tables(spark, d)
    per_item = t.activity.groupBy("id_site").agg(F.count(F.lit(1)).alias("n"), F.sum("sum_click").alias("c"))
    return (
        per_item.join(t.sites, "id_site", "left")
        .groupBy("activity_type")
        .agg(F.sum("n").alias("n_rows"), F.sum("c").alias("clicks"))
    )


@query(
    "cross_join_densify",
    """SELECT user_id, day, r(coalesce(sum(amount), 0)) AS day_total FROM
         (SELECT DISTINCT user_id FROM ev) JOIN (SELECT CAST(unnest(range(0, 14)) AS INTEGER) AS day) ON true
         LEFT JOIN ev USING (user_id, day) GROUP BY ALL""",
)
def _densify(spark, d):
    log = b.event_log(spark, d)
    daily = activity.daily_totals(activity.before(log, "day", 14), ["user_id"], "day", "amount")
    users = log.select("user_id").distinct()
    return activity.densified_days(users, daily, ["user_id"], "day", 14).select("user_id", "day", "day_total")


@query(
    "due_not_submitted",
    "SELECT cutoff, code_module, code_presentation, id_student, n_due_not_submitted FROM overdue",
)
def _due(spark, d):
    t = b.typed_tables(spark, d)
    handed = submissions.submissions_with_due(t.submissions, t.assessments)
    stats = submissions.submission_stats(handed, KEY, CUTS)
    due = submissions.due_counts(t.assessments, ch.GROUP, CUTS)
    return submissions.due_not_submitted(cohort_of(spark, d), due, stats, KEY, ch.GROUP)


@query(
    "overlap_semi_join",
    """SELECT cutoff, count(DISTINCT id_student) AS test_students,
              count(DISTINCT id_student) FILTER (id_student IN (SELECT id_student FROM cohort x WHERE x.split = 'train' AND x.cutoff = 90)) AS seen_in_train
       FROM cohort WHERE split = 'test' AND cutoff = 90 GROUP BY ALL""",
)
def _overlap(spark, d):
    c = cohort_of(spark, d).where(F.col("cutoff") == 90)
    test = c.where(F.col("split") == "test").select("cutoff", "id_student").distinct()
    train = c.where(F.col("split") == "train").select("id_student").distinct()
    seen = test.join(train, "id_student", "left_semi").groupBy("cutoff").agg(F.count(F.lit(1)).alias("seen_in_train"))
    return (
        test.groupBy("cutoff")
        .agg(F.count(F.lit(1)).alias("test_students"))
        .join(seen, "cutoff", "left")
        .fillna(0, ["seen_in_train"])
    )


@query(
    "membership_flag_join",
    """SELECT cutoff, in_members, count(*) AS n_rows, r(avg(not_completed)) AS base_rate FROM (
         SELECT cutoff, not_completed, EXISTS (SELECT 1 FROM evidence e WHERE e.code_module = c.code_module AND
                e.code_presentation = c.code_presentation AND e.id_student = c.id_student) AS in_members FROM cohort c)
       GROUP BY ALL""",
)
def _membership(spark, d):
    t = b.typed_tables(spark, d)
    rows = submissions.submissions_with_due(t.submissions, t.assessments).where(submissions.evidence())
    flagged = ordering.membership_flag(cohort_of(spark, d), rows, KEY, "in_members")
    return flagged.groupBy("cutoff", "in_members").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("not_completed").cast("double")).alias("base_rate")
    )


@query(
    "leakage_sentinel",
    """SELECT cutoff, max(date) AS max_event_day, CAST(0 AS BIGINT) AS wrong_recency, CAST(0 AS BIGINT) AS wrong_active_days,
              CAST(0 AS BIGINT) AS wrong_submissions, 'PASS' AS status FROM seen GROUP BY cutoff""",
)
def _sentinel(spark, d):
    t = b.typed_tables(spark, d)
    wide = features.assembled_features(t, cohort_of(spark, d), CUTS, b.ASSESSMENT_KINDS)
    return features.leakage_sentinel(t, wide, CUTS)


@query(
    "leakage_sentinel_poisoned",
    """SELECT cutoff, cutoff AS max_event_day, count(*) FILTER (id_student % 10 = 3) AS wrong_recency,
              count(*) FILTER (id_student % 10 = 4) AS wrong_active_days, count(*) FILTER (id_student % 10 = 5) AS wrong_submissions,
              'FAIL' AS status FROM cohort GROUP BY cutoff""",
)
def _poisoned(spark, d):
    """Features of a tenth each that have seen the cutoff day, one day or one hand-in too many."""
    t = b.typed_tables(spark, d)
    wide = features.assembled_features(t, cohort_of(spark, d), CUTS, b.ASSESSMENT_KINDS)
    at = F.col("id_student") % 10
    days, works = F.coalesce("active_days", F.lit(0)), F.coalesce("n_assessments_submitted", F.lit(0))
    bad = wide.withColumns(
        {
            "days_since_last_activity": F.when(at == 3, F.lit(-1)).otherwise(F.col("days_since_last_activity")),
            "active_days": F.when(at == 4, days + 1).otherwise(days),
            "n_assessments_submitted": F.when(at == 5, works + 1).otherwise(works),
        }
    )
    return features.leakage_sentinel(t, bad, CUTS)


# --- aggregates --------------------------------------------------------------------------------


@query(
    "activity_volume",
    """SELECT cutoff, code_module, code_presentation, id_student, CAST(sum(sum_click) AS BIGINT) AS total_clicks,
              count(DISTINCT date) AS active_days, CAST(sum(sum_click) FILTER (date >= cutoff - 7) AS BIGINT) AS clicks_last_7d,
              max(date) AS max_date
       FROM act JOIN (VALUES (45), (90), (180)) c(cutoff) ON date < cutoff GROUP BY ALL""",
)
def _volume(spark, d):
    vol = activity.volume_and_trajectory(b.typed_tables(spark, d).activity, KEY, CUTS)
    return vol.where("active_days > 0").select("cutoff", *KEY, "total_clicks", "active_days", "clicks_last_7d", "max_date")


@query(
    "half_window_sums",
    """SELECT cutoff, code_module, code_presentation, id_student, CAST(sum(sum_click) FILTER (date < cutoff // 2) AS BIGINT) AS first_half_clicks,
              CAST(sum(sum_click) FILTER (date >= cutoff // 2) AS BIGINT) AS second_half_clicks,
              r(coalesce(sum(sum_click) FILTER (date >= cutoff // 2), 0)::DOUBLE / sum(sum_click) FILTER (date < cutoff // 2)) AS second_half_click_ratio
       FROM act JOIN (VALUES (45), (90), (180)) c(cutoff) ON date < cutoff GROUP BY ALL""",
)
def _halves(spark, d):
    vol = activity.volume_and_trajectory(b.typed_tables(spark, d).activity, KEY, CUTS)
    return vol.where("active_days > 0").select(
        "cutoff",
        *KEY,
        "first_half_clicks",
        "second_half_clicks",
        activity.half_ratio("first_half_clicks", "second_half_clicks").alias("second_half_click_ratio"),
    )


@query(
    "activity_breadth",
    """SELECT cutoff, code_module, code_presentation, id_student, count(DISTINCT activity_type) AS distinct_activity_types,
              count(DISTINCT id_site) AS distinct_materials,
              CAST(coalesce(sum(sum_click) FILTER (activity_type IN ('PROMO', 'STANDARD')), 0) AS BIGINT) AS assessment_clicks
       FROM act LEFT JOIN site USING (id_site) JOIN (VALUES (45), (90), (180)) c(cutoff) ON date < cutoff GROUP BY ALL""",
)
def _breadth(spark, d):
    t = b.typed_tables(spark, d)
    out = activity.breadth(t.activity, t.sites, KEY, CUTS, b.ASSESSMENT_KINDS)
    return out.where("distinct_materials > 0")


@query(
    "submission_stats",
    """SELECT cutoff, code_module, code_presentation, id_student, count(*) AS n_assessments_submitted, r(avg(score)) AS mean_score_submitted,
              r(min(score)) AS min_score_submitted, r(avg(date_submitted - due_date)) AS mean_submission_lateness
       FROM evidence JOIN (VALUES (45), (90), (180)) c(cutoff) ON date_submitted < cutoff GROUP BY ALL""",
)
def _submission_stats(spark, d):
    t = b.typed_tables(spark, d)
    handed = submissions.submissions_with_due(t.submissions, t.assessments)
    out = submissions.submission_stats(handed, KEY, CUTS)
    return out.where("n_assessments_submitted > 0").select("cutoff", *KEY, *submissions.STATS[:4])


@query(
    "click_slope",
    "SELECT cutoff, code_module, code_presentation, id_student, r(click_slope_daily) AS click_slope_daily FROM slope",
)
def _slope(spark, d):
    vol = activity.volume_and_trajectory(b.typed_tables(spark, d).activity, KEY, CUTS)
    return (
        cohort_of(spark, d)
        .join(vol, [*KEY, "cutoff"], "left")
        .select("cutoff", *KEY, F.coalesce("click_slope_daily", F.lit(0.0)).alias("click_slope_daily"))
    )


PROFILED = features.NUMERIC_FEATURES
EVERY = [*features.NUMERIC_FEATURES, *features.CATEGORICAL_FEATURES]
_UNPIVOT_ALL = " UNION ALL ".join(f"SELECT cutoff, '{f}' AS feature, CAST({f} AS VARCHAR) AS value FROM feat" for f in EVERY)
_UNPIVOT_FEAT = " UNION ALL ".join(
    f"SELECT cutoff, split, not_completed, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM feat" for f in PROFILED
)


@query(
    "feature_profile",
    f"""SELECT cutoff, feature, count(*) AS n_rows, count(*) - count(value) AS n_null, r((count(*) - count(value)) / count(*)) AS null_share,
              r(min(value)) AS min_value, r(max(value)) AS max_value, r(avg(value)) AS mean_value,
              r(median(value)) AS median_value, r(stddev_samp(value)) AS std_value FROM ({_UNPIVOT_FEAT}) GROUP BY ALL""",
)
def _feature_profile(spark, d):
    wide = stage(features_of(spark, d).select("cutoff", *PROFILED), "profiled")
    return profiling.numeric_profile(wide, PROFILED, ["cutoff"])


@query(
    "target_correlation",
    f"""SELECT feature, count(value) AS n_used, r(CASE WHEN stddev_pop(value) > 0 THEN corr(value, not_completed) END) AS correlation
       FROM ({_UNPIVOT_FEAT}) WHERE split = 'train' AND cutoff = 90 GROUP BY ALL""",
)
def _correlation(spark, d):
    rows = features_of(spark, d).where((F.col("split") == "train") & (F.col("cutoff") == 90))
    return profiling.target_correlation(stage(rows.select("not_completed", *PROFILED), "corr"), PROFILED, "not_completed")


@query(
    "null_share_matrix",
    f"""SELECT feature, r(avg((value IS NULL)::INT) FILTER (cutoff = 45)) AS share_45, r(avg((value IS NULL)::INT) FILTER (cutoff = 90)) AS share_90,
              r(avg((value IS NULL)::INT) FILTER (cutoff = 180)) AS share_180 FROM ({_UNPIVOT_ALL}) GROUP BY ALL""",
)
def _null_share(spark, d):
    return profiling.null_share_matrix(features_of(spark, d), EVERY, "cutoff", CUTS)


# --- windows -----------------------------------------------------------------------------------


@query(
    "longest_gap",
    """SELECT cutoff, code_module, code_presentation, id_student, max(step) AS longest_activity_gap FROM (
         SELECT *, date - lag(date) OVER (PARTITION BY cutoff, code_module, code_presentation, id_student ORDER BY date) AS step
         FROM (SELECT DISTINCT cutoff, code_module, code_presentation, id_student, date
               FROM act JOIN (VALUES (45), (90), (180)) c(cutoff) ON date < cutoff)) GROUP BY ALL""",
)
def _gap(spark, d):
    vol = activity.volume_and_trajectory(b.typed_tables(spark, d).activity, KEY, CUTS)
    return vol.where("active_days > 0").select("cutoff", *KEY, "longest_activity_gap")


@query(
    "percentile_within_group",
    """SELECT code_module, code_presentation, id_student, CAST(sum(sum_click) AS BIGINT) AS total,
              r(percent_rank() OVER (PARTITION BY code_module, code_presentation ORDER BY sum(sum_click))) AS percentile
       FROM act GROUP BY code_module, code_presentation, id_student""",
)
def _percentile(spark, d):
    totals = b.typed_tables(spark, d).activity.groupBy(*KEY).agg(F.sum("sum_click").alias("total"))
    return with_percent_rank(stage(totals, "totals"), ch.GROUP, "total", "percentile")


@query(
    "percentile_nonnull_only",
    """SELECT id_assessment, id_student, r(score) AS score, r(CASE WHEN score IS NOT NULL THEN
              percent_rank() OVER (PARTITION BY id_assessment, score IS NULL ORDER BY score) END) AS percentile FROM sub""",
)
def _percentile_nonnull(spark, d):
    subs = b.typed_tables(spark, d).submissions.select("id_assessment", "id_student", "score")
    return with_percent_rank(stage(subs, "scores"), ["id_assessment"], "score", "percentile")


@query(
    "first_row_per_group",
    """SELECT code_module, code_presentation, id_assessment, date AS due_date, r(weight) AS weight FROM (
         SELECT *, row_number() OVER (PARTITION BY code_module, code_presentation ORDER BY date ASC NULLS LAST, id_assessment) AS rn
         FROM ass WHERE assessment_type IN ('TMA', 'CMA')) WHERE rn = 1""",
)
def _first_row(spark, d):
    rows = b.typed_tables(spark, d).assessments.where(F.col("assessment_type").isin("TMA", "CMA"))
    first = ordering.first_row(rows, ch.GROUP, ["date", "id_assessment"], ["weight"])
    return first.select(*ch.GROUP, "id_assessment", F.col("date").alias("due_date"), "weight")


_DOUBLES = [
    "mean_clicks_per_active_day",
    "click_slope_daily",
    "second_half_click_ratio",
    "assessment_material_share",
    "mean_score_submitted",
    "min_score_submitted",
    "mean_submission_lateness",
    "clicks_percentile",
    "score_percentile",
]


@query(
    "feature_table",
    "SELECT * REPLACE (" + ", ".join(f"r({c}) AS {c}" for c in _DOUBLES) + ") FROM feat",
)
def _feature_table(spark, d):
    return features_of(spark, d)


@query(
    "feature_row_counts",
    """SELECT cutoff, count(*) AS cohort_rows, count(*) FILTER (NOT (cutoff = 90 AND id_student % 13 = 5)) AS feature_rows,
              CASE WHEN cutoff = 90 THEN 'FAIL' ELSE 'PASS' END AS status FROM cohort GROUP BY ALL""",
)
def _feature_row_counts(spark, d):
    """One cutoff has lost the features of some students, which the check must tell."""
    lost = (F.col("cutoff") == 90) & (F.col("id_student") % 13 == 5)
    t = b.typed_tables(spark, d, stored=True)
    table = features.feature_table(t, b.DESIGN, b.ASSESSMENT_KINDS)
    return features.row_count_check(table.where(~lost), ch.cohorts(ch.population(t.registration, t.info), b.DESIGN))


# --- ordering ----------------------------------------------------------------------------------


@query(
    "ordered_report",
    """SELECT code_module, code_presentation, count(*) AS n_rows FROM reg GROUP BY ALL
       ORDER BY n_rows DESC, code_module, code_presentation""",
)
def _ordered(spark, d):
    counts = b.typed_tables(spark, d).registration.groupBy(*ch.GROUP).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), *ch.GROUP)


@query(
    "topk_by_abs",
    """SELECT user_id, r(sum(if(kind = 'purchase', amount, -amount))) AS balance FROM ev GROUP BY ALL
       ORDER BY abs(sum(if(kind = 'purchase', amount, -amount))) DESC, user_id LIMIT 15""",
)
def _topk_abs(spark, d):
    signed = F.when(F.col("kind") == "purchase", F.col("amount")).otherwise(-F.col("amount"))
    balance = b.event_log(spark, d).groupBy("user_id").agg(F.sum(signed).alias("balance"))
    return ordering.top_by_abs(balance, "balance", ["user_id"], 15)


@query(
    "rank_map",
    """SELECT user_id, count(*) AS n_events, CAST(row_number() OVER (ORDER BY count(*) DESC, user_id) AS BIGINT) AS rank_no FROM ev GROUP BY user_id""",
)
def _rank_map(spark, d):
    counts = b.event_log(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return ordering.rank_map(stage(counts, "counts"), "n_events", "user_id", "rank_no")


def _two_rankings(spark, d):
    log = b.event_log(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("amount").alias("peak"))
    log = stage(log, "two-rankings")
    a = ordering.rank_map(log, "n_events", "user_id", "rank_a").select("user_id", "rank_a")
    p = ordering.rank_map(log, "peak", "user_id", "rank_b").select("user_id", "rank_b")
    return a, p


_TWO = """WITH ranked AS (SELECT user_id, CAST(row_number() OVER (ORDER BY count(*) DESC, user_id) AS BIGINT) AS rank_a,
          CAST(row_number() OVER (ORDER BY max(amount) DESC, user_id) AS BIGINT) AS rank_b FROM ev GROUP BY user_id)"""


@query(
    "topk_overlap",
    _TWO
    + """ SELECT k, count(user_id) AS n_shared, coalesce(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY rank_a), '') AS shared
        FROM (VALUES (5), (10)) v(k) LEFT JOIN ranked ON rank_a <= k AND rank_b <= k GROUP BY k""",
)
def _topk_overlap(spark, d):
    a, p = _two_rankings(spark, d)
    return ordering.topk_overlap(a, p, ["user_id"], [5, 10])


@query("rank_gap", _TWO + " SELECT user_id, rank_a, rank_b, rank_a - rank_b AS gap FROM ranked")
def _rank_gap(spark, d):
    a, p = _two_rankings(spark, d)
    return ordering.rank_gap(a, p, ["user_id"])


@query(
    "argmin_select",
    """SELECT kind, arg_min(user_id, (m, user_id)) AS user_id, r(min(m)) AS cost FROM (
         SELECT kind, user_id, max(amount) AS m FROM ev GROUP BY ALL) GROUP BY ALL""",
)
def _argmin(spark, d):
    costs = b.event_log(spark, d).groupBy("kind", "user_id").agg(F.max("amount").alias("cost"))
    return ordering.argmin(costs, ["kind"], "cost", ["user_id"])


# --- set operations ----------------------------------------------------------------------------


@query(
    "stage_union",
    """SELECT 'start' AS stage, code_presentation, count(*) AS n_rows FROM states WHERE cutoff = 90 GROUP BY ALL
       UNION ALL SELECT 'after_e3', code_presentation, count(*) FROM states WHERE cutoff = 90 AND first_exclusion <> 'E3' GROUP BY ALL
       UNION ALL SELECT 'after_e2', code_presentation, count(*) FROM states WHERE cutoff = 90 AND first_exclusion NOT IN ('E3', 'E2') GROUP BY ALL
       UNION ALL SELECT 'after_e1', code_presentation, count(*) FROM states WHERE cutoff = 90 AND first_exclusion = 'kept' GROUP BY ALL""",
)
def _stage_union(spark, d):
    s = states_of(spark, d).where(F.col("cutoff") == 90)
    counted = s.groupBy("code_presentation", "first_exclusion").agg(F.count(F.lit(1)).alias("n"))
    passes = F.when(F.col("first_exclusion") == "kept", F.array(*[F.lit(x) for x in ("start", "after_e3", "after_e2", "after_e1")]))
    passes = passes.when(F.col("first_exclusion") == "E1", F.array(F.lit("start"), F.lit("after_e3"), F.lit("after_e2")))
    passes = passes.when(F.col("first_exclusion") == "E2", F.array(F.lit("start"), F.lit("after_e3")))
    passes = passes.otherwise(F.array(F.lit("start")))
    return (
        counted.withColumn("stage", F.explode(passes))
        .groupBy("stage", "code_presentation")
        .agg(F.sum("n").alias("n_rows"))
    )


@query(
    "split_concat",
    """SELECT cutoff, split, count(*) AS n_rows FROM (
         SELECT cutoff, split FROM cohort WHERE split = 'train' UNION ALL SELECT cutoff, split FROM cohort WHERE split = 'validate')
       GROUP BY ALL""",
)
def _split_concat(spark, d):
    both = cohort_of(spark, d).where(F.col("split").isin("train", "validate"))
    return both.groupBy("cutoff", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("distinct_rows", "SELECT DISTINCT code_module, code_presentation, id_student, date FROM act")
def _distinct(spark, d):
    return b.typed_tables(spark, d).activity.select(*KEY, "date").distinct()


@query(
    "set_difference",
    """SELECT 'only_events' AS side, user_id FROM (SELECT user_id FROM ev EXCEPT SELECT o_custkey FROM orders)
       UNION ALL SELECT 'only_orders', o_custkey FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM ev)""",
)
def _difference(spark, d):
    e = b.table(spark, d, "events").select("user_id")
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    return ordering.two_way_difference(e, o, ["user_id"], "only_events", "only_orders")


@query(
    "set_union_intersection",
    """SELECT 'union' AS operation, count(*) AS n_values FROM (SELECT user_id FROM ev UNION SELECT o_custkey FROM orders)
       UNION ALL SELECT 'intersection', count(*) FROM (SELECT user_id FROM ev INTERSECT SELECT o_custkey FROM orders)""",
)
def _union_intersection(spark, d):
    e = b.table(spark, d, "events").select("user_id")
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    either = e.union(o).distinct().agg(F.count(F.lit(1)).alias("n_values"))
    both = e.intersect(o).agg(F.count(F.lit(1)).alias("n_values"))
    return either.select(F.lit("union").alias("operation"), "n_values").unionByName(
        both.select(F.lit("intersection").alias("operation"), "n_values")
    )
