"""Feature table: one row per unit before rows are copied per cutoff, orders read once."""

from cohortlens.operators import activity, submissions
from cohortlens.sources import bindings as b


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_copied_per_cutoff_only_when_a_unit_is_one_row(spark):
    log = spark.createDataFrame([(1, 0, 7, 2), (1, 4, 7, 3), (2, 6, 8, 1), (2, 6, None, None)], "k int, date int, id_site int, sum_click int")
    vol = activity.volume_and_trajectory(log, ["k"], [2, 5, 9])
    assert plan(vol).index("Generate") < plan(vol).index("Aggregate")
    got = {(r.k, r.cutoff): (r.total_clicks, r.active_days, r.max_date, r.longest_activity_gap) for r in vol.collect()}
    assert got == {(1, 2): (2, 1, 0, None), (1, 5): (5, 2, 4, 4), (1, 9): (5, 2, 4, 4), (2, 9): (1, 1, 6, None)}
    handed = spark.createDataFrame(
        [(1, 1, "TMA", 0, 3, 2, 8.0), (1, 2, "TMA", 0, 6, 9, None), (2, 1, "Exam", 0, 1, 1, 5.0)],
        "k int, id_assessment int, assessment_type string, is_banked int, date_submitted int, due_date int, score double",
    )
    stats = submissions.submission_stats(handed, ["k"], [4, 7])
    assert plan(stats).index("Generate") < plan(stats).index("Aggregate")
    assert {tuple(r) for r in stats.collect()} == {(1, 4, 1, 8.0, 8.0, 1.0, 1), (1, 7, 2, 8.0, 8.0, -1.0, 1)}


def test_lines_meet_orders_that_already_have_their_customer(spark, sf_dir):
    text = b.raw_tables(spark, sf_dir).student_vle._jdf.queryExecution().optimizedPlan().toString()
    deep = {t: len(line) - len(line.lstrip(" :+-")) for line in text.splitlines() for t in ("l_orderkey", "c_custkey") if "Relation" in line and t in line}
    assert deep["c_custkey"] > deep["l_orderkey"]


def test_stored_tables_read_the_orders_once(spark, sf_dir):
    t = b.typed_tables(spark, sf_dir, stored=True)
    for name in ("registration", "submissions", "assessments"):
        files = getattr(t, name).inputFiles()
        assert files and not any("orders.parquet" in f for f in files)
