"""Edge cases on hand-made rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.scalars import sentinel_to_null, tolerant_numeric
from cohortlens.operators import activity, cleaning, features, profiling, submissions
from cohortlens.operators import cohort as ch
from cohortlens.operators import scoring as sc
from cohortlens.operators.drift import categorical_bins, numeric_bins, psi_band, psi_categorical, psi_numeric
from cohortlens.operators.prep import fit_design
from cohortlens.plans.ladder import best_iteration
from cohortlens.sources import files, guards

KEY = ["k"]


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_placeholder_is_null_and_junk_is_an_error(spark):
    df = spark.createDataFrame([("?",), ("7",), (None,)], "v string")
    assert [r[0] for r in df.select(sentinel_to_null("v", "int")).collect()] == [None, 7, None]
    junk = spark.createDataFrame([("x",)], "v string")
    assert junk.select(tolerant_numeric("v")).first()[0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        junk.select(sentinel_to_null("v", "int")).collect()


def test_exclusions_on_and_around_the_cutoff(spark):
    data = [
        (1, None, None, "E3"),
        (2, 28, None, "kept"),
        (3, 29, None, "E2"),
        (4, 0, 27, "E1"),
        (5, 0, 28, "kept"),
        (6, 29, 3, "E2"),
        (7, None, 3, "E3"),
    ]
    df = spark.createDataFrame(data, "id int, date_registration int, date_unregistration int, want string")
    got = df.withColumn("got", ch.first_exclusion(F.lit(28)))
    assert got.where("got != want").count() == 0


def test_unexpected_value_and_null_label_are_errors(spark):
    df = spark.createDataFrame([("Pass",), ("Maybe",), (None,)], "final_result string")
    found = rows(cleaning.unexpected_values(df, "final_result", ["Pass"]).fillna("-"))
    assert found == [("-", 1), ("Maybe", 1)]
    with pytest.raises(ValueError, match="Maybe"):
        cleaning.require_domain(df, "final_result", ["Pass"])
    with pytest.raises(ValueError, match="label"):
        cleaning.require_not_null(df.withColumn("label", ch.target_label("final_result")), ["label"])


ACTIVITY = [
    ("a", -5, 1, 4),
    ("a", 0, 1, 2),
    ("a", 0, 2, 1),
    ("a", 9, 1, 3),
    ("a", 10, 1, 99),
    ("b", 3, 3, 5),
    ("c", 7, 9, 6),
    ("d", 10, 1, 1),
]


def test_volume_counts_only_rows_before_the_cutoff(spark):
    log = spark.createDataFrame(ACTIVITY, "k string, date int, id_site int, sum_click int")
    got = {r["k"]: r for r in activity.volume_and_trajectory(log, KEY, [10]).collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a["total_clicks"], a["active_days"], a["max_date"], a["longest_activity_gap"]) == (10, 3, 9, 9)
    assert (a["clicks_last_7d"], a["first_half_clicks"], a["second_half_clicks"]) == (3, 3, 3)
    assert got["b"]["longest_activity_gap"] is None
    assert got["c"]["first_half_clicks"] is None
    days = {0: 3, 9: 3}
    mean = sum(days.values()) / 10
    slope = sum((d - 4.5) * (days.get(d, 0) - mean) for d in range(10)) / sum((d - 4.5) ** 2 for d in range(10))
    assert math.isclose(a["click_slope_daily"], slope, abs_tol=1e-12)


def test_breadth_with_unknown_site(spark):
    log = spark.createDataFrame(ACTIVITY, "k string, date int, id_site int, sum_click int")
    sites = spark.createDataFrame([(1, "quiz"), (2, "page"), (3, "quiz")], "id_site int, activity_type string")
    got = {(r["k"], r["cutoff"]): r for r in activity.breadth(log, sites, KEY, [5, 10], ["quiz"]).collect()}
    a5, a10 = got["a", 5], got["a", 10]
    assert (a5["distinct_activity_types"], a5["distinct_materials"], a5["assessment_clicks"]) == (2, 2, 6)
    assert (a10["distinct_activity_types"], a10["distinct_materials"], a10["assessment_clicks"]) == (2, 2, 9)
    c = got["c", 10]
    assert (c["distinct_activity_types"], c["distinct_materials"], c["assessment_clicks"]) == (0, 1, 0)


def test_submissions_exam_banked_null_score_and_null_due(spark):
    ass = spark.createDataFrame(
        [("m", "p", 1, "TMA", 5), ("m", "p", 2, "CMA", None), ("m", "p", 3, "Exam", 4), ("m", "p", 4, "TMA", 8), ("m", "p", 5, "TMA", 20)],
        "code_module string, code_presentation string, id_assessment int, assessment_type string, date int",
    )
    sub = spark.createDataFrame(
        [
            (1, 1, 6, 0, 50.0),  # one day late
            (2, 1, 7, 0, None),  # no due day, no score
            (3, 1, 2, 0, 90.0),  # exam
            (1, 2, 1, 1, 80.0),  # carried over
            (5, 3, 9, 0, 70.0),  # due after the cutoff, handed in before
            (4, 3, 10, 0, 60.0),  # handed in on the cutoff day
            (9, 4, 1, 0, 10.0),  # unknown assessment
        ],
        "id_assessment int, id_student int, date_submitted int, is_banked int, score double",
    )
    key = ["code_module", "code_presentation", "id_student"]
    handed = submissions.submissions_with_due(sub, ass)
    stats = submissions.submission_stats(handed, key, [10])
    got = {r["id_student"]: r for r in stats.collect()}
    assert set(got) == {1, 3}
    one = got[1]
    assert (one["n_assessments_submitted"], one["mean_score_submitted"], one["mean_submission_lateness"]) == (2, 50.0, 1.0)
    assert (got[3]["n_assessments_submitted"], got[3]["mean_submission_lateness"]) == (1, -11.0)
    cohort = spark.createDataFrame([(10, "m", "p", i) for i in (1, 2, 3)], "cutoff int, code_module string, code_presentation string, id_student int")
    due = submissions.due_counts(ass, key[:2], [10])
    left = submissions.due_not_submitted(cohort, due, stats, key, key[:2])
    assert rows(left, "id_student", "n_due_not_submitted") == [(1, 1), (2, 2), (3, 2)]


def study(spark, extra=()):
    c = spark.createDataFrame
    activity_rows = [("m", "p", 1, 1, 2, 5), ("m", "p", 1, 2, 9, 1), ("m", "p", 2, 1, 4, 3), *extra]
    raw = cleaning.TableSet(
        student_info=lambda: c(
            [("m", "p", i, "F", "r", "e", "?", "a", 0, 30, "N", res) for i, res in ((1, "Pass"), (2, "Fail"), (3, "Withdrawn"))],
            "code_module string, code_presentation string, id_student int, gender string, region string, highest_education string, "
            "imd_band string, age_band string, num_of_prev_attempts int, studied_credits int, disability string, final_result string",
        ),
        student_registration=lambda: c(
            [("m", "p", 1, "-3", "?"), ("m", "p", 2, "0", "?"), ("m", "p", 3, "1", "?")],
            "code_module string, code_presentation string, id_student int, date_registration string, date_unregistration string",
        ),
        student_assessment=lambda: c([(1, 1, 4, 0, "50")], "id_assessment int, id_student int, date_submitted int, is_banked int, score string"),
        assessments=lambda: c(
            [("m", "p", 1, "TMA", "5", 10.0)],
            "code_module string, code_presentation string, id_assessment int, assessment_type string, date string, weight double",
        ),
        courses=lambda: c([("m", "p", 100)], "code_module string, code_presentation string, module_presentation_length int"),
        vle=lambda: c([(1, "quiz"), (2, "page")], "id_site int, activity_type string"),
        student_vle=lambda: c(
            activity_rows,
            "code_module string, code_presentation string, id_student int, id_site int, date int, sum_click int",
        ),
    )
    design = ch.StudyDesign(splits={"train": ["p"], "validate": [], "test": []}, cutoffs=(6, 10))
    return cleaning.typed_views(raw), design


def test_feature_table_keeps_silent_rows_and_ignores_later_rows(spark):
    table = features.feature_table(*study(spark))
    assert table.count() == 6
    silent = table.where("id_student = 3 AND cutoff = 10").first()
    assert (silent["total_clicks"], silent["mean_clicks_per_active_day"], silent["assessment_material_share"]) == (0, None, 0.0)
    assert (silent["click_slope_daily"], silent["score_percentile"], silent["clicks_percentile"]) == (0.0, None, 0.0)
    assert silent["imd_band"] is None
    late = [("m", "p", 1, 1, 6, 50), ("m", "p", 2, 2, 30, 70), ("m", "p", 3, 1, 6, 9)]
    again = features.feature_table(*study(spark, late))
    at6 = [r for r in rows(table.where("cutoff = 6").fillna(-1).fillna("-"))]
    assert at6 == [r for r in rows(again.where("cutoff = 6").fillna(-1).fillna("-"))]


def scored(spark, pairs):
    data = [("g", i, y, float(p)) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(data, "g string, id int, y int, p double")


def test_constant_score_and_single_class(spark):
    df = scored(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)])
    m = sc.ranking_metrics(sc.score_ladder(df, ["g"]), ["g"]).first()
    assert (m["auc_pr"], m["auc_roc"], m["base_rate"]) == (0.25, 0.5, 0.25)
    one = sc.ranking_metrics(sc.score_ladder(scored(spark, [(1, 0.1), (1, 0.9)]), ["g"]), ["g"]).first()
    assert one["auc_pr"] is None and one["auc_roc"] is None and math.isclose(one["brier"], (0.81 + 0.01) / 2)


def test_threshold_equal_to_score_flags_and_first_minimum_wins(spark):
    table = sc.confusion_by_threshold(scored(spark, [(1, 0.3), (0, 0.29), (0, 0.01), (1, 1.0)]), ["g"])
    got = {round(r["threshold"], 2): (r["fn"], r["fp"]) for r in table.collect()}
    assert len(got) == 99 and got[0.3] == (0, 0) and got[0.31] == (1, 0) and got[0.29] == (0, 1) and got[0.01] == (0, 2)
    best = sc.best_threshold(table, ["g"]).first()
    assert (best["threshold"], best["expected_cost"]) == (0.3, 0.0)


def test_calibration_edges(spark):
    bins = sc.calibration(scored(spark, [(0, 0.0), (0, 0.1), (1, 1.0), (1, 0.95)]), ["g"])
    assert {r["bin"]: r["n"] for r in bins.collect()} == {0: 1, 1: 1, **{i: 0 for i in range(2, 9)}, 9: 2}


def test_budget_size_rounds_half_to_even_and_takes_at_least_one(spark):
    for n, budget, k in ((5, 0.1, 1), (25, 0.1, 2), (35, 0.1, 4), (3, 0.05, 1)):
        df = scored(spark, [(i % 2, i / n) for i in range(n)])
        assert sc.recall_at_budgets(df, ["g"], ["id"], [budget]).first()["k"] == k


def test_recall_never_exceeds_its_ceiling_with_ties(spark):
    df = scored(spark, [(int(i % 3 == 0), 0.5) for i in range(60)])
    for r in sc.recall_at_budgets(df, ["g"], ["id"]).collect():
        assert 0 <= r["recall"] <= r["ceiling"] + 1e-12


def test_psi_of_equal_samples_one_sided_bins_and_constants(spark):
    same = [("train", float(v), "x") for v in range(100)] + [("test", float(v), "x") for v in range(100)]
    df = spark.createDataFrame(same, "split string, v double, c string")
    r = psi_numeric(numeric_bins(df, ["v"])).first()
    assert (r["psi"], r["n_bins_used"], r["empty_bins"], r["degenerate"]) == (0.0, 10, 0, False)
    flat = spark.createDataFrame([("train", 1.0, "x"), ("train", 1.0, "x"), ("test", 9.0, None)], "split string, v double, c string")
    r = psi_numeric(numeric_bins(flat, ["v"])).first()
    assert (r["psi"], r["n_bins_used"], r["degenerate"]) == (0.0, 1, True)
    r = psi_categorical(categorical_bins(flat, ["c"])).first()
    expect = (1e-4 - 1) * math.log(1e-4) + (1 - 1e-4) * math.log(1 / 1e-4)
    assert r["empty_bins"] == 2 and math.isclose(r["psi"], expect)
    bands = spark.createDataFrame([(0.0999,), (0.1,), (0.25,), (0.2501,)], "psi double").select(psi_band("psi"))
    assert [x[0] for x in bands.collect()] == ["stable", "moderate", "moderate", "significant"]


def test_design_constant_column_late_nulls_and_unseen_level(spark):
    fit = spark.createDataFrame([(1.0, None, "a"), (1.0, 2.0, None), (1.0, 4.0, "b")], "u double, v double, c string")
    new = spark.createDataFrame([(None, 3.0, "z")], "u double, v double, c string")
    d = fit_design(fit, ["u", "v"], ["c"])
    assert d.columns == ["u", "v", "was_missing_v", "c____NULL__", "c__a", "c__b"]
    assert d.std["u"] == 1.0 and d.median["v"] == 3.0 and d.mean["v"] == 3.0
    assert tuple(d.apply(new, []).first()) == (0.0, 0.0, 0, 0, 0, 0)


def test_missing_correlation_for_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 0, 1.0), (1.0, 1, 2.0)], "a double, y int, b double")
    got = {r["feature"]: r["correlation"] for r in profiling.target_correlation(df, ["a", "b"], "y").collect()}
    assert got["a"] is None and math.isclose(got["b"], 1.0)


def test_early_stopping_rule():
    assert best_iteration([3, 2, 1, 1.5, 1.4, 0.1], 2) == 3
    assert best_iteration([3, 2, 1, 1.5, 0.1], 2) == 5
    assert best_iteration([1, 2, 3], 50) == 1


def test_split_guards(spark):
    df = spark.createDataFrame([("train",), ("test",)], "split string")
    assert guards.load_split(df, ["train"]).count() == 1
    for bad in (["test"], ["train", "test"]):
        with pytest.raises(guards.HoldoutError):
            guards.load_split(df, bad)
    for bad in ([], ["dev"]):
        with pytest.raises(ValueError):
            guards.load_split(df, bad)
    with pytest.raises(guards.HoldoutError):
        guards.open_holdout(df, " ")
    assert guards.open_holdout(df, "final scoring").count() == 1


def test_manifest_and_checksums(spark, tmp_path):
    expected = {"courses": "courses", "sites": "vle", "vle": "vle"}
    (tmp_path / "Courses.csv").write_text("a\n1\n")
    (tmp_path / "sites.csv").write_text("b\n")
    folder = str(tmp_path)
    files.require_manifest(files.listing(spark, folder), expected)
    before = files.checksums(spark, folder).collect()
    recorded = spark.createDataFrame(before)
    (tmp_path / "vle.csv").write_text("c\n")
    (tmp_path / "other.csv").write_text("d\n")
    (tmp_path / "Courses.csv").write_text("a\n2\n")
    problems = rows(files.manifest_check(files.listing(spark, folder), expected))
    assert problems == [("several files for concept", "vle"), ("unknown file", "other.csv")]
    checked = files.verify_checksums(files.checksums(spark, folder), recorded)
    assert dict(rows(checked, "file", "status")) == {
        "Courses.csv": "changed",
        "sites.csv": "ok",
        "vle.csv": "not recorded",
        "other.csv": "not recorded",
    }


def test_a_folder_of_part_files_is_one_table_of_the_manifest(spark, tmp_path):
    for name, size in {"courses.csv": 3, "vle.csv/part-0.csv": 5, "vle.csv/part-1.csv": 7, "notes/part-0.csv": 9, "vle.txt": 2}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    found = files.listing(spark, str(tmp_path), "*.csv")
    assert rows(found, "file", "stem", "bytes") == [("courses.csv", "courses", 3), ("vle.csv", "vle", 12)]
    files.require_manifest(found, {"courses": "courses", "vle": "vle"})
    assert rows(files.listing(spark, str(tmp_path), "{notes,vle.t?t}"), "file", "bytes") == [("notes", 9), ("vle.txt", 2)]


def test_changed_file_is_an_error(spark, tmp_path):
    data, manifest = tmp_path / "in", str(tmp_path / "manifest")
    data.mkdir()
    (data / "x.csv").write_text("1\n")
    files.check_or_record(files.checksums(spark, str(data)), manifest)
    (data / "x.csv").write_text("2\n")
    with pytest.raises(ValueError, match="x.csv: changed"):
        files.check_or_record(files.checksums(spark, str(data)), manifest)


@pytest.fixture
def planted_files(tmp_path):
    """Files of no, one and several parts of 1,000 bytes, and two of one name in two folders."""
    sizes = {"none.bin": 0, "one.bin": 1000, "more.bin": 1001, "sub/part-0.bin": 5300, "other/part-0.bin": 5300}
    for i, (name, size) in enumerate(sizes.items()):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(bytes((i + j * j) % 251 for j in range(size)))
    return tmp_path


def tree(content, size):
    parts = [hashlib.sha256(content[i : i + size]).hexdigest() for i in range(0, max(len(content), 1), size)]
    return parts[0] if len(parts) == 1 else f"tree-{size}:" + hashlib.sha256("\n".join(parts).encode()).hexdigest()


def test_digests_of_files_over_the_part_size(spark, planted_files):
    got = {r["file"]: (r["bytes"], r["sha256"]) for r in files.checksums(spark, str(planted_files), "*.bin", 1000).collect()}
    names = ["one.bin", "more.bin", "sub/part-0.bin", "other/part-0.bin"]
    contents = {n: (planted_files / n).read_bytes() for n in names}
    assert got == {n: (len(c), tree(c, 1000)) for n, c in contents.items()}
    plain = {r["file"]: r["sha256"] for r in files.checksums(spark, str(planted_files), "*.bin").collect()}
    assert plain == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}


def test_one_changed_byte_of_a_large_file_is_found(spark, planted_files, tmp_path_factory):
    manifest = str(tmp_path_factory.mktemp("manifest") / "digests.json")
    now = lambda: files.checksums(spark, str(planted_files), "*.bin", 1000)
    files.check_or_record(now(), manifest)
    assert {r["status"] for r in files.check_or_record(now(), manifest).collect()} == {"ok"}
    target = planted_files / "sub" / "part-0.bin"
    content = bytearray(target.read_bytes())
    content[4321] ^= 1
    target.write_bytes(bytes(content))
    (planted_files / "one.bin").write_bytes(b"")
    with pytest.raises(ValueError, match="sub/part-0.bin: changed") as wrong:
        files.check_or_record(now(), manifest)
    assert "one.bin: gone" in str(wrong.value) and "more.bin" not in str(wrong.value)


def test_each_part_is_read_once_and_by_its_bytes_only(spark, planted_files):
    seen = spark.sparkContext.accumulator(0)

    def opener(path):
        source = files.open_path(path)

        class Counted:
            seek, close = source.seek, source.close

            def read(self, n):
                got = source.read(n)
                seen.add(len(got))
                return got

        return Counted()

    files.checksums(spark, str(planted_files), "*.bin", 1000, opener).write.format("noop").mode("overwrite").save()
    assert seen.value == 1000 + 1001 + 2 * 5300
