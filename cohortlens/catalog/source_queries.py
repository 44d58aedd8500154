"""Source and sink queries: files of the data folder, tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.cohort_queries import KEY, cohort_of
from cohortlens.catalog.evaluation_queries import _CUT_TABLE, _POLICY, cut_policy
from cohortlens.catalog.registry import query
from cohortlens.functions.session import stage, staging_path
from cohortlens.sources import bindings as b
from cohortlens.sources import files, guards

CONCEPTS = {
    name: name
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations"
    ).split()
}


@query("source_manifest_check")
def _manifest(spark, d):
    """Problems of the folder when two concepts are expected under other names: 2 unknown, 2 missing."""
    found = files.listing(spark, d, "*.parquet")
    files.require_manifest(found, CONCEPTS)
    renamed = {k: v for k, v in CONCEPTS.items() if k not in ("pages", "labels")}
    return files.manifest_check(found, renamed | {"page": "pages", "label": "labels"})


@query("source_checksum")
def _checksum(spark, d):
    return files.checksums(spark, d, "*.parquet")


@query("row_checksum")
def _row_checksum(spark, d):
    return files.row_checksums(b.table(spark, d, "lineitem"))


@query("checksum_verify")
def _verify(spark, d):
    current = stage(files.checksums(spark, d, "*.parquet"), "digests")
    path = staging_path(spark, "manifest")
    files.check_or_record(current, path)
    return files.check_or_record(current, path)


@query("csv_scan", "SELECT id_assessment, id_student, date_submitted, is_banked, score FROM sub_raw")
def _csv(spark, d):
    raw = b.raw_tables(spark, d).student_assessment
    path = staging_path(spark, "student_assessment")
    files.write_csv(raw, path)
    schema = "id_assessment bigint, id_student bigint, date_submitted int, is_banked int, score string"
    return files.read_csv(spark, path, schema)


@query(
    "table_overwrite",
    "SELECT cutoff, code_module, code_presentation, id_student, not_completed, split FROM cohort WHERE cutoff = 90",
)
def _overwrite(spark, d):
    rows = cohort_of(spark, d).select("cutoff", *KEY, "not_completed", "split")
    path = staging_path(spark, "cohort")
    files.overwrite_table(rows.where(F.col("cutoff") == 45), path, ["cutoff"])
    return files.overwrite_table(rows, path, ["cutoff"]).where(F.col("cutoff") == 90)


def _stored_cohort(spark, d):
    return stage(cohort_of(spark, d).select("cutoff", *KEY, "not_completed", "split"), "cohort")


@query(
    "split_guard_scan",
    "SELECT cutoff, code_module, code_presentation, id_student, not_completed, split FROM cohort WHERE split IN ('train', 'validate')",
)
def _guarded(spark, d):
    return guards.load_split(_stored_cohort(spark, d), ["train", "validate"])


@query(
    "holdout_scan",
    "SELECT cutoff, code_module, code_presentation, id_student, not_completed, split FROM cohort WHERE split = 'test'",
)
def _holdout(spark, d):
    return guards.open_holdout(_stored_cohort(spark, d), "one-time evaluation")


@query(
    "predictions_parquet",
    "SELECT cutoff, rung, event_id, y, r(p) AS p FROM scored_cut WHERE cutoff = 28 AND split = 'test'",
)
def _predictions(spark, d):
    rows = b.scored_by_cutoff(spark, d).where(F.col("split") == "test")
    path = staging_path(spark, "predictions")
    files.write_predictions(rows.select("cutoff", "rung", "event_id", "y", "p"), path)
    return files.read_predictions(spark, path, 28)


@query(
    "policy_json",
    f"""WITH {_CUT_TABLE}, {_POLICY} SELECT cutoff, rung, r(threshold) AS threshold, r(validate_cost) AS validate_cost, r(10) AS ratio FROM policy""",
)
def _policy_json(spark, d):
    frozen = cut_policy(spark, d).withColumn("params", F.create_map(F.lit("ratio"), F.lit(10.0)))
    path = staging_path(spark, "policy")
    files.write_policy(frozen, path)
    back = files.read_policy(spark, path)
    return back.select("cutoff", "rung", "threshold", "validate_cost", F.col("params")["ratio"].alias("ratio"))


@query(
    "sample_export",
    """SELECT code_module, code_presentation, id_student, date_registration FROM reg
       ORDER BY md5('42:' || code_module || ':' || code_presentation || ':' || id_student), code_module, code_presentation, id_student LIMIT 20""",
)
def _sample(spark, d):
    rows = b.typed_tables(spark, d).registration.select(*KEY, "date_registration")
    path = staging_path(spark, "sample")
    files.write_csv(files.sample_rows(rows, KEY, 20, 42), path)
    schema = "code_module string, code_presentation string, id_student bigint, date_registration int"
    return files.read_csv(spark, path, schema)
