"""Fixture bindings: the study's relations expressed over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.session import stage
from cohortlens.operators.cleaning import TableSet, typed_views
from cohortlens.operators.cohort import StudyDesign

# Fixed values
EVENT_ORIGIN = "2024-01-01"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# Years that the domain check expects; the last, partial one is left over for it to find.
EXPECTED_YEARS = ["1995", "1996", "1997", "1998", "1999", "2000"]
ASSESSMENT_KINDS = ["PROMO", "STANDARD"]
DESIGN = StudyDesign(
    splits={"train": ["1995", "1996", "1997", "1998"], "validate": ["1999"], "test": ["2000", "2001"]},
    cutoffs=(45, 90, 180),
)


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Test table with its declared schema, so no job runs just to read file footers."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (event_id, user_id, day, kind, amount)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "user_id",
        F.date_diff(F.to_date("ts"), F.lit(EVENT_ORIGIN).cast("date")).alias("day"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("amount"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with module, presentation, student and day."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("code_module"),
        F.year("o_orderdate").cast("string").alias("code_presentation"),
        F.col("o_custkey").alias("id_student"),
        (F.dayofyear("o_orderdate") - 1).alias("day"),
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


def _registered(t: DataFrame) -> DataFrame:
    last = F.max(F.struct("o_orderkey", "o_orderstatus"))
    return t.groupBy("code_module", "code_presentation", "id_student").agg(
        (F.min("day") - 30).alias("first_day"), F.max("day").alias("last_day"), last.alias("last")
    )


def student_registration(registered: DataFrame) -> DataFrame:
    gone = F.col("last.o_orderstatus") == "F"
    return registered.select(
        "code_module",
        "code_presentation",
        "id_student",
        F.col("first_day").cast("string").alias("date_registration"),
        F.when(gone, F.col("last_day").cast("string")).otherwise("?").alias("date_unregistration"),
    )


def student_info(spark: SparkSession, sf_dir: str, registered: DataFrame) -> DataFrame:
    status, even = F.col("last.o_orderstatus"), F.col("last.o_orderkey") % 2 == 0
    result = (
        F.when(status == "F", "Withdrawn")
        .when(status == "P", "Distinction")
        .otherwise(F.when(even, "Fail").otherwise("Pass"))
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    people = (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("id_student"), "c_acctbal", "c_nationkey", "r_name")
    )
    s = F.col("id_student")
    decile = F.least(F.lit(9), F.floor((F.col("c_acctbal") + 1000.0) / 1100.0).cast("int"))
    low, high = (decile * 10).cast("string"), (decile * 10 + 10).cast("string")
    band = F.concat(low, F.lit("-"), high, F.when(decile == 1, "").otherwise("%"))
    return (
        registered.join(people, "id_student")
        .select(
            "code_module",
            "code_presentation",
            "id_student",
            F.when(s % 2 == 0, "F").otherwise("M").alias("gender"),
            F.col("r_name").alias("region"),
            F.concat(F.lit("level "), (F.col("c_nationkey") % 4).cast("string")).alias("highest_education"),
            F.when(s % 29 == 0, "?").otherwise(band).alias("imd_band"),
            F.when(s % 3 == 0, "0-35").when(s % 3 == 1, "35-55").otherwise("55<=").alias("age_band"),
            (s % 4).cast("int").alias("num_of_prev_attempts"),
            ((s % 5 + 1) * 30).cast("int").alias("studied_credits"),
            F.when(s % 10 == 0, "Y").otherwise("N").alias("disability"),
            result.alias("final_result"),
        )
    )


def student_vle(spark: SparkSession, sf_dir: str, t: DataFrame) -> DataFrame:
    """Lines with the module and student of their order; orders meet customers before the many lines do."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    return li.join(t.select("o_orderkey", "code_module", "id_student"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "code_module",
        F.year("l_shipdate").cast("string").alias("code_presentation"),
        "id_student",
        F.col("l_partkey").alias("id_site"),
        (F.dayofyear("l_shipdate") - 1).alias("date"),
        F.col("l_quantity").cast("int").alias("sum_click"),
    )


def vle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id_site"), F.col("p_type").alias("activity_type")
    )


def _assessment_id(module: Column, year: Column, priority: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), module)
    return rank * 100000 + year.cast("int") * 10 + priority


def assessments(t: DataFrame) -> DataFrame:
    p = F.col("priority")
    kind = F.when(p <= 3, "TMA").when(p == 4, "CMA").otherwise("Exam")
    return (
        t.select("code_module", "code_presentation", "priority")
        .distinct()
        .select(
            "code_module",
            "code_presentation",
            _assessment_id(F.col("code_module"), F.col("code_presentation"), p).alias("id_assessment"),
            kind.alias("assessment_type"),
            F.when(p == 4, "?").otherwise((p * 60).cast("string")).alias("date"),
            (p * 10).cast("double").alias("weight"),
        )
    )


def student_assessment(t: DataFrame) -> DataFrame:
    first = F.min(F.struct("o_orderkey", "day", "o_totalprice"))
    rows = t.groupBy("code_module", "code_presentation", "id_student", "priority").agg(first.alias("f"))
    key, score = F.col("f.o_orderkey"), F.floor(F.col("f.o_totalprice") / 5000.0)
    return rows.select(
        _assessment_id(F.col("code_module"), F.col("code_presentation"), F.col("priority")).alias(
            "id_assessment"
        ),
        "id_student",
        F.col("f.day").alias("date_submitted"),
        F.when(key % 20 == 0, 1).otherwise(0).alias("is_banked"),
        F.when(key % 50 == 0, "?").otherwise(score.cast("string")).alias("score"),
    )


def courses(t: DataFrame) -> DataFrame:
    return t.select("code_module", "code_presentation").distinct().withColumn(
        "module_presentation_length", F.lit(366)
    )


def raw_tables(spark: SparkSession, sf_dir: str, stored: bool = False) -> TableSet:
    """The seven relations. ``stored`` writes out what several of them start from, for a caller that reads most of them."""
    t = terms(spark, sf_dir)
    t = stage(t, "terms") if stored else t
    registered = _registered(t)
    registered = stage(registered, "registered") if stored else registered
    return TableSet(
        student_info=lambda: student_info(spark, sf_dir, registered),
        student_registration=lambda: student_registration(registered),
        student_assessment=lambda: student_assessment(t),
        assessments=lambda: assessments(t),
        courses=lambda: courses(t),
        vle=lambda: vle(spark, sf_dir),
        student_vle=lambda: student_vle(spark, sf_dir, t),
    )


def typed_tables(spark: SparkSession, sf_dir: str, stored: bool = False) -> TableSet:
    return typed_views(raw_tables(spark, sf_dir, stored))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scored table from events: two rungs, days before 15 validate, later days test.

    ``band`` is NULL for some users and serves as a slice column.
    """
    e = event_log(spark, sf_dir)
    v = F.col("amount")
    rungs = F.array(
        F.struct(F.lit("R1").alias("rung"), (v / (v + 50.0)).alias("p")),
        F.struct(
            F.lit("R2").alias("rung"), ((F.col("event_id") % 101).cast("double") / 101.0).alias("p")
        ),
    )
    return e.select(
        "event_id",
        "user_id",
        "day",
        F.when(F.col("day") < 15, "validate").otherwise("test").alias("split"),
        F.when(F.col("kind") == "error", 1).otherwise(0).alias("y"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string"))).alias(
            "band"
        ),
        F.concat(F.lit("w"), F.floor(F.col("day") / 7).cast("string")).alias("week"),
        F.explode(rungs).alias("r"),
    ).select("event_id", "user_id", "day", "split", "y", "band", "week", "r.rung", "r.p")


def scored_by_cutoff(spark: SparkSession, sf_dir: str, cutoffs=(14, 28)) -> DataFrame:
    """The scored rows once per cutoff, with scores that depend on the cutoff."""
    e = event_log(spark, sf_dir)
    v, d = F.col("amount"), F.col("cutoff")
    rungs = F.array(
        F.struct(F.lit("R1").alias("rung"), (v / (v + 36.0 + d)).alias("p")),
        F.struct(
            F.lit("R2").alias("rung"), ((F.col("event_id") * d % 101).cast("double") / 101.0).alias("p")
        ),
    )
    return (
        e.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
        .select(
            "cutoff",
            "event_id",
            "user_id",
            F.when(F.col("day") < 15, "validate").otherwise("test").alias("split"),
            F.when(F.col("kind") == "error", 1).otherwise(0).alias("y"),
            F.explode(rungs).alias("r"),
        )
        .select("cutoff", "event_id", "user_id", "split", "y", "r.rung", "r.p")
    )


def drift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with part type, split by ship year: up to 1998 train, 1999 validate, later test.

    One part type is renamed in train, so one category is empty there and one in test.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    year = F.year("l_shipdate")
    split = F.when(year <= 1998, "train").when(year == 1999, "validate").when(year >= 2000, "test")
    return (
        li.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("split", split)
        .where(F.col("split").isNotNull())
        .select(
            "split",
            "l_quantity",
            "l_extendedprice",
            F.when(F.col("l_tax") != 0.05, F.col("l_discount")).alias("l_discount"),
            F.col("p_size").cast("double").alias("p_size"),
            "l_returnflag",
            F.when(F.col("l_quantity") != 13, F.col("l_linestatus")).alias("l_linestatus"),
            F.when((F.col("split") == "train") & (F.col("p_type") == "PROMO"), "OTHER")
            .otherwise(F.col("p_type"))
            .alias("p_type"),
        )
    )


def running_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as (x, y, covariates) for the discontinuity operators."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_quantity").alias("x"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        "l_discount",
        F.col("l_tax").alias("l_tax"),
        F.when(F.col("l_discount") != 0.03, F.col("l_linestatus")).alias("l_linestatus"),
        F.year("l_shipdate").alias("ship_year"),
    )
