"""Corpus pipeline: each stage calls one operator of ``cohortlens.llm`` on all its predecessor kept.

The columns of documents pass through every stage, extra ones too; the last stage adds what the mix says
about a document. Ids that are NULL are never dropped by a decision on ids. Ids to drop are written out first, so
Spark knows their real size when it chooses between a broadcast and dealing out the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.session import stage
from cohortlens.llm.decontamination import decontaminate
from cohortlens.llm.language_id import UNDETERMINED, fit_languages, is_held_out, predict_languages
from cohortlens.llm.naming import named
from cohortlens.llm.near_duplicates import near_duplicates
from cohortlens.llm.queries import mixed, without_repeated_lines

#: A language prediction below this posterior probability is no prediction.
MIN_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. The ``lang`` column stays what it was."""
    model = fit_languages(docs.where(~is_held_out()))
    told = predict_languages(docs, model, keep={"row": F.struct(*map(named, docs.columns))})
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select("row.*")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those with no word left but for such lines go."""
    cut = without_repeated_lines(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*map(named, docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    gone = stage(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*map(named, docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark passages."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stage(found.where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(*map(named, docs.columns))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the mix, with their topic, tokens, probability and weight."""
    drawn = mixed(docs, row=F.struct(*map(named, docs.columns))).where("kept")
    added = [c for c in ("topic", "n_tokens", "probability", "weight") if c not in docs.columns]
    return drawn.select("row.*", *added)


STAGES = [
    ("language", known_language),
    ("lines", without_boilerplate),
    ("near_duplicates", one_of_each),
    ("benchmark", without_benchmark),
    ("mix", to_target_weights),
]

#: Language prediction and register sketches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
