"""The queries ``opN_<name>`` over the given tables; DuckDB SQL for them is in :mod:`oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import chat_format, oracles
from cohortlens.llm.collocations import collocations
from cohortlens.llm.decontamination import decontaminate
from cohortlens.llm.language_id import identify_languages
from cohortlens.llm.line_spread import dedup_lines
from cohortlens.llm.mixing import mix_to_targets
from cohortlens.llm.near_duplicates import near_duplicates
from cohortlens.llm.main_text import main_text
from cohortlens.llm.personal_data import count_of, joined, personal_data
from cohortlens.llm.personal_data import BASE_KINDS as PERSONAL_KINDS
from cohortlens.llm.quality_cascade import quality_cascade
from cohortlens.llm.ranked_search import ranked_search
from cohortlens.llm.secrets import BASE_KINDS as SECRET_KINDS
from cohortlens.llm.secrets import find_secrets
from cohortlens.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(personal_data(table(spark, sf_dir, "documents")), PERSONAL_KINDS)


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(find_secrets(table(spark, sf_dir, "documents")), SECRET_KINDS)


@query
def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents"))


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


#: A line of 50 or more words is boilerplate on so many sites or in so many documents, whatever their sites.
LONG_SITES, LONG_DOCS = 3, 4


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs, long_sites=LONG_SITES, long_docs=LONG_DOCS, one_word=True)


@query
def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on ten or more of the sites (``source``), long ones by less, stay at their first place only."""
    left = without_repeated_lines(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def topic() -> Column:
    """Topic of a document by its first telling mark."""
    text = F.col("text")
    return (
        F.when(text.rlike("(?i)licensed under|released under|all rights reserved"), "licence")
        .when(text.contains(" | "), "table")
        .when(text.rlike(r"###|\*\*\*|\$\$\$|%%%|&&&"), "symbols")
        .when(text.contains("!!"), "shouting")
        .when(text.contains("@"), "contact")
        .otherwise("prose")
    )


def mixed(docs: DataFrame, **carry: Column) -> DataFrame:
    """Half of all tokens, with source and topic shares flattened and languages more so."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic()}
    return mix_to_targets(docs, dims, {"source": 0.5, "lang": 0.3, "topic": 0.5}, 0.5, carry=carry)


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), doc_id=F.col("doc_id"))
    return out.withColumns({"probability": F.round("probability", 6), "weight": F.round("weight", 6)})


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by line; a token over a line end goes to the line it covers most of."""
    counted = token_counts(table(spark, sf_dir, "documents"))
    by_line = F.array_join(F.transform("sections", lambda s: s["n_tokens"].cast("string")), ",")
    return counted.select(
        "doc_id", "n_tokens", F.size("sections").cast("long").alias("n_lines"), "n_outside", "n_crossing", by_line.alias("tokens_by_line")
    )


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back from the formatted text."""
    said = F.lit(r"\### Assistant: </turn> ok")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    made = chat_format.format_chats(chat_format.conversation_records(rows))
    unread = F.raise_error(F.concat(F.lit("no layout for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("NULL"))))
    whole = made.withColumn("formatted", F.coalesce("formatted", unread.cast("string")))
    back = whole.select(
        "conv_id", chat_format.read_turns(F.col("formatted")).alias("read"), chat_format.learnt_text(F.col("pieces")).alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars")
    )
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )
