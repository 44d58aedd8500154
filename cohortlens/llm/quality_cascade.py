"""Quality rules as a short-circuit cascade, in column expressions only.

Each rule says when a text is rejected. Its cost (seconds over a sample) and selectivity (share of the
sample rejected) give rejections per cost; the rules are then tried in falling order inside one
conditional expression, so a rule runs only on what all before it let pass. The order changes the
work, never the verdict. The sample is at most about ``SAMPLE_ROWS`` rows and serves this order alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.session import stage

SAMPLE_ROWS = 2000
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_WORDS = 50


class Rule(NamedTuple):
    """``rejects`` may use ``text`` and the columns of :func:`text_counts`."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    upper = F.length("text") - F.length(F.translate("text", UPPER, ""))
    lower = F.length("text") - F.length(F.translate("text", LOWER, ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("capitals", upper > lower),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("letters", 5 * F.regexp_count(F.col("text"), F.lit(rf"\p{{L}}{WORD}*")) < 4 * F.col("n_words")),
        Rule("placeholder", F.lower("text").contains("lorem ipsum")),
    ]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression to."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Number of words in three-word windows found twice or more."""

    def hashed(w: Column) -> Column:
        three = F.transform(
            F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
        )
        return F.when(F.size(w) >= 3, three).otherwise(F.array().cast("array<bigint>"))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _bound(placed, covered)).otherwise(0)

    return _bound(words, lambda w: _bound(hashed(w), counted))


def text_counts(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A window of three words is known by a 64-bit hash. Where no hash repeats, nothing is sorted; else equal
    windows are neighbours in sorted order. Every count is linear or n log n in the text also when a filter on it
    is pushed down.
    """
    words = F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    split = texts.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    return split.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def cascade_order(texts: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """``rules`` by falling rejections per second, measured on a sample of ``texts``; ties keep their order."""
    rows = texts.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    sample = stage(text_counts(texts.sample(False, share, seed=7) if share < 1 else texts), "rule-sample")
    rated = []
    for k, rule in enumerate(rules):
        began = time.monotonic()
        hits, n = sample.agg(F.count_if(rule.rejects), F.count(F.lit(1))).first()
        cost = max(time.monotonic() - began, 1e-6)
        rated.append((-(hits / max(n, 1)) / cost, k, rule))
    return [r for _, _, r in sorted(rated, key=lambda x: x[:2])]


def quality_cascade(
    docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A NULL text counts as empty and fails. ``base_failed``: fewer than 50 words, or more than half of them in
    repeated windows. ``kept``: not failed, and no rule rejects; a rule that yields NULL does not reject.
    Equal rows give equal results; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    verdict = F.when(F.col("base_failed"), False)
    for rule in cascade_order(texts, default_rules() if rules is None else rules):
        verdict = verdict.when(rule.rejects, False)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = text_counts(texts).withColumn("base_failed", failed).withColumn("kept", verdict.otherwise(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
