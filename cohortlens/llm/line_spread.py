"""Removal of boilerplate lines, found by the number of distinct sites that carry them.

Lines are keyed by two 64-bit hashes of their normal form. HyperLogLog sketches of the site, one per
line, merge by aggregation, so a line of a third of all documents costs one sketch per task. Only
lines whose estimate lies near the threshold get an exact distinct count. Long lines may have a lower threshold
and a second one, the exact number of distinct documents that carry them. The first place of a
boilerplate line (smallest doc_id, then position) keeps it; it goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.session import stage
from cohortlens.llm.naming import named

LG_BUCKETS = 10
#: Three standard errors of a sketch of 2**LG_BUCKETS buckets, 1.04 / sqrt(1024) each.
MARGIN = 3 * 1.04 / 2 ** (LG_BUCKETS / 2)
_LINE = ["line_a", "line_b"]
#: A line is long from this many words on; two letters of a script without blanks count as a word.
LONG_WORDS = 50
_NO_BLANKS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _normal(line: Column) -> Column:
    """A line with white space trimmed and collapsed and letters lowered."""
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def _is_long(normal: Column) -> Column:
    """Whether a normal form has ``LONG_WORDS`` words, letters of scripts without blanks counted as half a word each.

    Letters are only looked at where words alone don't decide: such a letter has two bytes more than it has characters.
    """
    words = F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1
    most = (F.octet_length(normal) - F.length(normal)) / 2
    letters = F.regexp_count(normal, F.lit(_NO_BLANKS))
    need = 2 * LONG_WORDS
    # The shortest long line has 66 characters.
    return (F.length(normal) >= 66) & ((2 * words >= need) | ((2 * words + most >= need) & (2 * words + letters >= need)))


def _hashes(normal: Column, one_word: bool, long: bool) -> Column:
    """Hashes of a normal form and, if asked for, whether it is long; ``normal`` is a bound variable, computed once."""
    made = [F.xxhash64(normal).alias("line_a"), F.xxhash64(F.lit("line"), normal).alias("line_b")]
    # NULL keeps a line out of the counts: a blank one, and one of a single word unless these are asked for.
    return F.when(
        normal != "" if one_word else normal.contains(" "), F.struct(*made, (_is_long(normal) if long else F.lit(False)).alias("long"))
    )


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, one_word: bool, long: bool) -> DataFrame:
    normal = F.transform(F.split(named(text_col).cast("string"), "\n", -1), _normal)
    hashed = F.transform(normal, lambda x: _hashes(x, one_word, long))
    rows = docs.select(
        named(id_col).cast("long").alias("doc_id"),
        F.xxhash64(named(text_col).cast("string")).alias("body"),
        named(site_col).cast("string").alias("site"),
        F.posexplode(hashed).alias("pos", "line"),
    )
    return rows.where("line is not null").select("doc_id", "body", "site", "pos", "line.*")


def boilerplate_lines(lines: DataFrame, min_sites: int, long_sites: int | None = None, long_docs: int | None = None) -> DataFrame:
    """line_a, line_b, first_doc, first_pos, n_sites of every line on at least ``min_sites`` sites.

    A long line needs ``long_sites`` sites or ``long_docs`` distinct documents instead, where these are given.
    ``n_sites`` is exact where the estimate is near the threshold, else the estimate. A NULL site is no site.
    """
    spread = lines.groupBy(*_LINE).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_BUCKETS)).alias("estimate"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
        F.first("long").alias("long"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    wanted = F.lit(min_sites) if long_sites is None else F.when(F.col("long"), long_sites).otherwise(min_sites)
    # No more documents than rows carry a line.
    repeats = F.lit(False) if long_docs is None else F.col("long") & (F.col("n_rows") >= long_docs)
    rows = spread.withColumn("wanted", wanted).withColumn("repeats", repeats)
    near = stage(rows.where((F.col("estimate") >= F.col("wanted") * (1 - MARGIN)) | F.col("repeats")), "line-spread")
    unsure = near.where(F.col("estimate") <= F.col("wanted") * (1 + MARGIN))
    exact = (
        lines.join(unsure.select(*_LINE), _LINE, "left_semi").select(*_LINE, "site").distinct().groupBy(*_LINE)
        .agg(F.count("site").alias("exact"))
    )
    counted = near.join(exact, _LINE, "left").withColumn("n_sites", F.coalesce("exact", "estimate"))
    enough = F.col("n_sites") >= F.col("wanted")
    if long_docs is not None:
        carried = (
            lines.join(unsure.where("repeats").select(*_LINE), _LINE, "left_semi").select(*_LINE, "doc_id", "body").distinct()
            .groupBy(*_LINE).agg(F.count(F.lit(1)).alias("n_docs"))
        )
        counted = counted.join(carried, _LINE, "left")
        enough = enough | F.coalesce(F.col("n_docs") >= long_docs, F.lit(False))
    return counted.where(enough).select(
        *_LINE, F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"), "n_sites"
    )


def dedup_lines(
    docs: DataFrame,
    min_sites: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    long_sites: int | None = None,
    long_docs: int | None = None,
    one_word: bool = False,
) -> DataFrame:
    """The input's columns with boilerplate lines taken out of the text, plus n_lines and n_removed.

    Lines are parts between line feeds. Blank lines are left alone, and lines of one word unless ``one_word``.
    ``long_sites`` and ``long_docs`` add rules for long lines (:func:`boilerplate_lines`). A row whose text is NULL
    or empty stays as it is. Rows with the same doc_id and text are one document: all keep a first line.
    Columns of the input named n_lines or n_removed are replaced.
    """
    long = long_sites is not None or long_docs is not None
    lines = stage(_lines(docs, id_col, text_col, site_col, one_word, long), "lines")
    found = stage(boilerplate_lines(lines, min_sites, long_sites, long_docs), "boilerplate")
    first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))
    gone = stage(
        lines.join(found, _LINE).where(~first).groupBy("doc_id", "body").agg(F.collect_set("pos").alias("gone")),
        "line-removals",
    )
    whole = docs.select(
        F.struct(*map(named, docs.columns)).alias("row"),
        named(id_col).cast("long").alias("id"),
        F.xxhash64(named(text_col).cast("string")).alias("text_hash"),
    )
    hit = whole.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_hash") == F.col("body")), "left")
    text = F.col("row")[text_col]
    parts = F.split(text.cast("string"), "\n", -1)
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n")
    own = {
        text_col: F.when(F.col("gone").isNull(), text).otherwise(left),
        "n_lines": F.greatest(F.size(parts), F.lit(0)).cast("long"),
        "n_removed": F.greatest(F.size("gone"), F.lit(0)).cast("long"),
    }
    rest = [own.pop(c).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return hit.select(*rest, *[e.alias(c) for c, e in own.items()])
