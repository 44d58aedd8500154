"""Phrases that occur together, mined by relations of occurrences.

Relation 1 holds the occurrences of frequent words, sorted by text, piece and position, and is written out. Relation
k follows from relation k - 1: an occurrence joins the one that begins at the next position of the same piece, a merge
join of two sorted relations, since both lie in the same order. Groups are counted by aggregation, combined inside each
task first, so a phrase of every second text costs a row per task. Only occurrences of frequent groups go on to the
next length (semi-join), and a group can only be frequent if both of its shorter parts are, so relations shrink.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cohortlens.functions.session import stage
from cohortlens.llm.membership import Membership, membership
from cohortlens.llm.naming import named as column
from cohortlens.llm.textbatch import PIECE_ENDS, PIECED, Words, chunks, lists, mix, parts, span_strings, utf8, words

NO_LANG = "und"
LONGEST = 4
#: Texts of a batch that are worked on at a time.
ROWS = 2000
_STEP = np.uint64(0xD1342543DE82EF95)
_ENDS = np.isin(np.arange(256), list(PIECE_ENDS))
_WORDS = "lang string, word string, id long, n long"
_RELATION = "words array<long>, opens array<boolean>, live array<boolean>"
_GROUPS = "a long, b long, n long"


def _next_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a group from that of all but its last word and the last word; one word is its own key."""
    return mix(key * _STEP + word)


def _grouped(first_key: np.ndarray, second_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first member and size of each distinct pair."""
    order = np.lexsort((second_key, first_key))
    new = np.ones(order.size, bool)
    new[1:] = (first_key[order[1:]] != first_key[order[:-1]]) | (second_key[order[1:]] != second_key[order[:-1]])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, order.size))


class Read(NamedTuple):
    """Words of some texts, with the number of each word's language and its id, which tells language and word."""

    text: np.ndarray
    words: Words
    lang: np.ndarray
    id: np.ndarray
    names: pa.Array


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Read]:
    for batch in parts(batches, ROWS):
        buf, bounds = utf8(batch.column("text"))
        names = batch.column("lang").dictionary_encode()
        codes = np.asarray(names.indices)
        salt = [int.from_bytes(hashlib.blake2b(x.as_py().encode(), digest_size=8).digest(), "little") for x in names.dictionary]
        for i, j in chunks(bounds, 1 << 21):
            b = bounds[i : j + 1]
            text = buf[b[0] : b[-1]]
            w = words(text, b - b[0], PIECED)
            lang = codes[i:j][w.row()]
            yield Read(text, w, lang, mix(w.hash ^ np.array(salt, np.uint64)[lang]), names.dictionary)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language with their counts in a part of the texts; word NULL has the count of all words."""
    columns = ["lang", "word", "id", "n"]
    for r in _read_texts(batches):
        first, n = _grouped(r.lang, r.id)
        spelt = span_strings(r.text, r.words.start[first], r.words.end[first]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([r.names.take(pa.array(r.lang[first])), spelt, pa.array(r.id[first].view(np.int64)), pa.array(n, pa.int64())], columns)
        none = len(r.names)
        totals = pa.array(np.bincount(r.lang, minlength=none), pa.int64())
        yield pa.RecordBatch.from_arrays([r.names, pa.nulls(none, pa.string()), pa.nulls(none, pa.int64()), totals], columns)


def _kept(owner: np.ndarray, ids: np.ndarray, opens: np.ndarray, live: np.ndarray, n_rows: int) -> pa.RecordBatch:
    first = np.searchsorted(owner, np.arange(n_rows + 1))
    columns = [lists(ids.view(np.int64), first, pa.int64()), lists(opens, first, pa.bool_()), lists(live, first, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["words", "opens", "live"])


def _first_relation(known: Membership):
    """Occurrences of frequent words; ``opens`` where the one before is not the word before it in the same piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _read_texts(batches):
            w = r.words
            piece = np.cumsum(_ENDS[r.text])[w.start] if w.start.size else w.start
            at = np.flatnonzero(known.probe(r.id))
            row = w.row()
            opens = np.ones(at.size, bool)
            opens[1:] = (np.diff(at) > 1) | (np.diff(piece[at]) > 0) | (np.diff(row[at]) > 0)
            yield _kept(row[at], r.id[at], opens, np.ones(at.size, bool), w.first.size - 1)

    return run


class Occurrences(NamedTuple):
    """A part of relation k - 1: text of each word, word ids, piece starts, and where frequent groups begin."""

    owner: np.ndarray
    ids: np.ndarray
    opens: np.ndarray
    live: np.ndarray
    n_rows: int

    def extended(self, k: int) -> np.ndarray:
        """Positions at which ``k`` words begin whose first and last ``k - 1`` are frequent groups of one piece."""
        n = self.owner.size - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        # A live group lies inside a piece, so only the next position needs to be in it as well.
        joined = self.live[:n] & self.live[1 : n + 1] & ~self.opens[1 : n + 1] & (self.owner[:n] == self.owner[k - 1 :])
        return np.flatnonzero(joined)

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        key = self.ids[at]
        for j in range(1, k):
            key = _next_key(key, self.ids[at + j])
        return key


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[Occurrences]:
    for batch in parts(batches, ROWS):
        sizes = np.diff(np.asarray(batch.column("words").offsets))
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        ids, opens, live = (np.asarray(batch.column(c).flatten()) for c in ("words", "opens", "live"))
        yield Occurrences(owner, ids.view(np.uint64), opens, live, batch.num_rows)


def _group_counts(k: int):
    """(key of all but the last word, last word, n) of the groups of ``k`` words in a part of the relation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _occurrences(batches):
            at = r.extended(k)
            a, b = r.keys(at, k - 1), r.ids[at + k - 1]
            first, n = _grouped(a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(n, pa.int64())], ["a", "b", "n"]
            )

    return run


def _next_relation(k: int):
    """Occurrences of frequent groups of ``k`` words; words in none of them fall out and open what follows."""

    def step(known: Membership):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _occurrences(batches):
                at = r.extended(k)
                at = at[known.probe(r.keys(at, k))]
                begins, covered = np.zeros(r.owner.size, bool), np.zeros(r.owner.size, bool)
                begins[at] = True
                for j in range(k):
                    covered[at + j] = True
                left = np.flatnonzero(covered)
                after_gap = np.ones(left.size, bool)
                after_gap[1:] = np.diff(left) > 1
                yield _kept(r.owner[left], r.ids[left], r.opens[left] | after_gap, begins[left], r.n_rows)

        return run

    return step


@F.pandas_udf(LongType())
def _group_key(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_next_key(a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)).view(np.int64))


def _require_distinct(rows: DataFrame, column: str) -> None:
    if rows.groupBy(column).count().where("count > 1").limit(1).collect():
        raise ValueError("two frequent phrases share a 64-bit key")


def _held(keys: DataFrame, step, rows: DataFrame, label: str) -> DataFrame:
    """A relation after a semi-join with ``keys``; the filter is taken off the executors afterwards."""
    known = membership(keys, keys.columns[0])
    out = stage(rows.mapInArrow(step(known), _RELATION), label)
    known.bits.destroy()
    return out


def frequent_phrases(docs: DataFrame, text: Column, lang: Column, min_count: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, id, n), frequent phrases (words: ids, n) of 1 to ``longest``, totals (lang, n).

    A word's id tells its language too. A group is counted under the key of all but its last word, which is a frequent group, and
    the last word, so only two frequent groups with one 64-bit key could be confused; that is an error. The filters of the
    semi-joins may let an infrequent group through, which the next count drops again.
    """
    rows = docs.select(F.coalesce(lang.cast("string"), F.lit(NO_LANG)).alias("lang"), text.cast("string").alias("text"))
    rows = rows.where("text is not null")
    counts = rows.mapInArrow(_word_counts, _WORDS).groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))
    kept = stage(counts.where(F.col("word").isNull() | (F.col("n") >= min_count)), "phrase-words")
    totals, single = kept.where("word is null").select("lang", "n"), kept.where("word is not null")
    _require_distinct(single, "id")
    phrases = single.select(F.array("id").alias("words"), "n")
    shorter = single.select(F.col("id").alias("key"), F.array("id").alias("head"))
    relation = _held(single.select("id"), _first_relation, rows, "phrase-relation-1")
    for k in range(2, longest + 1):
        counts = relation.mapInArrow(_group_counts(k), _GROUPS).groupBy("a", "b").agg(F.sum("n").alias("n"))
        frequent = stage(counts.where(F.col("n") >= min_count), f"phrase-groups-{k}")
        named = stage(
            frequent.join(shorter.withColumnRenamed("key", "a"), "a").select(_group_key("a", "b").alias("key"), F.array_append("head", F.col("b")).alias("head"), "n"),
            f"phrase-names-{k}",
        )
        phrases = phrases.unionByName(named.select(F.col("head").alias("words"), "n"))
        if k < longest:
            _require_distinct(named, "key")
            relation = _held(named.select("key"), _next_relation(k), relation, f"phrase-relation-{k}")
            shorter = named.select("key", "head")
    return single, stage(phrases, "phrases"), totals


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = 30,
    longest: int = LONGEST,
    factor: int = 2_000_000,
    percent: int = 80,
    top: int = 2000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase has 2 to ``longest`` words of one piece, A-Z lowered, and ``a`` occurrences, ``min_count`` or more. Cut
    after k words, the parts have ``l`` and ``r`` occurrences and the cut scores floor(factor * a / (l + r)); its lowest
    cut counts, the smallest k of equals. A phrase inside a longer one that has ``percent`` of its occurrences goes. Rank is
    by score, a, then phrase in byte order; ``n`` counts all words of the language. A NULL language is ``und``, a NULL
    or empty text has no words, repeated rows count as often as they occur, other columns are ignored.
    """
    single, phrases, totals = frequent_phrases(docs, column(text_col), column(lang_col), min_count, longest)
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731 - products of counts may pass 64 bits
    length = F.size("words")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), length - 1),
            lambda k: F.transform(F.sequence(F.lit(1), length - k + 1), lambda i: F.slice("words", i, k)),
        )
    )
    inside = (
        phrases.where(length > 2).select(F.col("n").alias("longer"), F.explode(inner).alias("words"))
        .groupBy("words").agg(F.max("longer").alias("longer"))
    )
    alone = phrases.where(length > 1).join(inside, "words", "left").where(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("n") * percent)
    )

    cuts = alone.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    left, right = F.slice("words", F.lit(1), F.col("k")), F.expr("slice(words, k + 1, size(words) - k)")
    part = lambda side, count: phrases.select(F.col("words").alias(side), F.col("n").alias(count))
    scored = (
        cuts.withColumns({"left": left, "right": right})
        .join(part("left", "l"), "left")
        .join(part("right", "r"), "right")
        .withColumns({"up": F.lit(factor).cast("decimal(10,0)") * wide("a"), "down": wide("l") + wide("r")})
        .withColumn("score", F.expr("up div down"))
    )
    best = scored.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spelt = (
        best.select("words", "a", "cut", F.posexplode("words").alias("at", "id"))
        .join(single.select("lang", "id", "word"), "id")
        .groupBy("lang", "words", "a", "cut")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
        .select("lang", F.array_join("spelt.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
