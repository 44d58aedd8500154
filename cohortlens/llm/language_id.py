"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of every labelled row in tasks (one table of classes x buckets per task,
summed by Spark). The log-probability matrix is broadcast in parts of at most ``SHARD_CLASSES`` x ``BUCKETS`` numbers;
scoring adds its rows over the n-grams of each text in numpy, part by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cohortlens.llm.textbatch import chunks, parts, utf8

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: 256 classes make a matrix of 32 MB, the most that is sent at a time.
SHARD_CLASSES = 256
#: Text that is taken apart at a time; its code points, n-grams and their weights take some 130 times as many bytes.
CHUNK_BYTES = 1 << 16
UNDETERMINED = "und"
_U = np.uint32


def _grams(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram that begins with a letter, and the bounds per row.

    ``text`` has code points, lowered; ASCII non-letters count as spaces.
    """
    c = text.astype(_U)
    c[(c < 97) | ((c > 122) & (c < 128))] = 32
    row = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
    last = bounds[1:][row] - np.arange(c.size)  # code points left in the row, itself included
    out, rows = [], []
    h = np.zeros(c.size, _U)
    letter = c != 32
    for n in range(1, max(ORDERS) + 1):
        h = h[: c.size - n + 1] * _U(0x01000193) + c[n - 1 :] * _U(0x9E3779B1)
        if n in ORDERS:
            at = np.flatnonzero(letter[: h.size] & (last[: h.size] >= n))
            g = h[at] ^ _U(n * 0x85EBCA6B & 0xFFFFFFFF)
            g ^= g >> _U(15)
            g *= _U(0x2C1B3C6D)
            g ^= g >> _U(13)
            out.append((g & _U(BUCKETS - 1)).astype(np.int32))
            rows.append(row[at])
    return np.concatenate(out), np.concatenate(rows)


def _points(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their lowered code points."""
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    buf, bounds = utf8(low)
    for i, j in chunks(bounds, CHUNK_BYTES):
        b = bounds[i : j + 1]
        raw = buf[b[0] : b[-1]]
        begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        yield i, j, points, begins[b - b[0]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: dict[str, np.ndarray] = {}
    for batch in parts(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j, points, bounds in _points(batch.column("text")):
            grams, row = _grams(points, bounds)
            for lang in sorted(set(langs[i:j])):
                counts = table.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                mine = (langs[i:j] == lang)[row]
                counts[:BUCKETS] += np.bincount(grams[mine], minlength=BUCKETS)
                counts[BUCKETS] += int((langs[i:j] == lang).sum())
    for lang, counts in table.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * used.size), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["lang", "bucket", "n"]
        )


class LanguageModel(NamedTuple):
    """Class names in sorted order, log-probabilities (BUCKETS x classes) and log priors."""

    langs: list[str]
    weights: np.ndarray
    prior: np.ndarray


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Model of all rows whose text and language are not NULL; no such rows give a model without classes."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    got = {r["lang"]: r["cells"] for r in found.collect()}
    langs = sorted(got)
    table = np.zeros((BUCKETS + 1, len(langs)))
    for k, lang in enumerate(langs):
        cells = np.array(got[lang], np.int64)
        table[cells[:, 0], k] = cells[:, 1]
    grams, docs_of = table[:BUCKETS], table[BUCKETS]
    weights = np.log(grams + SMOOTHING) - np.log(grams.sum(axis=0) + SMOOTHING * BUCKETS)
    prior = np.log(docs_of / docs_of.sum()) if langs else docs_of
    return LanguageModel(langs, weights.astype(np.float32), prior)


def predict_languages(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: dict[str, Column] | None = None
) -> DataFrame:
    """One row per input row: the columns of ``keep``, then lang_pred and score.

    Score is the class's posterior probability. A NULL text, one without a letter, or a model without
    classes gives ``und`` and score 0. Equal best classes: the first in name order wins.
    """
    keep = keep or {}
    context = docs.sparkSession.sparkContext
    langs, prior = model.langs, model.prior
    shards = [context.broadcast(np.ascontiguousarray(model.weights[:, k : k + SHARD_CLASSES].T)) for k in range(0, len(langs), SHARD_CLASSES)]
    if {"lang_pred", "score", "_text"} & set(keep):
        raise ValueError("lang_pred, score and _text are names of the result")

    carried = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, UNDETERMINED], object)
        for batch in parts(batches):
            text = batch.column("_text")
            best = np.full(batch.num_rows, len(langs))
            score = np.zeros(batch.num_rows)
            if langs:
                known = np.array([t is not None and any(map(str.isalpha, t)) for t in text.to_pylist()], bool)
                for i, j, points, bounds in _points(text):
                    grams, row = _grams(points, bounds)
                    total = np.stack([np.bincount(row, w[grams], j - i) for part in shards for w in part.value], axis=1) + prior
                    total -= total.max(axis=1, keepdims=True)
                    odds = np.exp(total)
                    best[i:j] = odds.argmax(axis=1)
                    score[i:j] = 1 / odds.sum(axis=1)
                best[~known], score[~known] = len(langs), 0.0
            out = [batch.column(c) for c in carried]
            out += [pa.array(names[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, [*carried, "lang_pred", "score"])

    rows = docs.select(*[e.alias(c) for c, e in keep.items()], F.col(text_col).cast("string").alias("_text"))
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *added]))


def is_held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Rows kept away from training, by a checksum of the id; a NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    model = fit_languages(docs.where(~is_held_out(id_col)), text_col, lang_col)
    return predict_languages(docs, model, text_col, {"doc_id": F.col(id_col), "held_out": is_held_out(id_col)})
