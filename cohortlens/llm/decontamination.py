"""Benchmark passages in documents: prefix-filtered set join over item-sized windows.

A benchmark window is a set of word shingles at fixed offsets. A document can only hold the window
if it holds the window's rarest shingle, so that one is its prefix; rarity is counted over all
documents. One pass over the texts finds the positions of benchmark shingles (a bounded membership
filter, then an equality join), with the words around them. Prefix matches give window starts,
bounded by position and document length, and each is confirmed word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.session import stage
from cohortlens.llm.membership import Membership, membership
from cohortlens.llm.textbatch import ALNUM, Words, chunks, lists, parts, run_hashes, utf8, words

#: Words of context around a match are kept in pieces of about this many words.
PIECE = 256


def _plain(buf: np.ndarray, w: Words, i: int, j: int) -> str:
    return b" ".join(bytes(buf[s:e]).lower() for s, e in zip(w.start[i:j], w.end[i:j])).decode()


def _windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            buf, bounds = utf8(batch.column("text"))
            for i, j in chunks(bounds, 1 << 18):
                b = bounds[i : j + 1]
                text = buf[b[0] : b[-1]]
                w = words(text, b - b[0], ALNUM)
                hashed = {}
                for k in range(1, shingle + 1):
                    at_start = np.zeros(w.hash.size, np.uint64)
                    h, at = run_hashes(w, k)
                    at_start[at] = h
                    hashed[k] = at_start.view(np.int64)
                out: list[tuple] = []
                for r, count in enumerate(w.counts()):
                    n = min(int(count), window)
                    k = min(n, shingle)
                    for s in range(w.first[r], w.first[r] + (count - n + 1 if n else 0)):
                        out.append((i + r, n, _plain(text, w, s, s + n), hashed[k][s : s + n - k + 1].tolist()))
                if out:
                    rows, n, plain, found = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("item_id").take(pa.array(rows)),
                            pa.array(n, pa.int32()),
                            pa.array(plain, pa.string()),
                            pa.array(found, pa.list_(pa.int64())),
                        ],
                        ["item_id", "n", "passage", "hashes"],
                    )

    return run


def _matches(sizes: list[int], reach: int, known: Membership):
    """Rows: key, doc_id, n_words, pieces of text around matches, and the matches with their piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in parts(batches):
            buf, bounds = utf8(batch.column("text"))
            for i, j in chunks(bounds):
                b = bounds[i : j + 1]
                text = buf[b[0] : b[-1]]
                w = words(text, b - b[0], ALNUM)
                where, what = [], []
                for k in sizes:
                    h, at = run_hashes(w, k)
                    hit = np.flatnonzero(known.probe(h))
                    where.append(at[hit])
                    what.append(h[hit].view(np.int64))
                at, h = np.concatenate(where), np.concatenate(what)
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                row = np.searchsorted(w.first, at, "right") - 1
                piece = np.zeros(at.size, np.int64)
                begin: list[int] = []
                plain: list[str] = []
                pieces_of = np.zeros(j - i, np.int64)
                m = 0
                while m < at.size:
                    lo, hi = int(w.first[row[m]]), int(w.first[row[m] + 1])
                    first = max(lo, int(at[m]) - reach)
                    last, stop = m, min(hi, int(at[m]) + reach)
                    while last + 1 < at.size and row[last + 1] == row[m] and at[last + 1] - reach <= stop and stop - first < PIECE:
                        last += 1
                        stop = min(hi, int(at[last]) + reach)
                    piece[m : last + 1] = len(begin)
                    begin.append(first - lo)
                    plain.append(_plain(text, w, first, stop))
                    pieces_of[row[m]] += 1
                    m = last + 1
                piece_first = np.concatenate(([0], np.cumsum(pieces_of)))
                match_first = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + j - i)),
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(w.counts(), pa.int64()),
                        lists(np.array(begin, np.int32), piece_first, pa.int32()),
                        lists(plain, piece_first, pa.string()),
                        lists((at - w.first[row]).astype(np.int32), match_first, pa.int32()),
                        lists(h, match_first, pa.int64()),
                        lists((piece - piece_first[row]).astype(np.int32), match_first, pa.int32()),
                    ],
                    ["key", "doc_id", "n_words", "piece_begin", "piece_text", "match_at", "match_hash", "match_piece"],
                )
                key += j - i

    return run


_MATCHES = (
    "key long, doc_id long, n_words long, piece_begin array<int>, piece_text array<string>, "
    "match_at array<int>, match_hash array<long>, match_piece array<int>"
)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shingle: int = 4,
    percent: int = 5,
) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered. An item
    gives each run of ``window`` words, a shorter one its whole sequence; items with a NULL id or
    without words give nothing, and rows that share an id are one item. A document word is hit when it
    lies in an occurrence; ``contaminated`` means at least ``percent`` of its words are. NULL or empty
    texts have no words; equal rows give equal results; other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    made = items.where("item_id is not null").mapInArrow(
        _windows(window, shingle), f"item_id {kind}, n int, passage string, hashes array<long>"
    )
    listed = stage(made, "bench-windows")
    windows = stage(listed.select("passage", "n", "hashes").dropDuplicates(["passage"]), "bench-distinct")
    owners = listed.select("passage", F.col("item_id").cast("string").alias("item_id")).distinct()

    known = stage(windows.select(F.explode("hashes").alias("hash")).distinct(), "bench-shingles")
    lengths = F.least(F.col("n"), F.lit(shingle)).alias("k")
    sizes = sorted(r["k"] for r in windows.select(lengths).distinct().collect()) or [shingle]
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = stage(text.mapInArrow(_matches(sizes, window, membership(known, "hash")), _MATCHES), "bench-matches")

    zipped = F.explode(F.arrays_zip("match_at", "match_hash", "match_piece")).alias("m")
    matches = found.where(F.size("match_at") > 0).select("key", "n_words", zipped)
    matches = matches.select("key", "n_words", "m.match_at", F.col("m.match_hash").alias("hash"), "m.match_piece")

    rarity = matches.groupBy("hash").agg(F.count(F.lit(1)).alias("seen"))
    placed = windows.select("passage", "n", F.posexplode("hashes").alias("offset", "hash"))
    # A shingle that no document holds has no row in rarity: its window occurs nowhere.
    prefix = (
        placed.join(rarity, "hash", "left")
        .groupBy("passage", "n")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "hash")).alias("p"))
        .where("p.seen > 0")
        .select("passage", "n", F.col("p.offset").alias("offset"), F.col("p.hash").alias("hash"))
    )
    begin = F.col("match_at") - F.col("offset")
    candidates = (
        matches.join(stage(prefix, "bench-prefixes"), "hash")
        .withColumn("begin", begin)
        .where((F.col("begin") >= 0) & (F.col("begin") + F.col("n") <= F.col("n_words")))
        .select("key", F.col("match_piece").alias("piece"), "begin", "n", "passage")
    )
    pieces = found.where(F.size("match_at") > 0).select(
        "key", F.posexplode(F.arrays_zip("piece_begin", "piece_text")).alias("piece", "p")
    )
    pieces = pieces.select("key", "piece", F.col("p.piece_begin").alias("from"), F.split("p.piece_text", " ").alias("around"))
    held = F.array_join(F.slice("around", F.col("begin") - F.col("from") + 1, F.col("n")), " ")
    occurrences = stage(
        candidates.join(pieces, ["key", "piece"]).where((F.col("begin") >= F.col("from")) & (held == F.col("passage")))
        .select("key", "begin", (F.col("begin") + F.col("n")).alias("end"), "passage").distinct(),
        "bench-occurrences",
    )

    before = Window.partitionBy("key").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = (
        occurrences.select("key", "begin", "end").distinct().select("key", fresh.cast("long").alias("fresh"))
        .groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    )
    named = occurrences.select("key", "passage").distinct().join(owners, "passage").select("key", "item_id").distinct()
    per_doc = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items")
    )
    out = found.select("key", "doc_id", "n_words").join(hit, "key", "left").join(per_doc, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )
