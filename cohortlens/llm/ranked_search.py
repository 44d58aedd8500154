"""Ranked lexical search, term at a time, with a limit on accumulators.

The texts are read once: each document leaves its length and, for terms that occur in queries, how often it holds them.
From these rows follow N, L and df by aggregation. Then every task ranks its own documents in blocks. Inside a block a
query's terms are taken rarest first. A document gets an accumulator while the largest scores that the terms still to
come can give could lift a newcomer to the k-th partial score; after that, the documents that have one are updated to
their exact score and no other is touched. The k-th score of the blocks before counts as well. A task hands on ``top`` documents a query,
of which the best are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.session import stage
from cohortlens.llm.textbatch import ALNUM, chunks, lists, parts, span_bytes, utf8, words

#: Most terms, repeats over queries included, and bytes of terms that one pass over the texts serves. More queries are
#: taken in blocks; a single query is never split.
TERMS_PER_PASS, BYTES_PER_PASS = 1 << 18, 1 << 25
BLOCK_DOCS = 1 << 14
BLOCK_POSTINGS = 1 << 21
#: Documents of one query and bucket are ranked first, then those left over.
BUCKETS = 32
_NULL_ID = np.iinfo(np.int64).max
_DOC = "doc_id long, n long, terms array<int>, counts array<int>"


class Terms(NamedTuple):
    """Distinct query terms in the order of their hashes, with their bytes."""

    hash: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    def places(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of the term that each word is, -1 for none. Equal hashes are confirmed byte by byte."""
        if not self.hash.size:
            return np.full(hashes.size, -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), self.hash.size - 1)
        hit = np.flatnonzero(self.hash[at] == hashes)
        place = at[hit]
        size = end[hit] - start[hit]
        same = size == np.diff(self.bounds)[place]
        hit, place, size = hit[same], place[same], size[same]
        mine, first = span_bytes(buf, start[hit], end[hit])
        theirs = self.data[np.arange(first[-1]) + np.repeat(self.bounds[place] - first[:-1], size)]
        wrong = np.zeros(hit.size, bool)
        wrong[np.searchsorted(first, np.flatnonzero(mine != theirs), "right") - 1] = True
        out = np.full(hashes.size, -1)
        out[hit[~wrong]] = place[~wrong]
        return out


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        buf, bounds = utf8(batch.column("text"))
        w = words(buf, bounds, ALNUM)
        data, cut = span_bytes(buf, w.start, w.end)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item_id").take(pa.array(w.row())),
                pa.array(w.hash.view(np.int64)),
                pa.Array.from_buffers(pa.large_binary(), w.start.size, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()),
            ],
            ["item_id", "hash", "term"],
        )


def _postings(known: Broadcast):
    """One row per document with a term: doc_id, n, its query terms and how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value
        for batch in parts(batches):
            buf, bounds = utf8(batch.column("text"))
            for i, j in chunks(bounds):
                b = bounds[i : j + 1]
                text = buf[b[0] : b[-1]]
                w = words(text, b - b[0], ALNUM)
                place = terms.places(text, w.start, w.end, w.hash)
                hit = np.flatnonzero(place >= 0)
                pair, tf = np.unique(w.row()[hit] * max(1, terms.hash.size) + place[hit], return_counts=True)
                row, term = np.divmod(pair, max(1, terms.hash.size))
                first = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(w.counts(), pa.int64()),
                        lists(term.astype(np.int32), first, pa.int32()),
                        lists(tf.astype(np.int32), first, pa.int32()),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )

    return run


class Plan(NamedTuple):
    """What a task needs to rank: term weights and, per query, its terms rarest first."""

    weight: np.ndarray
    order: np.ndarray
    bounds: np.ndarray
    n_docs: int
    n_terms: int
    top: int


def _length_part(n: np.ndarray, plan: Plan) -> np.ndarray:
    """m of each document, 100 - 50 + (50 * n * N) div L."""
    if n.size and int(n.max()) * 50 * plan.n_docs >= 1 << 62:
        return np.array([50 + 50 * int(v) * plan.n_docs // plan.n_terms for v in n], np.int64)
    return 50 + 50 * n * plan.n_docs // plan.n_terms


class Ranking:
    """The best documents of each query so far."""

    def __init__(self, plan: Plan):
        self.plan = plan
        none = np.zeros(0, np.int64)
        self.ids, self.scores = ([none] * (plan.bounds.size - 1) for _ in range(2))

    def take(self, ids: np.ndarray, n: np.ndarray, terms: np.ndarray, tf: np.ndarray, first: np.ndarray) -> None:
        """Rank a block of documents, whose terms and counts lie between the bounds ``first``."""
        plan = self.plan
        if not terms.size:
            return
        doc = np.repeat(np.arange(ids.size), np.diff(first))
        tf = tf.astype(np.int64)
        gain = plan.weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * _length_part(n, plan)[doc]))
        by_term = np.argsort(terms, kind="stable")
        doc, gain = doc[by_term], gain[by_term]
        present, begin = np.unique(terms[by_term], return_index=True)
        most = np.maximum.reduceat(gain, begin)
        at = np.full(plan.weight.size, -1)
        at[present] = np.arange(present.size)
        end = np.append(begin[1:], gain.size)
        score = np.zeros(ids.size, np.int64)
        alive = np.zeros(ids.size, bool)
        for q in range(plan.bounds.size - 1):
            held = at[plan.order[plan.bounds[q] : plan.bounds[q + 1]]]
            held = held[held >= 0]
            if held.size:
                self._query(q, held, most, begin, end, doc, gain, score, alive, ids)

    def _query(self, q, held, most, begin, end, doc, gain, score, alive, ids) -> None:
        k = self.plan.top
        floor = self.scores[q][-1] if self.scores[q].size >= k else 0
        left = np.append(np.cumsum(most[held][::-1])[::-1], 0)
        grown: list[np.ndarray] = []
        size, open_ = 0, True
        for turn, t in enumerate(held):
            docs, plus = doc[begin[t] : end[t]], gain[begin[t] : end[t]]
            if open_:
                if size >= k:
                    seen = score[np.concatenate(grown)]
                    floor = max(floor, int(np.partition(seen, size - k)[size - k]))
                # A newcomer gets no more than what is left; one that could still tie is let in.
                open_ = left[turn] >= floor
            if open_:
                score[docs] += plus
                fresh = docs[~alive[docs]]
                alive[fresh] = True
                grown.append(fresh)
                size += fresh.size
            else:
                old = alive[docs]
                score[docs[old]] += plus[old]
        if size:
            mine = np.concatenate(grown)
            got = score[mine]
            score[mine] = 0
            alive[mine] = False
            if got.size > k:
                good = got >= np.partition(got, got.size - k)[got.size - k]
                mine, got = mine[good], got[good]
            all_ids = np.concatenate((self.ids[q], ids[mine]))
            all_scores = np.concatenate((self.scores[q], got))
            best = np.lexsort((all_ids, -all_scores))[:k]
            best = best[all_scores[best] > 0]
            self.ids[q], self.scores[q] = all_ids[best], all_scores[best]


def _rank(shared: Broadcast):
    """item, doc_id and score of the best documents of a task, read in blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        ranking = Ranking(plan)
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            column = table.column("terms").combine_chunks()
            ids = np.asarray(table.column("doc_id").fill_null(_NULL_ID))
            terms = np.asarray(column.flatten())
            tf = np.asarray(table.column("counts").combine_chunks().flatten())
            offsets = np.asarray(column.offsets)
            ranking.take(ids, np.asarray(table.column("n")), terms, tf, offsets - offsets[0])

        for batch in parts(batches):
            held.append(batch)
            docs += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                flush()
                held, docs, postings = [], 0, 0
        if held:
            flush()
        sizes = [s.size for s in ranking.scores]
        if sum(sizes):
            ids = np.concatenate(ranking.ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()),
                    pa.array(ids, pa.int64(), mask=ids == _NULL_ID),
                    pa.array(np.concatenate(ranking.scores), pa.int64()),
                ],
                ["item", "doc_id", "score"],
            )

    return run


def _pass(docs: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """Best documents of the queries ``asked`` (item_id, hash, term), few enough for one broadcast."""
    spark = docs.sparkSession
    rows = asked.select("hash", "term").distinct().orderBy("hash", "term").collect()
    hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    if np.unique(hashes).size < hashes.size:
        raise ValueError("two query terms share a hash")
    names = [bytes(rows[i]["term"]) for i in order]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in names]))).astype(np.int64)
    terms = Terms(hashes[order], np.frombuffer(b"".join(names), np.uint8), bounds)
    known = spark.sparkContext.broadcast(terms)
    posted = stage(docs.mapInArrow(_postings(known), _DOC).where("n > 0"), "search-postings")
    known.destroy()

    n_docs, n_terms = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    counts = np.array([df.get(i, 0) for i in range(len(names))], np.int64)
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * counts + 1))).astype(np.int64)
    place = {int(h): i for i, h in enumerate(terms.hash.view(np.int64))}
    per_item: dict[object, list[int]] = {}
    for r in asked.select("item_id", "hash").distinct().collect():
        per_item.setdefault(r["item_id"], []).append(place[r["hash"]])
    items = list(per_item)
    sorted_terms = [sorted(per_item[i], key=lambda t: (counts[t], t)) for i in items]
    plan = Plan(
        weight,
        np.array([t for ts in sorted_terms for t in ts], np.int64),
        np.concatenate(([0], np.cumsum([len(ts) for ts in sorted_terms]))).astype(np.int64),
        n_docs,
        n_terms,
        top,
    )
    kind = asked.schema["item_id"].dataType.simpleString()
    named = spark.createDataFrame(list(enumerate(items)), f"item int, item_id {kind}")
    ranked = stage(posted.mapInArrow(_rank(spark.sparkContext.broadcast(plan)), "item int, doc_id long, score long"), "search-best")
    return ranked.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = 50,
    terms_per_pass: int = TERMS_PER_PASS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each query with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered; a query's count
    once each. Rows of ``queries`` that share an id are one query, those with a NULL id are none. Rows of ``docs`` are documents of
    their own, also if they share an id; equal scores rank by ascending id, a NULL id last. NULL and empty texts have no terms. Other
    columns are ignored. Queries beyond ``terms_per_pass`` terms are served in several passes over the documents.
    """
    q = lambda c: F.col(f"`{c}`")
    items = queries.select(q(item_col).alias("item_id"), q(item_text_col).cast("string").alias("text")).where("item_id is not null")
    kind = items.schema["item_id"].dataType.simpleString()
    asked = stage(
        items.mapInArrow(_query_terms, f"item_id {kind}, hash long, term binary").distinct(), "search-terms"
    )
    rows = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).cast("string").alias("text"))
    n_asked, n_bytes = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    passes = max(1, -(-n_asked // terms_per_pass), -(-n_bytes // BYTES_PER_PASS))
    found = None
    for turn in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn)
        best = _pass(rows, part, top)
        found = best if found is None else found.unionByName(best)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    bucket = F.pmod(F.xxhash64("doc_id", "score"), F.lit(BUCKETS))
    some = found.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "bucket").orderBy(*order)))
    final = some.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return final.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
