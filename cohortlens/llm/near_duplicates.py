"""Near-duplicate documents by banded HyperMinHash registers, confirmed on full shingle sets.

1. One pass hashes every text into its set of distinct word shingles. Rows with the same set form
   one class, so copies never meet in pairs; only one representative goes on.
2. A representative's sketch has ``REGISTERS`` buckets. Elements are dealt over the buckets and the
   smallest value stays, kept as leading-zero count plus ``MANTISSA`` bits. Buckets still empty
   are filled by further rounds of the same rule, so small sets have full sketches too.
3. Bands of four registers give keys. In each key, members are paired with one centre only, the one
   that shares most keys with others; confirmed pairs are contracted, and what is outside the
   centre's component gets a centre of its own. What then still spans components goes through an
   exact prefix and positional filter. No pair inside a component is ever confirmed.
4. A pair goes to confirmation when set sizes allow the threshold and the collision-corrected
   estimate is within six standard errors of it. Confirmation intersects the full sets.

At similarity 0.8 the 32 bands miss a pair with probability (1 - 0.8^4)^32, about 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.session import stage
from cohortlens.llm.components import components
from cohortlens.llm.membership import Membership, membership
from cohortlens.llm.textbatch import SPACED, chunks, distinct_sets, lists, mix, parts, set_hashes, utf8, words

_U = np.uint64
REGISTERS, BANDS, MANTISSA = 128, 32, 10
CENTRES = 2
_VALUE_BITS = 52
_VALUE = _U((1 << _VALUE_BITS) - 1)


def sketches(u: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS, uint32) of the distinct hashes ``u`` grouped by ``first``.

    A register is round << 16 | leading zeros << 10 | mantissa of the bucket's smallest value.
    """
    rows = first.size - 1
    best = np.full(rows * REGISTERS, ~_U(0))
    row = np.repeat(np.arange(rows), np.diff(first))
    value, turn = u, 0
    while value.size:
        g = mix(value ^ mix(np.array([turn + 1], _U) * _U(0xA0761D6478BD642F))[0])
        if turn < REGISTERS:
            bucket = (g >> _U(57)).astype(np.int64)
        else:  # by now only tiny sets are open: every element reaches one bucket a round
            bucket = np.full(g.size, turn - REGISTERS)
        np.minimum.at(best, row * REGISTERS + bucket, _U(turn << 56) | (g & _VALUE))
        turn += 1
        if turn == 2 * REGISTERS:
            break
        still = (best.reshape(rows, REGISTERS) == ~_U(0)).any(axis=1)[row]
        value, row = value[still], row[still]
    v = best & _VALUE
    width = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    zeros = np.minimum(_VALUE_BITS - width, 63).astype(_U)
    mantissa = ((v << zeros) & (_VALUE >> _U(1))) >> _U(_VALUE_BITS - 1 - MANTISSA)
    packed = ((best >> _U(56)) << _U(16)) | (zeros << _U(10)) | mantissa
    return packed.astype(np.uint32).reshape(rows, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    per = REGISTERS // BANDS
    split = registers.astype(_U).reshape(registers.shape[0], BANDS, per)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), split.shape[:2]).copy()
    for j in range(per):
        h = mix(h * _U(0x9FB21C651E98DF25) + split[:, :, j])
    return h.view(np.int64)


def collision_rate(n: np.ndarray) -> np.ndarray:
    """Chance that two different elements leave the same register in sets of ``n`` elements."""
    m = np.maximum(n / REGISTERS, 1.0)[:, None]
    below = -np.expm1(m * np.log1p(-np.exp2(-np.arange(64.0) - 1e-12)))
    at_most = np.clip(1 - below, 0, 1)  # share of buckets with at least k leading zeros is below
    share = np.diff(np.concatenate((at_most, np.ones_like(m)), axis=1), axis=1)
    return (share**2).sum(axis=1) / 2**MANTISSA


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            buf, bounds = utf8(batch.column("text"))
            for i, j in chunks(bounds):
                b = bounds[i : j + 1]
                u, first = distinct_sets(*set_hashes(words(buf[b[0] : b[-1]], b - b[0], SPACED), shingle))
                size = np.diff(first)
                full = np.flatnonzero(size)
                keys = np.zeros((size.size, BANDS), np.int64)
                keys[full] = band_keys(sketches(u, first))[full]
                marks = []
                for salt in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5):
                    total = np.concatenate(([0], np.cumsum(mix(u ^ _U(salt)), dtype=_U))).astype(_U)
                    marks.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                kept = np.where(size > 0, BANDS, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(size, pa.int64()),
                        pa.array(marks[0]),
                        pa.array(marks[1]),
                        lists(keys[full].ravel(), np.concatenate(([0], np.cumsum(kept))), pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "mark_a", "mark_b", "bands"],
                )

    return run


def _sets(shingle: int, wanted: Membership):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found = np.flatnonzero(wanted.probe(mix(ids.astype(np.int64).view(_U))))
            if not found.size:
                continue
            batch = batch.take(pa.array(found))
            buf, bounds = utf8(batch.column("text"))
            for i, j in chunks(bounds):
                b = bounds[i : j + 1]
                u, first = distinct_sets(*set_hashes(words(buf[b[0] : b[-1]], b - b[0], SPACED), shingle))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([r.tobytes() for r in sketches(u, first)], pa.binary()),
                        lists(u.view(np.int64), first, pa.int64()),
                    ],
                    ["doc_id", "n", "sketch", "shingles"],
                )

    return run


def _mixed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(mix(ids.view(_U)).view(np.int64))], ["k"])


def _estimate(threshold: float):
    floor = threshold - 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, REGISTERS)
                for c in ("sketch_a", "sketch_b")
            )
            same = (a == b).mean(axis=1)
            chance = collision_rate(batch.column("n_a").to_numpy().astype(float))
            keep = np.flatnonzero((same - chance) / (1 - chance) >= floor)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    return run


def _confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def side(name: str, *columns: str) -> DataFrame:
        return nodes.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    sized = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    likely = sized.where(fits).mapInArrow(_estimate(percent / 100), "a long, b long")
    both = likely.join(side("a", "n", "shingles"), "a").join(side("b", "n", "shingles"), "b")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lowered. ``component_id`` is the smallest
    doc_id that can be reached by links. A NULL, empty or blank text has no shingles and no links.
    Rows that share a doc_id count as one document and get the same component. Rows with a NULL doc_id
    take no part: their component is NULL and they are kept. Other columns are ignored.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, mark_a long, mark_b long, bands array<long>"
    signed = stage(text.mapInArrow(_signatures(shingle), schema), "near-signatures")

    mark = ["mark_a", "mark_b", "n_shingles"]
    linkable = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stage(linkable.groupBy(*mark).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-classes")
    # A document of several rows may be in several classes; what it joins is one component.
    shared = (
        linkable.groupBy("doc_id").agg(F.count_distinct(*mark).alias("n")).where("n > 1").select("doc_id")
    )
    again = linkable.join(shared, "doc_id").join(classes.select(*mark, "rep"), mark)
    links = stage(
        again.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "near-links"
    )

    banded = classes.select("rep", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared_keys = stage(banded.join(sizes, "key").distinct(), "near-keys")
    # How many members a representative meets over all its keys: the original of a group meets most.
    weight = shared_keys.groupBy("rep").agg(F.sum("size").alias("weight"))
    members = stage(shared_keys.join(weight, "rep").select("key", "rep", "weight"), "near-bands")
    nodes = stage(_node_sets(text, members, classes, shingle), "near-sets")

    labels = components(links)
    for turn in range(CENTRES + 1):
        made = _leftover(members, labels, nodes, percent) if turn == CENTRES else _star_pairs(members, labels, turn)
        pairs = stage(made, f"near-pairs-{turn}")
        if pairs.isEmpty():
            continue
        links = links.unionByName(stage(_confirmed(pairs, nodes, percent), f"near-found-{turn}"))
        labels = components(links)

    # NULL doc_ids have no label and no class row.
    own = signed.select("doc_id", *mark).join(classes.select(*mark, "rep"), mark, "left")
    out = own.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _node_sets(text: DataFrame, members: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """Sketch and full set of every representative that shares a band key with another."""
    ids = members.select("rep").distinct()
    wanted = membership(ids.mapInArrow(_mixed_ids, "k long"), "k")
    found = text.where(F.col("doc_id").isNotNull()).mapInArrow(
        _sets(shingle, wanted), "doc_id long, n long, sketch binary, shingles array<long>"
    )
    return found.where("n > 0").join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _spanning(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, rep, label, weight) of keys that still span several components."""
    known = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    placed = known.select("key", "rep", "weight", F.coalesce("label", "rep").alias("label"))
    spans = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return placed.join(spans.select("key"), "key")


def _star_pairs(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Every key's members with its centre, the member that shares most keys with others.

    After the first turn, members that are in the component of that centre are left out, so what else
    hangs together in the key finds its own centre.
    """
    rows = _spanning(members, labels)
    for _ in range(turn + 1):
        centre = F.max(F.struct("weight", (-F.col("rep")).alias("order"), "label")).alias("c")
        main = rows.groupBy("key").agg(centre).select("key", (-F.col("c.order")).alias("centre"), F.col("c.label").alias("main"))
        rows = rows.join(main, "key").where("label != main")
        pairs = rows.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        rows = rows.select("key", "rep", "label", "weight")
    return pairs.distinct()


def _leftover(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that a prefix and positional filter on the full sets lets through.

    Sets are put in order of rarity among the members of keys that still span components. Two sets that reach the
    threshold have their first common shingle so early that what follows can still make up the needed
    overlap. Edits are rare, so a member too far from all others has nothing but its own edits there.
    """
    own = _spanning(members, labels).select("rep", "label").distinct()
    tokens = nodes.join(own.withColumnRenamed("rep", "doc_id"), "doc_id").select(
        F.col("doc_id").alias("rep"), "label", "n", F.explode("shingles").alias("token")
    )
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("rep").orderBy("f", "token")
    prefix = (
        tokens.join(seen, "token")
        .withColumn("place", F.row_number().over(order))
        .where(F.expr(f"f > 1 and place <= n - ({percent} * n + 99) div 100 + 1"))
        .select("token", "rep", "label", "n", "place")
    )
    prefix = stage(prefix, "near-prefixes")
    held = prefix.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = held.groupBy("token").agg(F.max_by("label", "c").alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = prefix.join(mixed.select("token", "main"), "token")
    outer = rows.where("label != main").select("token", *[F.col(c).alias(f"{c}_x") for c in ("rep", "label", "n", "place")])
    need = f"({percent} * (n + n_x) + {99 + percent}) div {100 + percent}"
    met = rows.join(outer, "token").where(
        f"label != label_x and (label = main or rep < rep_x) and least(n - place, n_x - place_x) + 1 >= {need}"
        f" and 100 * least(n, n_x) >= {percent} * greatest(n, n_x)"
    )
    return met.select(F.least("rep", "rep_x").alias("a"), F.greatest("rep", "rep_x").alias("b")).distinct()
