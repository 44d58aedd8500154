"""Token counts by section: each document is encoded once, its tokens are laid over the sections.

The tokenizer works on bytes and its tokens, put together, are the text. So token spans follow from
running sums of token lengths, in characters through the positions of leading bytes. A token that overlaps
several sections goes to one of them by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary file is read by the driver and broadcast, so it must not be larger than this.
MAX_VOCABULARY_BYTES = 16 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("most", "first", "last")


def encoding(vocabulary: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("text", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(enc: tiktoken.Encoding) -> np.ndarray:
    out = np.zeros(enc.max_token_value + 1, np.int64)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = len(token)
    return out


def token_spans(text: str, ids: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters. A token that ends inside a character covers it."""
    edge = np.concatenate(([0], np.cumsum(lengths[np.array(ids, np.int64)])))
    if edge[-1] == len(text):
        return edge[:-1], edge[1:]
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(lead)))  # characters that begin before a byte
    begins = np.concatenate((lead, [True]))[edge[:-1]]
    return before[edge[:-1]] - ~begins, before[edge[1:]]


def attribute(start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Section of each token (-1 for none) and the number of tokens that overlap several.

    Sections are [lo, hi), sorted, without overlap. ``most``: the section that the token covers most of,
    the earlier one of equals; ``first`` and ``last``: the first or last section that it overlaps.
    """
    full = np.flatnonzero(hi > lo)  # an empty section holds nothing
    lo, hi = lo[full], hi[full]
    first = np.searchsorted(hi, start, "right")
    last = np.searchsorted(lo, end, "left") - 1
    home = np.where(first <= last, first, -1)
    many = np.flatnonzero(last > first)
    for t in many:
        k = np.arange(first[t], last[t] + 1)
        share = np.minimum(hi[k], end[t]) - np.maximum(lo[k], start[t])
        home[t] = {"most": k[share.argmax()], "first": k[0], "last": k[-1]}[rule]
    if full.size:
        home = np.where(home >= 0, full[home], -1)
    return home, many.size


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    separator: str = "\n",
    rule: str = "most",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """One row per input row: id, n_tokens, sections (array of start, end, n_tokens), n_outside, n_crossing.

    Sections are the parts between separators; the separators themselves are in none, and tokens that
    touch no section count as outside. A NULL or empty text has no tokens and no section. Equal rows give equal
    results; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if len(separator) != 1:
        raise ValueError("the separator is one character")
    with open(vocabulary, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("vocabulary file too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        lengths = token_lengths(enc)
        for batch in batches:
            totals, sections, outside, crossings = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                ids = enc.encode_ordinary(text)
                start, end = token_spans(text, ids, lengths)
                sizes = np.array([len(p) for p in text.split(separator)] if text else [], np.int64)
                hi = np.cumsum(sizes + 1) - 1
                lo = hi - sizes
                home, crossing = attribute(start, end, lo, hi, rule)
                counts = np.bincount(home[home >= 0], minlength=sizes.size)
                totals.append(len(ids))
                sections.append([{"start": s, "end": e, "n_tokens": n} for s, e, n in zip(lo.tolist(), hi.tolist(), counts.tolist())])
                outside.append(int((home < 0).sum()))
                crossings.append(int(crossing))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(totals, pa.int64()), pa.array(sections, kind), pa.array(outside, pa.int64()), pa.array(crossings, pa.int64())],
                ["id", "n_tokens", "sections", "n_outside", "n_crossing"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = (
        f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, "
        "sections array<struct<start:long,end:long,n_tokens:long>>, n_outside long, n_crossing long"
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
