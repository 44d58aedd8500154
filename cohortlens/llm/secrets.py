"""Secrets in text, with parts of credentials linked inside a scope.

One pass over the texts finds the base spans and weak parts: login names, opaque strings and endpoints that
mean nothing alone. An interval join then brings together parts of one document that lie within ``SCOPE``
characters: parts go to every bin of that width that they touch, each weak part meets its own and the two neighbouring bins.
A weak part is reported only when the parts that complete it are there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.session import stage

SCOPE = 400
BASE_KINDS = ("assign", "access", "hex")
#: Weak kinds by the role that they play in a credential.
WEAK_KINDS = ("login", "opaque", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "login": "id", "opaque": "secret", "endpoint": "place"}

_KEYWORDS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LOGIN = re.compile(r"""(?ai:\b(?:user(?:name)?|login|client_id)["']?)\x20?[:=]\x20?["']?([A-Za-z0-9._@-]{3,})""")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])")
_SCHEME_END, _AUTHORITY = "://", re.compile(r"[A-Za-z0-9.-]++(?::[0-9]{2,5}+(?![0-9]))?")
_PORT = re.compile(r"(?a):[0-9]{2,5}\b")
_SCHEME_CHARS, _HOST_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-"), frozenset("abcdefghijklmnopqrstuvwxyz0123456789.-")


def _run_start(text: str, end: int, inside: frozenset[str], least: int) -> int:
    """Where the run of characters of ``inside`` that ends at ``end`` begins, not before ``least``."""
    at = end
    while at > least and text[at - 1] in inside:
        at -= 1
    return at


def endpoints(text: str) -> list[tuple[int, int]]:
    """Spans of ``scheme://host`` and ``host.name:port``, grown to the left from their separators.

    Runs to the left end at any separator before, so the work is linear in the text. A scheme begins with a letter and does not
    follow a capital letter; a host has two labels or more.
    """
    urls: list[tuple[int, int]] = []
    at, least = text.find(_SCHEME_END), 0
    while at >= 0:
        start = _run_start(text, at, _SCHEME_CHARS, least)
        bound = start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")
        while start < at and (bound or not "a" <= text[start] <= "z"):
            bound = text[start].isalnum()
            start += 1
        host = _AUTHORITY.match(text, at + 3)
        least = at + 3
        if at - start >= 2 and host:
            urls.append((start, host.end()))
            least = host.end()
        at = text.find(_SCHEME_END, least)
    out, turn, least = list(urls), 0, 0
    for m in _PORT.finditer(text):
        while turn < len(urls) and urls[turn][1] <= m.start():
            least = max(least, urls[turn][1])
            turn += 1
        if turn < len(urls) and urls[turn][0] < m.end():
            continue
        start = _run_start(text, m.start(), _HOST_CHARS, least)
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            continue
        labels = text[start : m.start()].rpartition("..")[2].lstrip(".")
        if "." in labels.rstrip("."):
            host = labels.lstrip("-")
            if not host.endswith("."):
                out.append((m.start() - len(host), m.end()))
                least = m.end()
    return sorted(out)


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base spans and weak parts (kind, start, end), by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "user" in low or "login" in low or "client_id" in low:
        out += [("login", *m.span(1)) for m in _LOGIN.finditer(text)]
    if any(ROLES[k] == "id" for k, _, _ in out):
        seen = sorted((s, e) for _, s, e in out)
        starts, reach = [s for s, _ in seen], list(accumulate((e for _, e in seen), max))
        for m in _OPAQUE.finditer(text):
            # The farthest end of what begins before this string ends tells whether any of it overlaps.
            before = bisect_left(starts, m.end())
            if (not before or reach[before - 1] <= m.start()) and any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])):
                out.append(("opaque", *m.span()))
    if out and ":" in text:
        out += [("endpoint", *e) for e in endpoints(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 40
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t.as_py() or "")] for t in batch.column("text")]
        keys = pa.array(range(key, key + batch.num_rows), pa.int64())
        key += batch.num_rows
        yield pa.RecordBatch.from_arrays([keys, batch.column("id"), pa.array(found, kind)], ["key", "id", "parts"])


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak rows of ``parts`` (key, kind, start, end) that parts completing them accompany within ``scope``.

    A login needs a secret near, an opaque string needs an id, an endpoint needs both.
    """
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    rows = parts.withColumn("role", roles[F.col("kind")])
    low, high = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    weak = rows.where(F.col("kind").isin(*WEAK_KINDS)).withColumn("bin", F.explode(F.sequence(low - 1, high + 1)))
    near = rows.where("role != 'place'").withColumn("bin", F.explode(F.sequence(low, high))).select(
        "key", "bin", F.col("role").alias("other"), F.col("start").alias("from"), F.col("end").alias("to")
    )
    close = (F.col("from") <= F.col("end") + scope) & (F.col("start") <= F.col("to") + scope)
    apart = (F.col("from") != F.col("start")) | (F.col("to") != F.col("end"))
    met = (
        weak.join(near, ["key", "bin"]).where(close & apart)
        .groupBy("key", "kind", "start", "end", "role")
        .agg(F.bool_or(F.col("other") == "id").alias("has_id"), F.bool_or(F.col("other") == "secret").alias("has_secret"))
    )
    wanted = (F.col("role") == "id") & F.col("has_secret") | (F.col("role") == "secret") & F.col("has_id") | F.col("has_id") & F.col("has_secret")
    return met.where(wanted).select("key", "kind", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end) in code points, by start.

    A NULL or empty text has none. Base kinds are always reported; login, opaque and endpoint only as parts of a
    credential. Equal rows give equal results; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"key long, id {kind}, parts array<struct<kind:string,start:long,end:long>>"
    found = stage(rows.mapInArrow(_scan_batches, schema), "secret-parts")
    parts = found.where(F.exists("parts", lambda p: p["kind"].isin(*WEAK_KINDS))).select("key", F.inline("parts"))
    links = linked_parts(parts).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    order = F.create_map(*[F.lit(x) for k, kind_ in enumerate(KINDS) for x in (kind_, k)])
    base = F.filter("parts", lambda p: p["kind"].isin(*BASE_KINDS))
    both = F.concat(base, F.coalesce("linked", F.array().cast("array<struct<kind:string,start:long,end:long>>")))
    ranked = F.array_sort(F.transform(both, lambda p: F.struct(p["start"].alias("start"), order[p["kind"]].alias("rank"), p["end"].alias("end"), p["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    return found.join(links, "key", "left").select(F.col("id").alias(id_col), spans.alias("spans"))
