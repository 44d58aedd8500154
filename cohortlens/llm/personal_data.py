"""Personal data in text by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, schemes, digit pairs, country codes before
digits and identifier cues. At each anchor a deterministic parser expands left and right to the boundary of
the item and validates it. Parsers never look further left than the end of what they have read before,
so a text of any length is read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the anchors add to the base ones.
ADDED_KINDS = ("address", "account")
KINDS = BASE_KINDS + ADDED_KINDS
SPANS = "array<struct<kind:string,start:long,end:long>>"

# Schemes whose target is a person or carries a login
SCHEMES = ("mailto:", "tel:", "sms:", "sip:", "ftp://", "http://", "https://", "ssh://", "postgresql://", "mongodb://")
# Words that announce an account or identity number
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn", "social security")
# Length of an international bank account number by country
IBAN_LENGTH = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

_DIGITS = "0123456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOCAL = _DIGITS + _LETTERS + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_RUN = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIALLED = re.compile(r"\+?[0-9(][0-9() .-]{5,}[0-9]")
_USER = re.compile(r"[A-Za-z0-9._%+-]++")
_PASSWORD = re.compile(r"[^\s@/]*+")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_NUMBER = re.compile(r"(?: ?(?ai:number|no\.?|nr\.?))? ?[:=#]? ?([A-Z]{0,2}[0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_IBAN = {c: re.compile(rf"{c}(?: ?[A-Z0-9]){{{n - 2}}}(?![A-Za-z0-9])") for c, n in IBAN_LENGTH.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban(code: str) -> bool:
    if len(code) != IBAN_LENGTH.get(code[:2], -1):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _iban_at(text: str, at: int) -> re.Match[str] | None:
    """A valid number of exactly its country's length, whatever follows after a blank."""
    pattern = _IBAN.get(text[at : at + 2])
    m = pattern and pattern.match(text, at)
    return m if m and iban(m[0].replace(" ", "")) else None


class _Logins:
    """Ends of user[:password]@host from rising positions of one text; no stretch is read twice."""

    def __init__(self, text: str) -> None:
        self.text, self.run, self.hosts = text, 0, {}

    def end(self, at: int) -> int:
        """0 if there is none at ``at``."""
        user = _USER.match(self.text, at)
        if not user:
            return 0
        stop = user.end()
        if self.text[stop : stop + 1] == ":":
            if stop + 1 >= self.run:
                self.run = _PASSWORD.match(self.text, stop + 1).end()
            if self.run == stop + 1:
                return 0
            stop = self.run
        if self.text[stop : stop + 1] != "@":
            return 0
        if stop not in self.hosts:
            host = _HOST.match(self.text, stop + 1)
            self.hosts[stop] = host.end() if host else 0
        return self.hosts[stop]


def _byte(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def automaton() -> Any:
    """Anchors in small letters, to be looked for in the text of :func:`_lowered`."""
    found = ahocorasick.Automaton()

    def add(word: str, what: str) -> None:
        found.add_word(word, (what, len(word)))

    add("@", "at")
    add("+", "plus")
    for a, b in product(_DIGITS, repeat=2):
        add(f"{a}.{b}", "dot")
        for gap in ("", " ", "-"):
            add(f"{a}{gap}{b}", "pair")
    for country, d in product(IBAN_LENGTH, _DIGITS):
        add(country.lower() + d, "country")
    for what, words in (("scheme", SCHEMES), ("cue", CUES)):
        for word in words:
            add(word, what)
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """ASCII letters lowered, so that every place stays the same."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(text: str, anchors: Any) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, end exclusive, in the order of KINDS, then start."""
    out: list[tuple[str, int, int]] = []
    added: list[tuple[str, int, int]] = []
    mail = last_at = dotted = chain = 0
    logins = _Logins(text)
    for last, (what, width) in anchors.iter(_lowered(text)):
        at = last - width + 1
        if what == "at":
            lo = max(mail, last_at)
            last_at = at + 1
            start = lo + len(text[lo:at].rstrip(_LOCAL))
            domain = start < at and _DOMAIN.match(text, at + 1)
            if domain:
                mail = domain.end()
                out.append(("email", start, mail))
        elif what == "dot":
            if at < dotted:
                continue
            start = dotted + len(text[dotted : at + 1].rstrip(_DIGITS))
            dotted = _DOTTED.match(text, start).end()
            runs = [m.span() for m in _RUN.finditer(text, start, dotted)]
            for k in range(0, len(runs) - 3, 4):
                if all(_byte(text[s:e]) for s, e in runs[k : k + 4]):
                    out.append(("ip", runs[k][0], runs[k + 3][1]))
        elif what == "pair":
            if at < chain:
                continue
            chain = _CARD.match(text, at).end()
            if chain - at < 16:
                continue
            digits = text[at:chain].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", at, chain))
        elif what == "plus":
            m = _PHONE.match(text, at)
            if m and 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
        elif what == "scheme":
            person = text[at : last + 1].lower() in ("tel:", "sms:")
            m = person and _DIALLED.match(text, last + 1)
            end = m.end() if m else 0 if person else logins.end(last + 1)
            if end:
                added.append(("address", at, end))
        elif what == "country":
            m = (at == 0 or not text[at - 1].isalnum()) and _iban_at(text, at)
            if m:
                added.append(("account", *m.span()))
        elif at == 0 or not text[at - 1].isalnum():
            m = _NUMBER.match(text, last + 1)
            if m and not _iban_at(text, m.start(1)) and sum(c in _DIGITS for c in m[1]) >= 6:
                added.append(("account", *m.span(1)))
    # An added span must not repeat what a base span or an earlier added one of its kind covers.
    base = [(s, e) for _, s, e in out]
    taken: dict[str, int] = {}
    for kind, start, end in sorted(set(added), key=lambda x: (x[1], -x[2])):
        if start >= taken.get(kind, 0) and (kind == "address" or not any(s < end and start < e for s, e in base)):
            out.append((kind, start, end))
            taken[kind] = end
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts = batch.column("text")
        found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t.as_py() or "", anchors)] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], ["id", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end) in code points.

    A NULL or empty text has none. Base kinds are what their patterns match, leftmost and without overlap,
    and pass the check of the kind. ``address``: a URI that names a person's number or carries a login.
    ``account``: a valid international account number, or a number of six or more digits right after a cue. Equal rows
    give equal results; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan_batches, f"id {kind}, spans {SPANS}").select(F.col("id").alias(id_col), "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
