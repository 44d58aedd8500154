r"""Chat formatting: records of several layouts become canonical turns, then text under one template with a loss mask.

A record is JSON text or a VARIANT. The nested field paths of its schema (``messages[].role``) that any layout knows are
hashed to a fingerprint, and the fingerprint selects the layout, a declarative mapping from paths to turns. Paths that
no layout knows don't count, so extra fields do no harm. All of it is column expressions.

Template: ``### role:``, line feed, text, ``</turn>``, line feed. Inside a text ``\`` becomes ``\\``, ``</turn>`` becomes
``<\/turn>`` and ``###`` becomes ``\###``, inside a role also ``:`` and a line feed after it become ``:\`` and the line feed. So no
control string is left inside, and leaving out each first backslash gives the text back.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>"
MARK = "###"
#: Kinds of turns that count for the loss.
LEARNT = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Listed:
    """A list of turns: paths of the list and, inside its elements, of the role and the text."""

    name: str
    turns: str
    role: str
    text: str
    aliases: Mapping[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    def required(self) -> tuple[str, ...]:
        return (self.turns, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}")

    def extra(self) -> tuple[str, ...]:
        return tuple(f"{self.turns}[].{c}" for c in self.optional)

    def read(self, record: Column) -> Column:
        kind = f"array<struct<`{self.role}`:string,`{self.text}`:string>>"
        listed = F.coalesce(F.try_variant_get(record, f"$.{self.turns}", kind), F.array().cast(kind))
        return F.transform(listed, lambda t: _turn(self._role(t[self.role]), t[self.text]))

    def _role(self, role: Column) -> Column:
        if not self.aliases:
            return role
        known = F.create_map(*[F.lit(x) for pair in self.aliases.items() for x in pair])
        return F.coalesce(F.try_element_at(known, role), role)


@dataclass(frozen=True)
class Flat:
    """Turns in fields of the record: (role, fields). Fields that a turn joins are put one below the other if not empty.

    A turn of which no field is there is left out.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def required(self) -> tuple[str, ...]:
        return tuple(f for _, fields in self.turns for f in fields if f not in self.optional)

    def extra(self) -> tuple[str, ...]:
        return self.optional

    def read(self, record: Column) -> Column:
        made = []
        for role, fields in self.turns:
            values = [F.try_variant_get(record, f"$.{f}", "string") for f in fields]
            if len(values) == 1:
                text = values[0]
            else:
                there = F.filter(F.array(*values), lambda v: v.isNotNull())
                text = F.when(F.size(there) > 0, F.array_join(F.filter(there, lambda v: v != ""), "\n\n"))
            made.append(F.when(text.isNotNull(), _turn(F.lit(role), text)))
        return F.filter(F.array(*made), lambda t: t.isNotNull())


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


# Field names of common layouts of chat data.
LAYOUTS: tuple[Listed | Flat, ...] = (
    Listed("messages", "messages", "role", "content", optional=("name", "weight")),
    Listed("turns", "turns", "role", "text"),
    Listed("share", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Flat("prompt_completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), ("system",)),
    Flat("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    Flat("question_answer", (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",))), ("system",)),
    Flat(
        "instruction",
        (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
        ("system", "input"),
    ),
)

# A token of a printed schema: a field name with its colon, an opening or a closing bracket. Scalar types are skipped.
_TOKEN = r"`(?:[^`]|``)*`: |[A-Za-z0-9_]+: |OBJECT<|ARRAY<|>"


def field_paths(record: Column) -> Column:
    """Nested field paths of a VARIANT, ``a.b`` for objects and ``a[].b`` for lists; a mixed list has no inner paths."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_TOKEN), F.lit(0))
    empty = F.struct(F.array(F.lit("")).alias("open"), F.array().cast("array<string>").alias("found"), F.lit("").alias("at"))

    def step(state: Column, token: Column) -> Column:
        opened, found, at = state["open"], state["found"], state["at"]
        base = F.element_at(opened, -1)
        name = F.regexp_replace(F.regexp_replace(token, ": $", ""), "^`|`$", "")
        path = F.when(base == "", name).otherwise(F.concat(base, F.lit("."), name))
        named = F.struct(opened.alias("open"), F.array_append(found, path).alias("found"), path.alias("at"))
        inner = F.struct(F.array_append(opened, at).alias("open"), found.alias("found"), at.alias("at"))
        listed = F.concat(at, F.lit("[]"))
        each = F.struct(F.array_append(opened, at).alias("open"), found.alias("found"), listed.alias("at"))
        closed = F.struct(F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(1))).alias("open"), found.alias("found"), base.alias("at"))
        return (
            F.when(token == "OBJECT<", inner).when(token == "ARRAY<", each).when(token == ">", closed).otherwise(named)
        )

    return F.aggregate(tokens, empty, step, lambda s: s["found"])


def _hash(paths: Iterable[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def fingerprint(record: Column, layouts: Sequence[Listed | Flat] = LAYOUTS) -> Column:
    """Hash of the sorted field paths of a record that one of the layouts knows; NULL for an unreadable record."""
    known = sorted({p for x in layouts for p in (*x.required(), *x.extra())})
    mine = F.array_intersect(F.array(*[F.lit(p) for p in known]), field_paths(record))
    return F.when(record.isNotNull(), F.xxhash64(F.array_join(F.array_sort(mine), "\n")))


def _prints(layout: Listed | Flat) -> list[Column]:
    """A fingerprint for each choice of optional paths."""
    extra = layout.extra()
    chosen = itertools.chain.from_iterable(itertools.combinations(extra, n) for n in range(len(extra) + 1))
    return [_hash((*layout.required(), *c)) for c in chosen]


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: Sequence[Listed | Flat] = LAYOUTS) -> DataFrame:
    """The input's columns with ``layout`` and ``turns``, an array of (role, text).

    Layout and turns are NULL for a record that can't be read or whose fingerprint is that of no layout; the
    caller decides what to do with these. A list without turns, or with elements that are no objects, shows no inner paths and so
    no layout either. NULL roles and texts are empty. Columns of the input named layout or turns are replaced.
    """
    raw = F.col(f"`{record_col}`")
    record = raw if dict(records.dtypes)[record_col] == "variant" else F.try_parse_json(raw)
    seen = records.select(*[F.col(f"`{c}`") for c in records.columns if c not in ("layout", "turns", "_record")], record.alias("_record"))
    seen = seen.withColumn("_print", fingerprint(F.col("_record"), layouts))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for x in reversed(layouts):
        mine = F.col("_print").isin(*_prints(x))
        layout = F.when(mine, F.lit(x.name)).otherwise(layout)
        turns = F.when(mine, x.read(F.col("_record"))).otherwise(turns)
    return seen.withColumns({"layout": layout, "turns": turns}).drop("_record", "_print")


def escape_text(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit(TURN_END), F.lit("<\\/turn>")), F.lit(MARK), F.lit("\\" + MARK))


def escape_role(role: Column) -> Column:
    return F.replace(escape_text(role), F.lit(":\n"), F.lit(":\\\n"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def pieces(turns: Column, learnt: str = LEARNT) -> Column:
    """Formatted text of the turns in pieces (text, loss): their concatenation is the whole, ``loss`` is the mask."""

    def one(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(MARK + " "), escape_role(t["role"]), F.lit(":\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape_text(t["text"]).alias("text"), (t["role"] == learnt).alias("loss")),
            F.struct(F.lit(TURN_END + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, one))


def formatted_text(made: Column) -> Column:
    return F.array_join(F.transform(made, lambda p: p["text"]), "")


def learnt_text(made: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(made, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted text."""

    def one(part: Column) -> Column:
        at = F.instr(part, ":\n")
        role = F.substring(part, F.lit(len(MARK) + 2), at - F.lit(len(MARK) + 2))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(part, at + 2, F.length(part))).alias("text"))

    return F.transform(F.filter(F.split(formatted, TURN_END + "\n", -1), lambda p: p != ""), one)


def format_chats(records: DataFrame, record_col: str = "record", layouts: Sequence[Listed | Flat] = LAYOUTS, learnt: str = LEARNT) -> DataFrame:
    """:func:`canonical_turns` with ``pieces`` (text, loss) and ``formatted``, both NULL where there are no turns.

    Repeated records give repeated rows; extra columns pass through, those named like a column of the result are replaced.
    """
    own = ("layout", "turns", "pieces", "formatted")
    rest = records.select(*[F.col(f"`{c}`") for c in records.columns if c == record_col or c not in own])
    turned = canonical_turns(rest, record_col, layouts)
    return turned.withColumn("pieces", pieces(F.col("turns"), learnt)).withColumn("formatted", formatted_text(F.col("pieces")))


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): conversations stored one turn a row (conv_id, turn, role, text) as JSON records.

    Two or three turns in plain order are written as prompt and completion, with the system text if there is one, others as a list of
    messages. Turns go by turn, NULL first, equal ones by role and text; NULL roles and texts are empty. Rows without
    a conv_id are one conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    role = lambda i: F.try_element_at("t", F.lit(i))["role"]
    text = lambda i: F.try_element_at("t", F.lit(i))["content"]
    plain = (F.size("t") == 2) & (role(1) == "user") & (role(2) == "assistant")
    led = (F.size("t") == 3) & (role(1) == "system") & (role(2) == "user") & (role(3) == "assistant")
    listed = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    record = (
        F.when(plain, F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("completion"))))
        .when(led, F.to_json(F.struct(text(1).alias("system"), text(2).alias("prompt"), text(3).alias("completion"))))
        .otherwise(F.to_json(F.struct(listed.alias("messages"))))
    )
    return told.select("conv_id", record.alias("record"))
