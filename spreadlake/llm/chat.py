"""Chat formatting by schema fingerprints.

Records of many layouts (message lists, prompt and answer, instruction, input
and output, one row per turn) become canonical turns and then text with a loss
mask.  A record's layout is recognised by the hash of its sorted nested field
paths, and the hash selects a declarative mapping.  Only DataFrame expressions
are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlake.llm.common import fresh

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """One input layout: the paths that name it, and where its turns are.

    ``[]`` in a path is the element of a list.  ``messages`` names a list of
    (role, text) fields; ``fields`` names (role, path) pairs of single turns in
    order; ``row`` names (order, role, text) of layouts with one turn per row.
    """

    name: str
    paths: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    row: tuple[str, str, str] | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), row=("turn", "role", "text")),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Layout("instruction_input", ("input", "instruction", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)
#: Names of one role in different layouts, as fixed text.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Every nested field path of a schema; ``[]`` marks list elements."""
    out = []
    for field in schema.fields:
        path, kind = f"{prefix}{field.name}", field.dataType
        out.append(path)
        while isinstance(kind, T.ArrayType):
            path, kind = f"{path}[]", kind.elementType
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, f"{path}.")
    return out


def fingerprint(schema: T.StructType, ignore: Sequence[str] = ()) -> Column:
    """Each row's fingerprint: the hash of the sorted paths under the fields that are not null in it.

    Equals :func:`fingerprint_of` of those paths.  Fields in ``ignore`` (ids,
    extra columns) don't count.
    """
    kept = [f for f in schema.fields if f.name not in ignore]
    lists = [F.when(F.col(f"`{f.name}`").isNotNull(), F.array(*map(F.lit, schema_paths(T.StructType([f]))))) for f in kept]
    if not lists:
        return F.lit(fingerprint_of([]))
    present = F.array_sort(F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull())))
    return F.sha2(F.array_join(present, "\n"), 256)


def canonical_turns(records: DataFrame, id_col: str, layouts: Sequence[Layout] = LAYOUTS, ignore: Sequence[str] = ()) -> DataFrame:
    """``id_col``, ``layout`` and ``turns`` (role, text) of each record or conversation, from typed columns.

    The fields that make up a row's fingerprint are all but ``id_col`` and
    ``ignore`` that are not null in it.  Rows whose fingerprint no layout has
    keep their id with ``layout`` null and no turns.  Turn rows are gathered by
    id and ordered by turn, then role and text (ties and repeated rows stay, in
    that order; a null turn comes first); they are the only rows that are
    shuffled.  Null roles and texts become empty; rows with a null id form one
    conversation in turn rows and stay single elsewhere.  An empty table gives
    no rows; a conversation is one row and its texts, of any length, stay whole.
    """
    schema = T.StructType([f for f in records.schema.fields if f.name != id_col and f.name not in ignore])
    known = set(schema_paths(schema))
    usable = [x for x in layouts if set(x.paths) <= known]
    rec = F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]) if schema.fields else F.lit(None)
    marked = records.select(F.col(f"`{id_col}`").alias("id"), fingerprint(schema).alias("print"), rec.alias("rec"))

    def at(path: str, kind: str) -> Column:
        out = F.col("rec")
        for step in path.split("."):
            out = out.getField(step)
        return out

    return _routed(marked, usable, at, Layout.fingerprint.fget).withColumnRenamed("id", id_col)


def record_turns(records: DataFrame, id_col: str, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """As :func:`canonical_turns`, of records of any layouts in one VARIANT column (parsed JSON, or rows by ``to_variant_object``).

    Here the fingerprint is that of the record itself: the hash of the nested
    field paths it holds, whatever types they have.  A field that is there and
    null is one of its paths, so a null text is an empty text and not another
    layout.  A list without elements names no paths below it; such a record, a
    null one and one of unknown paths keep their id with ``layout`` null.
    """
    marked = records.select(F.col(f"`{id_col}`").alias("id"), record_fingerprint(F.col(f"`{record}`")).alias("print"), F.col(f"`{record}`").alias("rec"))
    at = lambda path, kind: F.try_variant_get("rec", "$." + path, kind)
    return _routed(marked, layouts, at, lambda x: hashlib.sha256(record_shape(x.paths).encode()).hexdigest()).withColumnRenamed("id", id_col)


# Types in the text of a record's schema: those of a field, and those of a list's elements.
_FIELD_TYPE, _ELEMENT_TYPE = r": [A-Z_]+(?:\([0-9, ]+\))?(?=[,>])", r"(ARRAY<)[A-Z_]+(?:\([0-9, ]+\))?(?=>)"


def record_fingerprint(record: Column) -> Column:
    """The hash of a VARIANT record's nested field paths; equals that of :func:`record_shape` of the same paths."""
    return F.sha2(F.regexp_replace(F.regexp_replace(F.schema_of_variant(record), _FIELD_TYPE, ": "), _ELEMENT_TYPE, "$1"), 256)


def record_shape(paths: Sequence[str]) -> str:
    """Paths as the text of a schema without types: fields by name, lists around what they hold."""
    below: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        below.setdefault(head.replace("[]", ""), []).append("[]" * head.count("[]") + ("." + rest if rest else ""))

    def shape(rests: list[str]) -> str:
        inner = [r for r in rests if r]
        if any(r.startswith("[]") for r in inner):
            return "ARRAY<" + shape([r[2:] for r in inner]) + ">"
        return record_shape([r[1:] for r in inner]) if inner else ""

    return "OBJECT<" + ", ".join(f"{name}: {shape(rests)}" for name, rests in sorted(below.items())) + ">"


def _routed(marked: DataFrame, layouts: Sequence[Layout], at, print_of) -> DataFrame:
    """Each row (id, print, rec) through the mapping of the layout whose fingerprint it has."""
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in reversed(layouts):
        is_x = F.col("print") == print_of(x)
        layout = F.when(is_x, F.lit(x.name)).otherwise(layout)
        if x.row is None:
            turns = F.when(is_x, _mapped(x, at)).otherwise(turns)
    rows = next((x for x in layouts if x.row), None)
    if rows is None:
        return marked.select("id", layout.alias("layout"), turns.alias("turns"))
    order, role, text = rows.row
    is_row = F.coalesce(F.col("print") == print_of(rows), F.lit(False))
    item = F.struct(at(order, "bigint").alias("turn"), _text(at(role, "string")).alias("role"), _text(at(text, "string")).alias("text"))
    gathered = (
        marked.filter(is_row)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select("id", F.lit(rows.name).alias("layout"), F.transform("items", lambda i: F.struct(i["role"].alias("role"), i["text"].alias("text"))).cast(TURNS).alias("turns"))
    )
    return marked.filter(~is_row).select("id", layout.alias("layout"), turns.alias("turns")).unionByName(gathered)


def _role(role: Column) -> Column:
    """A role under its canonical name; turn rows keep theirs as they are."""
    named = F.coalesce(role.cast("string"), F.lit(""))
    out = named
    for name, canonical in ROLES.items():
        out = F.when(named == name, F.lit(canonical)).otherwise(out)
    return out


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _mapped(x: Layout, at) -> Column:
    """The turns of a record by its layout's mapping; ``at(path, type)`` reads the record."""
    if x.messages:
        name, role, text = x.messages
        said = at(name, f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(F.filter(said, lambda m: m.isNotNull()), lambda m: F.struct(_role(m[role]).alias("role"), _text(m[text]).alias("text"))).cast(TURNS)
    turns = [F.struct(F.lit(role).alias("role"), _text(at(path, "string")).alias("text")) for role, path in x.fields]
    # an empty optional field (the input of an instruction) is no turn of its own
    return F.filter(F.array(*turns), lambda t: (t["text"] != "") | (t["role"] == "assistant")).cast(TURNS)


# --- template ---------------------------------------------------------------------------------

#: A turn is ``<|role|>``, newline, text, ``<|end|>``, newline.
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
# Control strings: those of this template and of other chat templates, which a tokenizer may know as special.
# Inside a text, a backslash goes behind the first character; where backslashes already stand there, one more.
_CONTROL = r"([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
_ESCAPED = r"([<\[])\\(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role must not hold the mark that closes it either."""
    return F.regexp_replace(escape(role), r"\|(\\*)>", r"|\\$1>")


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"\|\\(\\*)>", "|$1>"))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``formatted`` and ``loss_spans``: (start, length) of each assistant text in it, in code points from 0."""
    lengths = lambda t: F.length(t["piece"])
    pieces = F.transform(turns, lambda t: F.struct(
        (t["role"] == "assistant").alias("loss"),
        (F.length(F.lit(OPEN + SHUT)) + F.length(_escape_role(t["role"]))).alias("head"),
        F.length(escape(t["text"])).alias("body"),
        F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit(SHUT), escape(t["text"]), F.lit(END)).alias("piece"),
    ))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    cut = fresh(df, "pieces")
    walked = F.aggregate(cut, start, lambda acc, p: F.struct(
        (acc["at"] + lengths(p)).alias("at"),
        F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    ), lambda acc: acc["spans"])
    return (
        df.withColumn(cut, pieces)
        .withColumn("formatted", F.array_join(F.transform(cut, lambda p: p["piece"]), ""))
        .withColumn("loss_spans", walked)
        .drop(cut)
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from formatted text."""
    cut = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x != "")
    head = lambda x: F.instr(x, SHUT)
    return F.transform(cut, lambda x: F.struct(
        _unescape_role(F.substr(x, F.lit(len(OPEN) + 1), head(x) - F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(x, head(x) + F.lit(len(SHUT)))).alias("text"),
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
