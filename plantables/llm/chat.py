"""Chat formatting: records of many layouts to canonical turns, and turns to one template.

A layout is told by its schema fingerprint, a hash of its nested field paths.
The fingerprint selects a declarative mapping: which paths hold which role.
Turns are then marked by control strings, and control strings inside texts
are escaped so that they can be read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Fields of a message that stand where it has no content.
CALLS = ("tool_calls", "function_call")
TURNS = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Mapping:
    """A layout: single turns as (role, paths joined by a blank line), a list of turns, or one turn a row."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None  # list, its role field, its text field
    row: tuple[str, str, str] | None = None  # turn, role, text
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))

    @property
    def paths(self) -> frozenset[str]:
        if self.row:
            return frozenset(self.row)
        if self.messages:
            top, role, text = self.messages
            return frozenset((f"{top}[]", f"{top}[].{role}", f"{top}[].{text}"))
        return frozenset(p for _, some in self.turns for p in some)


MAPPINGS = (
    Mapping("turn rows", row=("turn", "role", "text")),
    Mapping("messages", messages=("messages", "role", "content")),
    Mapping("conversations", messages=("conversations", "from", "value")),
    Mapping("system, prompt, completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt, completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt, response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction, input, output", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction, output", (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("question, answer", (("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}
_KNOWN = frozenset().union(*(m.paths for m in MAPPINGS))


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a Spark type; [] for what an array holds."""
    if isinstance(kind, T.StructType):
        return set().union(*({x} | schema_paths(f.dataType, x) for f in kind.fields for x in [f"{at}.{f.name}" if at else f.name])) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return {f"{at}[]"} | schema_paths(kind.elementType, f"{at}[]")
    return set()


def value_paths(value, at: str = "") -> set[str]:
    """The same of a parsed JSON value; fields that are null don't count."""
    if isinstance(value, dict):
        return set().union(*({x} | value_paths(v, x) for k, v in value.items() if v is not None for x in [f"{at}.{k}" if at else k])) if value else set()
    if isinstance(value, list):
        return {f"{at}[]"}.union(*(value_paths(v, f"{at}[]") for v in value))
    return set()


def select(paths: set[str]) -> Mapping | None:
    """The mapping of these paths, those aside that no mapping knows; else the widest that they hold."""
    known = {p for p in paths & _KNOWN if p.endswith("[]") or f"{p}[]" not in paths}
    if found := BY_FINGERPRINT.get(fingerprint(known)):
        return found
    held = [m for m in MAPPINGS if m.paths <= paths]
    return max(held, key=lambda m: len(m.paths), default=None)


def _plain(text: str) -> str:
    """Half surrogates, which JSON can spell but no encoding holds, as replacement marks."""
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def _text(value) -> str:
    """A JSON value as text: a string as it is, null empty, the parts of a list by blank lines (of an object with
    a text, that), and anything else as JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return _plain(value)
    if isinstance(value, list):
        return "\n\n".join(_text(x["text"] if isinstance(x, dict) and isinstance(x.get("text"), str) else x) for x in value)
    return _plain(json.dumps(value, ensure_ascii=False))


def _message(x: dict, who: str, what: str, roles: dict[str, str]) -> tuple[str, str]:
    """Role and text; a message without content says what tool it calls."""
    role, said = _text(x.get(who)), x.get(what)
    if said is None:
        said = next((x[c] for c in CALLS if x.get(c) is not None), None)
        said = None if said is None else json.dumps(said, ensure_ascii=False)
    return roles.get(role, role), _text(said)


def _are_messages(value) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(x, dict) and "role" in x for x in value)


def _turns_of(record: dict, m: Mapping) -> list[tuple[int, str, str]] | None:
    """(turn, role, text) of a record; None where it isn't of the layout after all."""
    roles = dict(m.roles)
    if m.row:
        turn, who, what = (record.get(x) for x in m.row)
        whole = isinstance(turn, int) and not isinstance(turn, bool) and abs(turn) < 1 << 63
        return [(turn, _text(who), _text(what))] if whole else None
    if m.messages:
        top, who, what = m.messages
        if not isinstance(record[top], list) or not all(isinstance(x, dict) for x in record[top]):
            return None
        said = [_message(x, who, what, roles) for x in record[top]]
    else:
        said = []
        for who, some in m.turns:
            value = record.get(some[0])
            if len(some) == 1 and _are_messages(value):  # a list of messages stands for one text
                said += [_message(x, "role", "content", roles) for x in value]
            else:
                said.append((who, "\n\n".join(filter(None, (_text(record.get(p)) for p in some)))))
    return [(i, *x) for i, x in enumerate(said)]


def from_json(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """Records as JSON text, each of its own layout -> conv_id, turn, role, text, layout.

    A record that is null, no JSON object, or of no known layout gives one row
    of turn -1, null role and layout, with the record as its text. Roles and
    texts that aren't strings are put into text as _text says.
    """

    def canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    record = json.loads(raw)
                    m = select(value_paths(record)) if isinstance(record, dict) else None
                except (TypeError, ValueError, RecursionError):
                    m = None
                turns = _turns_of(record, m) if m else None
                if turns is None:
                    out.append((conv, -1, None, raw, None))
                else:
                    out += [(conv, i, who, text, m.name) for i, who, text in turns]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col(id_column).cast("long"), F.col(json_column).cast("string")).mapInArrow(canonical, f"{TURNS}, layout string")


def _column_text(c: Column, kind: T.DataType) -> Column:
    """_text() of a column of some type."""
    if isinstance(kind, T.ArrayType):
        of = kind.elementType
        said = "text" if isinstance(of, T.StructType) and "text" in of.names and isinstance(of["text"].dataType, T.StringType) else None

        def part(x: Column) -> Column:
            whole = _column_text(x, of)
            return F.coalesce(x[said], whole) if said else whole

        c = F.array_join(F.transform(c, part), "\n\n")
    elif isinstance(kind, T.StructType | T.MapType):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def from_columns(df: DataFrame, id_column: str) -> DataFrame:
    """A table whose schema has a known layout -> conv_id, turn, role, text. ValueError if it has none.

    Columns that the layout doesn't name are left out. Null text is empty, and
    what isn't a string is put into text as in from_json. A row whose list of
    messages is null or empty has no turns.
    """
    m = select(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping for {sorted(schema_paths(df.schema))}")
    conv = F.col(id_column).cast("long").alias("conv_id")

    def role(of: Column) -> Column:
        named = of
        for a, b in m.roles:
            named = F.when(of == a, b).otherwise(named)
        return F.coalesce(named, F.lit(""))

    def messages(c: Column, of: T.StructType, who: str, what: str) -> Column:
        def one(x: Column) -> Column:
            said = F.coalesce(F.when(x[what].isNotNull(), _column_text(x[what], of[what].dataType)), *(F.to_json(x[n]) if isinstance(of[n].dataType, T.ArrayType | T.StructType | T.MapType) else x[n].cast("string") for n in CALLS if n in of.names), F.lit(""))
            return F.struct(role(_column_text(x[who], of[who].dataType)).alias("role"), said.alias("text"))

        return F.transform(c, one)

    kinds = {f.name: f.dataType for f in df.schema.fields}
    if m.row:
        turn, who, what = m.row
        return df.select(conv, F.col(turn).cast("long").alias("turn"), _column_text(F.col(who), kinds[who]).alias("role"), _column_text(F.col(what), kinds[what]).alias("text"))
    if m.messages:
        top, who, what = m.messages
        turns = messages(F.col(top), kinds[top].elementType, who, what)
    else:
        parts = []
        for who, some in m.turns:
            kind = kinds[some[0]]
            if len(some) == 1 and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"role", "content"} <= set(kind.elementType.names):
                parts.append(F.coalesce(messages(F.col(some[0]), kind.elementType, "role", "content"), F.array().cast("array<struct<role:string,text:string>>")))
            else:
                said = [_column_text(F.col(p), kinds[p]) for p in some]
                parts.append(F.array(F.struct(F.lit(who).alias("role"), F.concat_ws("\n\n", *(F.when(x != "", x) for x in said)).alias("text"))))
        turns = F.concat(*parts)
    return df.select(conv, F.posexplode(turns).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), "m.role", "m.text")


def escape(c: Column) -> Column:
    r"""Backslashes are doubled, and one stands within each "<|", so that no control string is left."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], text, flags=re.S)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, turn, piece, loss_start, loss_size.

    A conversation's output is its pieces joined in order of turn, then piece.
    The loss mask is the text of assistant turns: so many characters from
    loss_start on in the piece. Null role or text is empty. A piece is made
    of its row alone, so a conversation of any length stays in pieces.
    """
    who = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    text = escape(F.coalesce("text", F.lit("")))
    loss = F.col("role") == LOSS_ROLE
    head = F.concat(F.lit(OPEN), who, F.lit("\n"))
    return turns.select(
        "conv_id",
        "turn",
        F.concat(head, text, F.lit(f"{CLOSE}\n")).alias("piece"),
        F.when(loss, F.char_length(head)).alias("loss_start"),
        F.when(loss, F.char_length(text)).otherwise(0).alias("loss_size"),
    )


_PIECE = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Conversation:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, piece: str, start: int | None, size: int) -> None:
        at = 0
        for m in _PIECE.finditer(piece):
            if m.start() != at:
                break
            at = m.end()
            self.n += 1
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
        if at != len(piece):
            raise ValueError("output isn't made of whole turns")
        if start is not None:
            text = unescape(piece[start : start + size])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(piece)

    def row(self, conv) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """format_turns()'s output, parsed and unescaped -> a row for each conversation, with digests of its turns and loss.

    Each conversation's pieces go by in order, one after the other, with only
    the digests held. Turns of one number go in order of their pieces.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, began, done = _Conversation(), None, False, []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], [x.split()[0] for x in READ.split(", ")])

        for b in batches:
            for conv, piece, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if began and conv != key:
                    done.append(now.row(key))
                    now = _Conversation()
                key, began = conv, True
                now.add(piece, start, size)
            if done:
                yield out(done)
                done = []
        if began:
            yield out([now.row(key)])

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return ordered.select("conv_id", "piece", "loss_start", "loss_size").mapInArrow(digest, READ)
