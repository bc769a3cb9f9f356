"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in many layouts: messages, conversations, prompts with completions, instructions, rows
by turn. The fingerprint of a record is a hash of its known nested field paths that hold something;
it selects a declarative mapping from LAYOUTS, which yields the record's turns. Turns are written
with a template whose marks can not occur in a text: wherever a text has `<`, backslashes and `|`,
one more backslash is put in, and taken out again on reading. The result keeps the formatted text
as pieces, those under the loss mask marked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm import shared as s

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
ROLE_NAMES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout, and how its turns are read: from an array, or from single fields."""
    name: str
    fields: tuple[tuple[str, str], ...] = ()  # (role, path) of single fields; "+" joins to the one before
    array: str = ""
    role: str = ""
    text: str = ""

    @property
    def paths(self) -> list[str]:
        if self.array:
            return [f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"]
        return [p for _, p in self.fields]


LAYOUTS = (
    Layout("messages", array="messages", role="role", text="content"),
    Layout("conversations", array="conversations", role="from", text="value"),
    Layout("turns", array="turns", role="role", text="text"),
    Layout("prompt-completion", (("user", "prompt"), (ASSISTANT, "completion"))),
    Layout("system-prompt-completion", (("system", "system"), ("user", "prompt"), (ASSISTANT, "completion"))),
    Layout("prompt-response", (("user", "prompt"), (ASSISTANT, "response"))),
    Layout("system-prompt-response", (("system", "system"), ("user", "prompt"), (ASSISTANT, "response"))),
    Layout("instruction-output", (("user", "instruction"), (ASSISTANT, "output"))),
    Layout("instruction-input-output", (("user", "instruction"), ("+", "input"), (ASSISTANT, "output"))),
    Layout("question-answer", (("user", "question"), (ASSISTANT, "answer"))),
)
#: The layout with a row for each turn: (position, role, text).
BY_TURN = ("turn", "role", "text")


def field_paths(schema: T.StructType, before: str = "") -> list[str]:
    """Nested field paths of a schema; `[]` stands for the elements of an array."""
    out = []
    for field in schema:
        path, kind = f"{before}{field.name}", field.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = f"{path}[]", kind.elementType
        out += field_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [path]
    return out


def _hash(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def fingerprint(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the known paths that hold something in a row; other fields do not count.

    An array counts with the paths of its elements when it is not null, a single field when it
    is not null.
    """
    known = {p for x in layouts for p in x.paths}
    there = [p for p in field_paths(schema) if p in known]
    return _hash(F.filter(F.array(F.lit("").cast("string"), *(
        F.when(F.col(_quoted(p.split("[]")[0])).isNotNull(), F.lit(p)) for p in there)),
        lambda p: p.isNotNull() & (p != "")))


def _quoted(path: str) -> str:
    return ".".join(f"`{x}`" for x in path.split("."))


def _layout_hash(layout: Layout) -> Column:
    return _hash(F.array(*(F.lit(p) for p in layout.paths)))


def _turn(role: Column, text: Column) -> Column:
    named = F.coalesce(role.cast("string"), F.lit(""))
    named = F.coalesce(reduce(lambda c, kv: c.when(named == kv[0], F.lit(kv[1])), ROLE_NAMES.items(),
                              F.when(F.lit(False), named)), named)
    return F.struct(named.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _mapping(layout: Layout) -> Column:
    if layout.array:
        return F.transform(F.col(_quoted(layout.array)), lambda m: _turn(m[layout.role], m[layout.text]))
    turns: list[tuple[str, Column]] = []
    for role, path in layout.fields:
        text = F.col(_quoted(path))
        if role == "+":
            role, before = turns.pop()
            text = F.concat_ws("\n\n", before, F.when(text != "", text))
        turns.append((role, text))
    return F.array(*(_turn(F.lit(role), text) for role, text in turns))


def canonical_turns(records: DataFrame, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """key, layout, turns (role, text) of each record.

    Null roles and texts are empty; null elements count as empty turns. A record whose fingerprint
    no mapping has is kept, with a null layout and no turns.
    """
    present = set(field_paths(records.schema))
    usable = [x for x in layouts if present.issuperset(x.paths)]
    tagged = records.withColumn("__print", fingerprint(records.schema, layouts))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in usable:
        hit = F.col("__print") == _layout_hash(x)
        layout, turns = F.when(hit, F.lit(x.name)).otherwise(layout), F.when(hit, _mapping(x)).otherwise(turns)
    return tagged.select(F.col(f"`{key}`").alias("key"), layout.alias("layout"), turns.cast(TURNS).alias("turns"))


def gather_turns(rows: DataFrame, key: str) -> DataFrame:
    """Rows by turn as one record per key, in the layout `turns`.

    Turns are ordered by position, then role and text; null positions come first, repeated rows
    stay, null texts are empty. A conversation must fit in one row, as its digest needs it whole.
    """
    turn, role, text = (F.col(f"`{c}`") for c in BY_TURN)
    item = F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                    F.coalesce(text, F.lit("")).alias("text"))
    return rows.groupBy(F.col(f"`{key}`").alias(key)).agg(F.sort_array(F.collect_list(item)).alias("turns"))


# --- template -------------------------------------------------------------------------------------

def escape(text: Column) -> Column:
    """One backslash more between `<` and `|`, so that no mark can occur."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_turns(canonical: DataFrame) -> DataFrame:
    """key, layout, pieces (text, loss), written to the shared folder and read back."""
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        piece(F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")), no),
        piece(escape(t["text"]), t["role"] == ASSISTANT),
        piece(F.lit(END + "\n"), no))))
    return s.settle(canonical.select("key", "layout", pieces.alias("pieces")), "chat")


def formatted(pieces: str = "pieces") -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def parse(text: Column) -> Column:
    """Turns of a formatted text."""
    marked = F.split(text, r"<\|im_end\|>\n")

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        return F.struct(F.url_decode(F.substring(part, F.lit(len(START) + 1), line - len(START) - 1)).alias("role"),
                        unescape(F.substring(part, line + 1, F.length(part))).alias("text"))
    return F.transform(F.slice(marked, F.lit(1), F.size(marked) - 1), turn)


def loss_text(pieces: str = "pieces") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def turns_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digests(chat: DataFrame) -> DataFrame:
    """Per record, read back from the formatted text: counts and digests of turns and loss."""
    read = chat.select("key", "layout", formatted().alias("formatted"), loss_text().alias("loss"))
    read = read.select("key", "layout", F.length("formatted").cast("long").alias("formatted_chars"),
                       parse(F.col("formatted")).alias("turns"), "loss")
    return read.select(
        "key", "layout", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns_text(F.col("turns")), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars")
