"""Chat formatting: schema fingerprints select mappings of mixed layouts to turns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.arrays import sums_before

# Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
VARIANT_BYTES = 8 << 20  # longer records are read by their schema, as variants have a size limit


@dataclass(frozen=True)
class Layout:
    """A declared layout: where the turns of a record stand.

    ``fields`` are (role, path) pairs, one turn each, in order. ``messages`` is the path of
    an array whose elements hold a role and a text under ``role_key`` and ``text_key``;
    ``roles`` renames its roles. ``example`` records give the fingerprints.
    """

    name: str
    examples: tuple[dict, ...]
    fields: tuple[tuple[str, str], ...] = ()
    messages: str | None = None
    role_key: str = "role"
    text_key: str = "content"
    roles: dict[str, str] = field(default_factory=dict)

    def names(self) -> list[str]:
        """Names of the fields of a record."""
        return [path for _, path in self.fields] if self.messages is None else [self.messages]

    def schema(self) -> str:
        """Schema of a record, for readers that need one."""
        if self.messages is None:
            return ", ".join(f"`{path}` string" for path in self.names())
        return f"`{self.messages}` array<struct<`{self.role_key}`:string,`{self.text_key}`:string>>"

    def _turn(self, m: Column) -> Column:
        role = F.coalesce(m[self.role_key], F.lit(""))
        named = F.coalesce(
            *[F.when(role == old, F.lit(new)) for old, new in self.roles.items()], role
        )
        return F.struct(named.alias("role"), F.coalesce(m[self.text_key], F.lit("")).alias("text"))

    def turns_of(self, parsed: Column) -> Column:
        """Turns of a record that was read by its schema."""
        if self.messages is None:
            parts = [
                F.struct(F.lit(role).alias("role"), F.coalesce(parsed[path], F.lit("")).alias("text"))
                for role, path in self.fields
            ]
            return F.array(*parts).cast(TURNS)
        return F.transform(parsed[self.messages], self._turn).cast(TURNS)

    def turns(self, record: Column) -> Column:
        if self.messages is None:
            parts = [
                F.struct(
                    F.lit(role).alias("role"),
                    F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit("")).alias("text"),
                )
                for role, path in self.fields
            ]
            return F.array(*parts).cast(TURNS)
        kind = f"array<struct<`{self.role_key}`:string,`{self.text_key}`:string>>"
        return F.transform(
            F.try_variant_get(record, f"$.{self.messages}", kind), self._turn
        ).cast(TURNS)


def _chat(key: str, role: str, text: str) -> tuple[dict, ...]:
    return {key: [{role: "x", text: "y"}]}, {key: []}


LAYOUTS = (
    Layout(
        "prompt", ({"prompt": "x", "response": "y"},),
        fields=(("user", "prompt"), ("assistant", "response")),
    ),
    Layout(
        "instruction", ({"instruction": "x", "input": "y", "output": "z"},),
        fields=(("system", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout("messages", _chat("messages", "role", "content"), messages="messages"),
    Layout(
        "conversations", _chat("conversations", "from", "value"), messages="conversations",
        role_key="from", text_key="value", roles={"human": "user", "gpt": "assistant"},
    ),
)

_SCALAR = r"\b(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|BINARY|TIMESTAMP(?:_NTZ)?|DECIMAL\([0-9, ]+\))(?=[,>]|$)"


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant, whatever the types of its leaves."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), _SCALAR, "."))


def canonical_turns(
    records: DataFrame,
    layouts: tuple[Layout, ...] = LAYOUTS,
    id_column: str = "conv_id",
    record_column: str = "record",
) -> DataFrame:
    """Turns of JSON records in any of the declared layouts.

    The nested field paths of a record are hashed; the hash selects the mapping, so records
    are never tried against one layout after the other. Result: the id column,
    ``layout`` and ``turns`` (array of role and text). Records that match no layout, are no
    JSON or are null have a null layout and null turns, for the caller to inspect. A null
    text is empty; a null id stays null; repeated rows are converted each; an empty table
    gives an empty result. Other columns are ignored, so their names cannot clash. Records of
    more than ``VARIANT_BYTES`` are read by the declared schemas instead, and their layout is
    the one whose fields they have; a single text may then fill a string of Spark (2 GB).
    """
    raw = F.col(record_column)
    large = F.octet_length(raw) > VARIANT_BYTES
    schema = ", ".join(one.schema() for one in layouts)
    parsed = records.select(
        F.col(id_column).alias("id"),
        F.when(~large, F.try_parse_json(raw)).alias("record"),
        F.when(large, F.from_json(raw, schema, {"maxStringLen": str(2**31 - 1)})).alias("whole"),
    ).withColumn("mark", fingerprint(F.col("record")))
    names = [name for one in layouts for name in one.names()]
    present = F.array_compact(
        F.array(*[F.when(F.col(f"whole.`{n}`").isNotNull(), F.lit(n)) for n in names])
    )
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for one in reversed(layouts):
        marks = [fingerprint(F.parse_json(F.lit(json.dumps(x)))) for x in one.examples]
        match = F.col("mark").isin(*marks)
        found = F.col("whole").isNotNull() & (present == F.array(*[F.lit(n) for n in one.names()]))
        layout = F.when(match | F.coalesce(found, F.lit(False)), F.lit(one.name)).otherwise(layout)
        turns = (
            F.when(match, one.turns(F.col("record")))
            .when(found, one.turns_of(F.col("whole")))
            .otherwise(turns)
        )
    return parsed.select(F.col("id").alias(id_column), layout.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """Text without any control string: ``\\`` is doubled and ``<|`` becomes ``<\\|``."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """The text before ``escaped``: every backslash goes, what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(
        F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n")
    )


def formatted_chats(
    chats: DataFrame, learned: tuple[str, ...] = ("assistant",), id_column: str = "conv_id"
) -> DataFrame:
    """Template text and loss mask of canonical turns.

    Each turn is ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line
    break. Control strings inside roles and texts are escaped reversibly, so they cannot end
    a turn. Result: the id column, ``formatted`` and ``loss_mask``, an array of (start, length) in
    code points: the escaped texts of the learned roles, nothing else. Empty turns give an
    empty text and mask; null turns (a record of no known layout) give null, so that such a
    record is never taken for an empty chat. A null id stays null.
    """
    parts = chats.select(
        F.col(id_column).alias("id"),
        F.transform(
            "turns",
            lambda t: F.struct(
                _header(F.coalesce(t["role"], F.lit(""))).alias("head"),
                escaped(F.coalesce(t["text"], F.lit(""))).alias("body"),
                F.coalesce(t["role"], F.lit("")).isin(*learned).alias("learned"),
            ),
        ).alias("parts"),
    )
    tail = f"{END}\n"
    laid = parts.select(
        "id",
        "parts",
        F.array_join(
            F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), ""
        ).alias("formatted"),
        sums_before(
            F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(tail))
        ).alias("starts"),
    )
    spans = F.zip_with(
        "parts",
        "starts",
        lambda p, s: F.struct(
            p["learned"].alias("learned"),
            (s + F.length(p["head"])).alias("start"),
            F.length(p["body"]).alias("length"),
        ),
    )
    mask = F.transform(
        F.filter(spans, lambda x: x["learned"]),
        lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")),
    )
    return laid.select(F.col("id").alias(id_column), "formatted", mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds, unescaped."""
    def turn(piece):
        body = F.substring(piece, len(START) + 1, 2**31 - 1)
        head = F.regexp_extract(body, r"\A((?:[^\\\n]|\\[\s\S])*+)\n", 1)
        return F.struct(
            unescaped(head).alias("role"),
            unescaped(F.substring(body, F.length(head) + 2, F.lit(2**31 - 1))).alias("text"),
        )

    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def read_loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            mask, lambda m: unescaped(F.substring(formatted, m["start"] + 1, m["length"]))
        ),
        "",
    )
