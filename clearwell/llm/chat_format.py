"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come as JSON in whatever layout their source has. The nested field paths of a record, without its values, are
hashed to a fingerprint; the fingerprint selects a declarative mapping, which says where the turns are and what their
fields mean. Canonical turns are then written under one template whose marks cannot occur inside a text: control strings
in texts are escaped reversibly. A loss mask holds the places of the assistant's texts in the formatted string.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks. An escaped text holds no "<|", so a mark is always a mark.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Control strings of this and other templates, and what stands for them inside a text. The backslash is escaped first.
ESCAPES = (("<|", r"\l"), ("[INST]", r"\i"), ("[/INST]", r"\j"), ("<<SYS>>", r"\y"), ("<</SYS>>", r"\z"), ("<s>", r"\b"), ("</s>", r"\e"))


@dataclass(frozen=True)
class Mapping:
    """How a layout's turns are found.

    ``paths`` are the nested field paths that the layout has, arrays as ``[]``. ``turns`` lists (role, path) for layouts
    with one field a turn; absent or null fields give no turn. ``messages`` is the path of an array of messages
    instead, with the names of their role and text fields and what their role names mean.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()


_NAMES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), messages="messages"),
    Mapping("dialogue", ("conversations[].from", "conversations[].value"), messages="conversations", role="from", text="value", roles=_NAMES),
    Mapping("prompt", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_system", ("completion", "prompt", "system"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_system", ("instruction", "output", "system"), turns=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("question", ("answer", "question"), turns=(("user", "question"), ("assistant", "answer"))),
    Mapping("nested", ("input.question", "output.answer"), turns=(("user", "input.question"), ("assistant", "output.answer"))),
)


def _bare(schema: Column) -> Column:
    """A variant's schema without types: only names and nesting are left."""
    return F.regexp_replace(schema, r": (?!OBJECT<|ARRAY<)[A-Z]+(?:\(\d+(?:,\s*\d+)?\))?(?=[,>]|$)", "")


def layout_of(paths: tuple[str, ...]) -> str:
    """The nested paths as the engine writes a record's bare schema."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def show(node: dict) -> str:
        inner = []
        for name in sorted(node):
            bare = name.removesuffix("[]")
            if not node[name]:
                inner.append(bare)
            elif name.endswith("[]"):
                inner.append(f"{bare}: ARRAY<{show(node[name])}>")
            else:
                inner.append(f"{bare}: {show(node[name])}")
        return f"OBJECT<{', '.join(inner)}>"

    return show(tree)


#: Records of more characters are fingerprinted without their strings, which the parser takes up to a size only.
LONG_RECORD = 1_000_000
#: Strings of any length are read.
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


def _without_strings(record: Column) -> Column:
    """A JSON record with empty strings as values; names of fields stay."""
    inside = r'[^"\\]*+(?s:\\.[^"\\]*+)*+'
    return F.regexp_replace(record, rf'("{inside}"\s*+:)|("){inside}(")', "$1$2$3")


def fingerprint(record: Column) -> Column:
    """The hash of a JSON record's nested field paths; null where it is no JSON object. Values and their types do not count."""
    short = F.when(F.length(record) > LONG_RECORD, _without_strings(record)).otherwise(record)
    schema = F.schema_of_variant(F.try_parse_json(short))
    return F.when(schema.startswith("OBJECT<"), F.md5(_bare(schema)))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, marked in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    """Pairs of backslashes are split off first, so what is left of a backslash begins an escape."""
    def plain(piece: Column) -> Column:
        for old, marked in ESCAPES:
            piece = F.replace(piece, F.lit(marked), F.lit(old))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _read(record: str, paths: tuple[str, ...], kind: str = "string") -> dict[str, Column]:
    """The fields at ``paths`` of a JSON record, each of type ``kind``, from one parse; null where there is none."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def show(node: dict) -> str:
        return "struct<" + ", ".join(f"`{name}`: {show(inner) if inner else kind}" for name, inner in node.items()) + ">"

    parsed = F.from_json(F.col(record), show(tree), _ANY_LENGTH)
    out = {}
    for path in paths:
        out[path] = parsed
        for part in path.split("."):
            out[path] = out[path][part]
    return out


def _messages(record: str, m: Mapping) -> Column:
    items = _read(record, (m.messages,), f"array<struct<`{m.role}`: string, `{m.text}`: string>>")[m.messages]
    named = F.create_map(*(F.lit(x) for pair in m.roles for x in pair)) if m.roles else None

    def said(x: Column) -> Column:
        renamed = [F.try_element_at(named, x[m.role])] if named is not None else []
        return F.struct(F.coalesce(*renamed, x[m.role], F.lit("")).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text"))

    return F.transform(items, said)


def canonical_turns(df: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``df`` with ``layout`` (the mapping's name) and ``turns`` (array of role, text) in place of the JSON column ``record``.

    A record that is null, no JSON, or of a layout that no mapping declares has null ``layout`` and ``turns``: it is
    kept for the caller to look at, not dropped. A null text is an empty one in an array of messages; there, an unknown role
    name stays as it is. All other columns stay. Texts of any length that a row can hold come out whole.
    """
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    mark = F.col("_fingerprint")
    for m in mappings:
        is_it = mark == F.lit(hashlib.md5(layout_of(m.paths).encode()).hexdigest())
        if m.messages:
            found = _messages(record, m)
        else:
            fields = _read(record, tuple(path for _, path in m.turns))
            found = F.filter(
                F.array(*(F.struct(F.lit(role).alias("role"), fields[path].alias("text")) for role, path in m.turns)),
                lambda x: x["text"].isNotNull())
        layout, turns = F.when(is_it, m.name).otherwise(layout), F.when(is_it, found).otherwise(turns)
    named = df.withColumn("_fingerprint", fingerprint(F.col(record)))
    return named.withColumn("layout", layout).withColumn("turns", turns).drop("_fingerprint", record)


def format_turns(df: DataFrame) -> DataFrame:
    """``df`` with ``formatted`` and ``loss_mask`` (array of start, size in code points) made from ``turns``.

    The mask covers the assistant's texts as they stand in the formatted string, escapes included. No turns: an empty string.
    """
    def piece(t: Column) -> Column:
        return F.struct(t["role"].alias("role"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"), escape(t["text"]).alias("body"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        own = F.when(p["role"] == "assistant", F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("size")))).otherwise(F.array().cast("array<struct<start: int, size: int>>"))
        return F.struct((start + F.length(p["body"]) + len(END)).alias("at"), F.concat(acc["mask"], own).alias("mask"))

    pieces = F.transform("turns", piece)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, size: int>>").alias("mask"))
    return df.withColumn("_pieces", pieces).select(
        *df.columns,
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("_pieces", zero, step, lambda acc: acc["mask"]).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(TURN) + 1, 2**31 - 1), BODY, 1)).alias("role"),
        unescape(F.substring_index(x, BODY, -1)).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["size"]))), "")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn to one JSON ``record`` for each conv_id, in the layout that its roles fit.

    user, assistant: prompt and completion; system, user, assistant: instruction, output and system; all else an array
    of messages. Turns are in the order of (turn, role, text), nulls first, so repeated rows are repeated turns. Null
    roles and texts are empty strings. A conversation's record is one row, as its formatted text is.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: F.concat(F.lit("/"), x["role"])), "")
    text = lambda i: F.col("t")[i]["content"]
    return rows.select("conv_id", F.when(
        roles == "/user/assistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")))
    ).when(
        roles == "/system/user/assistant",
        F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
    ).otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))).alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from (conv_id, formatted, loss_mask)."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
