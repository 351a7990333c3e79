"""Chat formatting with typed content parts, in column expressions only.

A turn holds an ordered list of typed parts.  The visitor flattens them into
one string: text is escaped, an image, audio or document part becomes an
ordered placeholder ``<|kind:position|>`` and is recorded as an attachment with
its reference and the number of tokens that it expands to.  ``read_back``
parses the formatted string alone, so whatever it returns was really written.

Escaping: ``<``, any run of backslashes, ``|`` gets one more backslash, after
which no ``<|`` is left in a text.  Removing one backslash undoes it.  Text
parts in a row are joined first and escaped as one, so that no control string
forms where two of them meet; text is unescaped between placeholders likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import bind

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Tokens of an attachment: a base, and so many per unit (512-pixel tile, second of sound, page).
TOKENS = {"image": (85, 170), "audio": (0, 25), "document": (16, 600)}
#: Turns whose numbers fall into one block of this many are joined first, and then the blocks.
BLOCK = 512

PART_TYPE = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def text_part(text: Column) -> Column:
    """A single text part (null text: empty)."""
    return F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _kind(part: Column) -> Column:
    """Kinds that the table of token counts does not know are documents."""
    return F.when(part["type"].isin(*TOKENS), part["type"]).otherwise(F.lit("document"))


def _visit(parts: Column) -> Column:
    """One string for all parts: runs of text, escaped as a whole, with the placeholders between them."""
    others = F.filter(F.transform(parts, lambda p, i: F.when(~_is_text(p), i)), lambda i: i.isNotNull())

    def flat(at: Column) -> Column:
        def piece(k: Column) -> Column:
            first, end = F.coalesce(F.get(at, k - 1) + 1, F.lit(0)), F.coalesce(F.get(at, k), F.size(parts))
            text = F.array_join(F.transform(F.slice(parts, first + 1, end - first), lambda p: F.coalesce(p["text"], F.lit(""))), "")
            mark = F.concat(F.lit("<|"), _kind(F.get(parts, end)), F.lit(":"), end.cast("string"), F.lit("|>"))
            return F.concat(escape(text), F.when(k < F.size(at), mark).otherwise(""))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(at)), piece), "")

    return bind(others, flat)


def _attachment(part: Column) -> Column:
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
    tokens = F.lit(None).cast("bigint")
    for kind, (base, each) in TOKENS.items():
        tokens = F.when(_kind(part) == kind, F.lit(base) + F.lit(each) * units).otherwise(tokens)
    return F.struct(_kind(part).alias("kind"), part["ref"].alias("ref"), tokens.cast("bigint").alias("tokens"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted string per turn, without a shuffle.

    Input: conv_id, turn, role, parts (array of PART_TYPE).  Null parts are no
    parts, a null part is an empty text, a null role is the empty role.  Other
    columns are ignored.  Placeholders are numbered by position in the turn.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART_TYPE}>"))
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit(NEWLINE))
    body = _visit(parts)
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END)).alias("formatted"),
        F.transform(F.filter(parts, lambda p: ~_is_text(p)), _attachment).alias("attachments"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, attachments (in order), expanded_tokens: one row per conversation.

    Turns go by number, null first; rows that share a number go by their
    formatted string, and a repeated row stays twice.  Joining runs in two
    steps, blocks of turn numbers and then whole conversations, so that a very
    long conversation is sorted in pieces.
    """
    block = (
        format_turns(turns)
        .withColumn("block", F.floor(F.col("turn") / BLOCK))
        .groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "formatted", "attachments"))).alias("rows"))
        .select("conv_id", "block", F.array_join(F.col("rows.formatted"), "").alias("formatted"), F.flatten("rows.attachments").alias("attachments"))
    )
    return (
        block.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("block", "formatted", "attachments"))).alias("blocks"))
        .select("conv_id", F.array_join(F.col("blocks.formatted"), "").alias("formatted"), F.flatten("blocks.attachments").alias("attachments"))
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0))))
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns of a formatted string as array<struct<role, body>>; bodies are still escaped.

    A null string has no turns.  In a string that is not an output of this
    module, only what stands between a start and an end mark is a turn.
    """
    pieces = F.split(F.coalesce(formatted, F.lit("")), r"<\|im_end\|>\n", -1)

    def turn(piece: Column) -> Column:
        def cut(rest: Column) -> Column:
            role = F.substring_index(rest, "\n", 1)
            return F.struct(role.alias("role"), rest.substr(F.char_length(role) + 2, F.char_length(rest)).alias("body"))

        return bind(piece.substr(F.lit(len(START) + 1), F.char_length(piece)), cut)

    return F.transform(F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.startswith(p, F.lit(START))), turn)


def texts_of(body: Column) -> Column:
    """A body's text without placeholders, unescaped run by run."""
    return F.array_join(F.transform(F.split(body, r"<\|[a-z]+:[0-9]+\|>", -1), unescape), "")


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds n_turns, turns (array<struct<role, text>>) and loss_text, all parsed from ``formatted``."""
    turns = F.transform(
        parsed_turns(F.col("formatted")),
        lambda t: F.struct(unescape(F.replace(t["role"], F.lit(NEWLINE), F.lit("\n"))).alias("role"), texts_of(t["body"]).alias("text")),
    )
    return formatted.withColumn("turns", turns).withColumn("n_turns", F.size("turns").cast("bigint")).withColumn("loss_text", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), ""))
