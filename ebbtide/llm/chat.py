r"""Conversations as one text each, checked by reading them back.

A turn is written as `### Role: text`, a line feed, `</turn>` and a line feed.
Roles other than system, user and assistant stand in quotes. Inside a text a
control string (`### ` or `</turn>`) is not allowed as such: with the
backslashes before it, it gets one more backslash, and the reader takes one off.
Texts are first written as they are; a turn that does not come back as it was
is escaped, and a conversation that still differs is escaped throughout.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\n</turn>\n"
CONTROL = r"(?:### |</turn>)"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
HEAD = r'^### (System|User|Assistant|"(?:[^"\\]|\\[\s\S])*"): '


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def _label(role: Column) -> Column:
    out = F.concat(F.lit('"'), F.regexp_replace(escape(role), r'(["\\])', r"\\$1"), F.lit('"'))
    for key, name in NAMES.items():
        out = F.when(role == key, name).otherwise(out)
    return out


def render(turns: Column, escaped) -> Column:
    """The text of turns array<struct<role, text, ..>>; `escaped(turn)` says which texts to escape."""
    one = lambda t: F.concat(
        F.lit("### "), _label(t["role"]), F.lit(": "), F.when(escaped(t), escape(t["text"])).otherwise(t["text"]), F.lit(END)
    )
    return F.concat_ws("", F.transform(turns, one))


def _pieces(formatted: Column) -> Column:
    parts = F.split(formatted, END, -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text; text is null where a turn breaks the grammar."""

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, HEAD, 0)
        label = F.regexp_extract(piece, HEAD, 1)
        body = F.substr(piece, F.length(head) + 1, F.length(piece))
        quoted = F.regexp_replace(F.substr(label, F.lit(2), F.length(label) - 2), r"\\([\s\S])", "$1")
        role = unescape(quoted)
        for key, name in NAMES.items():
            role = F.when(label == name, key).otherwise(role)
        bare = F.regexp_like(body, F.lit(rf"(?<!\\){CONTROL}"))
        return F.struct(role.alias("role"), F.when((head != "") & ~bare, unescape(body)).alias("text"))

    return F.transform(_pieces(formatted), turn)


def loss_mask(formatted: Column) -> Column:
    """array<struct<start, stop>>: code point ranges of the assistant's texts, escapes included."""
    head = lambda p: F.length(F.regexp_extract(p, HEAD, 0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        at, size = state["at"], F.length(piece)
        span = F.struct((at + head(piece)).alias("start"), (at + size).alias("stop"))
        ours = F.regexp_like(piece, F.lit("^### Assistant: "))
        return F.struct((at + size + len(END)).alias("at"), F.when(ours, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(_pieces(formatted), zero, step)["spans"]


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    return F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["stop"] - m["start"])))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, mask, parsed, one row per conv_id of (conv_id, turn, role, text).

    Null roles and texts count as empty. Turns stand by turn number (null
    first), equal numbers by role and text; repeated rows are repeated turns,
    and rows without conv_id are one conversation. Extra columns are ignored.
    One conversation becomes one value, so its rows meet in one task.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    grouped = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    source = F.transform("turns", plain)
    # a turn conflicts when it does not come back from its own text
    alone = lambda t: ~parse(render(F.array(plain(t)), lambda _: F.lit(False))).eqNullSafe(F.array(plain(t)))
    marked = grouped.withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), alone(t).alias("clash")))
    )
    first = marked.withColumn("formatted", render(F.col("turns"), lambda t: t["clash"]))
    kept = first.withColumn(
        "formatted",
        F.when(parse(F.col("formatted")).eqNullSafe(source), F.col("formatted")).otherwise(render(F.col("turns"), lambda t: F.lit(True))),
    )
    read = kept.withColumn("parsed", parse(F.col("formatted")))
    checked = F.when(F.col("parsed").eqNullSafe(source), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )
    return read.select("conv_id", checked.alias("formatted"), "parsed").withColumn("mask", loss_mask(F.col("formatted")))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    texts = masked_texts(F.col("formatted"), F.col("mask"))
    lines = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = formatted.withColumn("loss", F.concat_ws("", texts))
    return loss.select(
        "conv_id",
        F.size("parsed").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
