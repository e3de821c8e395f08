"""Chat formatting with built-in functions only.

A message is a list of typed parts. A visitor turns text parts into escaped text and image,
audio and document parts into placeholders in the order of the parts; the reference of each
attachment and the tokens it expands to are recorded. A turn is marked as

    <s>[role]content</s>

``&``, ``<``, ``[`` and ``]`` are control characters of the template. Inside roles, texts and
attachment references they are written as ``&amp;``, ``&lt;``, ``&#91;`` and ``&#93;``, so no
control string can occur there, and unescaping gives the text back exactly. A placeholder is
``<image|n>`` with the number of its attachment in the conversation, counted from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import text_of

#: Fixed values of the template; ``&`` must be escaped first and unescaped last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"
TURN_END = "</s>"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A message that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*KINDS), F.lit(False))


def _content(parts: Column, first: Column) -> Column:
    """The parts one after another; ``first`` is the number of the first attachment."""
    attachments = F.filter(F.transform(parts, lambda p, i: F.when(_is_attachment(p), i)), lambda i: i.isNotNull())

    def visit(part: Column, at: Column) -> Column:
        number = first + F.array_position(attachments, at) - 1
        held = F.concat(F.lit("<"), part["kind"], F.lit("|"), number.cast("string"), F.lit(">"))
        return F.when(_is_attachment(part), held).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    return F.array_join(F.transform(parts, visit), "")


def format_conversations(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of ``messages`` (``conv_id, turn, role, parts``; ``parts`` is an array of
    ``PART``; other columns are ignored).

    Result: ``conv_id``, ``n_turns``, ``formatted``, ``mask`` (an array of ``turn, start, length``: the
    content of a turn of a trained role, ``start`` in characters from the beginning of that turn,
    ``at`` from the beginning of ``formatted``), ``attachments`` (``number, turn, kind, ref,
    tokens``) and ``attachment_tokens``, their sum.

    Rows are ordered by turn, then role, then content; null turns come first, so ties and
    repeated rows have a defined place and all stay. A null role is the empty role, null parts
    are an empty message, a null text is empty, a part of another kind counts as text. Rows
    without ``conv_id`` are one conversation. An empty table gives no rows.
    """
    empty = F.array().cast(f"array<{PART}>")
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("parts").cast(f"array<{PART}>"), empty).alias("parts"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("held", F.filter("parts", _is_attachment))
    numbered = held.withColumns({
        "seq": F.row_number().over(order) - 1,
        "first": F.coalesce(F.sum(F.size("held")).over(before), F.lit(0)),
    })
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]"))
    turns = numbered.select(
        "conv_id", "seq", "role", "turn", "parts", "held", "first", head.alias("head"), _content(F.col("parts"), F.col("first")).alias("content")
    ).withColumn("segment", F.concat("head", "content", F.lit(TURN_END)))
    turns = turns.withColumn("base", F.coalesce(F.sum(F.char_length("segment")).over(before), F.lit(0)))
    loss = F.when(
        F.col("role").isin(*trained_roles),
        F.struct(
            F.col("seq").alias("turn"), F.char_length("head").alias("start"), F.char_length("content").alias("length"),
            (F.col("base") + F.char_length("head")).cast("long").alias("at"),
        ),
    )
    kept = F.transform(
        "held",
        lambda p, i: F.struct(
            (F.col("first") + i).cast("long").alias("number"), F.col("seq").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"),
            F.coalesce(p["tokens"], F.lit(0).cast("long")).alias("tokens"),
        ),
    )
    one = F.sort_array(F.collect_list(F.struct("seq", "segment", loss.alias("loss"), kept.alias("kept"))))
    joined = turns.groupBy("conv_id").agg(one.alias("t"))
    attachments = F.flatten(F.transform("t", lambda t: t["kept"]))
    return joined.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: t["segment"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["loss"]), lambda m: m.isNotNull()).alias("mask"),
        attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Take formatted conversations apart: ``conv_id, n_turns``, ``turns`` (``role``, ``text``,
    unescaped, placeholders as they are), ``loss`` (the unescaped texts under the mask, in
    order) and ``formatted_chars``."""
    segments = F.slice(F.split("formatted", TURN_END), 1, F.size(F.split("formatted", TURN_END)) - 1)
    cut = formatted.select("conv_id", "formatted", "mask", segments.alias("segments"))

    def turn(segment: Column) -> Column:
        close = F.instr(segment, "]")
        return F.struct(
            unescape(F.substring(segment, F.lit(5), close - F.lit(5))).alias("role"),
            unescape(F.substring(segment, close + F.lit(1), F.char_length(segment))).alias("text"),
        )

    def masked(m: Column) -> Column:
        return unescape(F.substring(F.element_at(F.col("segments"), m["turn"] + 1), m["start"] + 1, m["length"]))

    return cut.select(
        "conv_id",
        F.size("segments").cast("long").alias("n_turns"),
        F.transform("segments", turn).alias("turns"),
        F.transform("mask", masked).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(conversations: DataFrame) -> DataFrame:
    """Format ``conversations`` (``conv_id, turn, role, text``), read the output back and digest it:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    messages = conversations.select("conv_id", "turn", "role", text_parts(text_of()).alias("parts"))
    back = read_back(format_conversations(messages))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", "n_turns", every.alias("every"), loss.alias("loss"), "formatted_chars").select(
        "conv_id",
        "n_turns",
        F.sha2("every", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts consist of another template's control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
