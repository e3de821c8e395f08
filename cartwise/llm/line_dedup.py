"""Line de-duplication within an edit bound, with built-in functions only.

Lines are compared after lower-casing A-Z, turning runs of white space into one blank and
trimming. Lines that are equal then are one line from the start. Two lines with an edit
distance of 1 share a deletion variant: the line itself or the line without one character. So
each line emits all its variants as hashed keys, lines with an equal key meet, the distance is
verified, and the earliest line of a group stays.

Two things keep this small. Only lines that can have a neighbour emit variants: if two lines are
one edit apart, they agree in all characters before or in all behind the middle of the shorter
one, so each line has four half keys (first and last half, as a line of its own length and as one
that is a character longer than its partner), and a line none of whose half keys occurs with
another line is done. And the key of a variant hashes what lies before and behind the segment
of the edit once for the segment, so long lines do not cost the square of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import aside, lower_ascii, stored, text_of
from cartwise.llm.near_dedup import components

MIN_CHARS = 30
SEGMENT = 64
_ROW = ["doc_id", "row"]  # row: hash of the text, for ids that repeat


def normalised(line: Column) -> Column:
    """Lower case, single blanks, no blanks at the ends."""
    low = lower_ascii(line)
    return F.trim(F.when(low.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(low, r"[\x20\x09-\x0D]+", " ")).otherwise(low))


def document_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row``, ``at`` (from 0) and normalised ``line`` for each line of each text."""
    lean = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.posexplode(F.split(text_of(), "\n", -1)).alias("at", "raw"))
    return lean.select(*_ROW, "at", normalised(F.col("raw")).alias("line"))


def lines_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``line_id, line`` for ``places`` (``line_id``, ``place``: ``doc_id``, ``row``, ``at``): only documents
    that hold a place are cut into lines, and of those only the lines asked for are normalised."""
    wanted = places.groupBy(F.col("place.doc_id").alias("in_id"), F.col("place.row").alias("in_row")).agg(
        F.collect_list(F.struct("place.at", "line_id")).alias("wanted")
    )
    lean = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), text_of().alias("body"))
    held = lean.join(wanted, F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("row") == F.col("in_row")))
    # As the element of an outer array the lines are bound once, not made anew for each place.
    cut = F.transform(
        F.array(F.split("body", "\n", -1)),
        lambda own: F.transform("wanted", lambda w: F.struct(w["line_id"].alias("line_id"), F.get(own, w["at"]).alias("raw"))),
    )[0]
    raw = held.select(F.explode(cut).alias("of")).groupBy("of.line_id").agg(F.first("of.raw").alias("raw"))
    return raw.select("line_id", normalised(F.col("raw")).alias("line"))


def half_keys(line: Column) -> list[Column]:
    """The four half keys of a line."""
    n = F.char_length(line)

    def halves(shorter: Column) -> list[Column]:
        first = F.floor(shorter / 2).cast("int")
        last = (shorter - first).cast("int")
        return [
            F.xxhash64(shorter, F.lit(0), F.substring(line, F.lit(1), first)),
            F.xxhash64(shorter, F.lit(1), F.substring(line, n - last + 1, last)),
        ]

    return [*halves(n), *halves(n - 1)]


def deletion_keys(line: Column) -> Column:
    """Keys of the line and of every line with one character less.

    A string of m characters has segments of ``SEGMENT`` characters; its key by a segment is
    the hash of what is before, what is behind and the segment. The line gives its key by each
    of its segments, a deletion the key of what is left by the segment in which it took place.
    """
    n = F.char_length(line)

    def around(start: Column, m: Column) -> Column:
        behind = F.greatest(m - start - SEGMENT, F.lit(0))
        middle = F.substring(line, start + 1, n - start - behind)
        return F.struct(
            F.xxhash64(m, start, F.substring(line, F.lit(1), start), F.substring(line, n - behind + 1, behind)).alias("rest"), middle.alias("middle")
        )

    def starts(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(m - 1, F.lit(0)) / SEGMENT).cast("int")), lambda k: k * SEGMENT)

    def cut(part: Column) -> Column:
        text = part["middle"]
        size = F.char_length(text)
        return F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.xxhash64(part["rest"], F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, size))),
        )

    whole = F.transform(F.transform(starts(n), lambda s: around(s, n)), lambda part: F.xxhash64(part["rest"], part["middle"]))
    deleted = F.flatten(F.transform(F.transform(starts(n - 1), lambda s: around(s, n - 1)), cut))
    return F.array_distinct(F.concat(whole, deleted))


def line_groups(lines: DataFrame) -> DataFrame:
    """``line_id, group_id`` for distinct ``lines`` (``line_id``, ``line``): lines linked by edits of one
    character, directly or through others, share the smallest id. Lines that are linked with
    nothing are left out."""
    variants = lines.select("line_id", F.explode(deletion_keys(F.col("line"))).alias("variant"))
    key = Window.partitionBy("variant")
    shared = variants.withColumn("n", F.count("*").over(key)).where("n > 1").drop("n")
    shared = stored(shared, "shared-variants")
    pairs = (
        shared.join(shared.withColumnRenamed("line_id", "other"), "variant").where("line_id < other")
        .select("line_id", "other").distinct()
    )
    texts = lines.select(F.col("line_id").alias("id"), "line")
    met = pairs.join(texts, F.col("line_id") == F.col("id")).drop("id").withColumnRenamed("line", "of_a")
    met = met.join(texts, F.col("other") == F.col("id")).drop("id")
    close = met.where(F.coalesce(F.levenshtein("of_a", "line", 1), F.lit(-1)) == 1)
    links = stored(close.select(F.col("line_id").alias("a"), F.col("other").alias("b")), "line-links")
    return components(links).select(F.col("node").alias("line_id"), F.col("component").alias("group_id"))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The places (``doc_id``, ``row``, ``at``) of lines that go: all of a group but its earliest.

    Lines of fewer than ``min_chars`` characters are never repeated (list marks, headings).
    Earliest is the place with the smallest ``doc_id``, null below all, then the smallest ``row``
    (the hash of the text), then the smallest ``at``.
    """
    lines = document_lines(docs).where(F.char_length("line") >= min_chars)
    lines = lines.withColumn("line_id", F.xxhash64("line"))
    halves = [h.alias(f"half_{k}") for k, h in enumerate(half_keys(F.col("line")))]
    check = F.xxhash64(F.lit(1), "line").alias("check")
    spots = stored(lines.select(*_ROW, "at", "line_id", check, *halves), "line-places")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), *_ROW, "at")
    distinct = spots.groupBy("line_id", "check").agg(
        F.min(place).alias("first"), F.count("*").alias("places"), *[F.min(f"half_{k}").alias(f"half_{k}") for k in range(4)]
    )
    distinct = stored(distinct, "distinct-lines")

    half = F.explode(F.array_distinct(F.array(*[f"half_{k}" for k in range(4)]))).alias("half")
    met = distinct.select("line_id", half).withColumn("n", F.count("*").over(Window.partitionBy("half")))
    likely = met.where("n > 1").select("line_id").distinct()
    texts = lines_at(docs, distinct.join(likely, "line_id").groupBy("line_id").agg(F.min("first").alias("place")))
    groups = line_groups(stored(texts, "likely-lines"))

    named = distinct.select("line_id", "check", "first", "places").join(groups, "line_id", "left")
    # a line of no group is known by both its hashes
    group = F.struct(F.coalesce("group_id", "line_id").alias("id"), F.when(F.col("group_id").isNull(), F.col("check")).alias("check"))
    named = stored(named.withColumn("group", group).drop("group_id"), "line-groups")
    whole = named.groupBy(F.xxhash64("group").alias("key"), F.col("group").alias("of")).agg(F.min("first").alias("keep"), F.sum("places").alias("n"))
    goes = named.join(whole.where("n > 1"), F.col("group").eqNullSafe(F.col("of"))).select("line_id", "check", "keep")
    return spots.join(goes, ["line_id", "check"]).where(place != F.col("keep")).select(*_ROW, "at")


def _lines_left(lines: Column, lost: Column) -> Column:
    """The lines whose number is not in ``lost``, as a text; takes time in proportion to both."""
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    # As the element of an outer array the lines are bound once, not made anew for each place.
    return F.transform(F.array(lines), lambda own: F.array_join(F.transform(places, lambda i: F.get(own, i)), "\n"))[0]


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``.

    The earliest place, by ``doc_id`` and then line number, keeps its line. A document that
    loses lines and keeps nothing but white space goes; every other row stays, with all its
    columns, a row without a repeated line exactly as it is. A null text stays null. Of rows
    that repeat an id with different texts the one with the smallest hash is first; rows that
    repeat both are one document, and each copy gets the same text.
    """
    lost = repeated_lines(docs, min_chars).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.collect_set("at").alias("_lost")
    )
    lean, back = aside(docs, ("_id", "_row", "_lost", "_kept"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row"))
    joined = lean.join(lost, same, "left")
    kept = _lines_left(F.split("text", "\n", -1), F.col("_lost"))
    joined = joined.withColumn("_kept", F.when(F.col("_lost").isNotNull(), kept))
    emptied = F.col("_lost").isNotNull() & (F.trim(F.regexp_replace("_kept", r"[\x09-\x0D]+", " ")) == "")
    return back(joined.where(~emptied).withColumn("text", F.coalesce("_kept", "text")))


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """What :func:`without_repeated_lines` does: ``doc_id, n_lines, n_lost, kept, text_sha256`` for each
    row of ``docs``; the digest is that of the text that stays, null if none does."""
    lean = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lost = repeated_lines(lean, min_chars).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.collect_set("at").alias("_lost")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row"))
    lines = F.split(text_of(), "\n", -1)
    joined = lean.join(lost, same, "left").select("doc_id", lines.alias("lines"), "_lost")
    left = F.when(F.col("_lost").isNull(), F.array_join("lines", "\n")).otherwise(
        _lines_left(F.col("lines"), F.col("_lost"))
    )
    n = F.size("lines").cast("long")
    report = joined.select("doc_id", n.alias("n_lines"), F.when(F.col("_lost").isNull(), 0).otherwise(F.size("_lost")).cast("long").alias("cut"), left.alias("left"))
    gone = (F.col("cut") > 0) & (F.trim(F.regexp_replace("left", r"[\x09-\x0D]+", " ")) == "")
    return report.select(
        "doc_id",
        "n_lines",
        F.when(gone, F.col("n_lines")).otherwise(F.col("cut")).alias("n_lost"),
        (~gone).alias("kept"),
        F.when(~gone, F.sha2("left", 256)).alias("text_sha256"),
    )
