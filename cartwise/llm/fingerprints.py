"""One-permutation MinHash fingerprints with built-in functions only.

The shingles of a text (five words, or the whole sequence of fewer) are hashed once. The
leading bits of a hash choose a bin, the rest is its value, and a bin keeps its least value.
An empty bin borrows from the first filled bin of its own random order (optimal
densification): each bin probes a fixed list of others and, if all of these are empty too,
takes the filled bin whose (bin, bin) hash is least. Of each bin the low bits are stored,
packed into 64-bit numbers. Likeness is the share of equal bins, corrected for the bins that
agree by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import lower_ascii, partitions, stored, text_of

BINS = 256
BITS = 4  # bits kept of a bin; a fingerprint is BINS * BITS / 64 numbers
SHINGLE = 5
PROBES = 8
_SHIFT = 64 - (BINS - 1).bit_length()
_PER_LONG = 64 // BITS
_VALUE = (1 << _SHIFT) - 1
_SEED = 20_240_607


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-cased words; white space becomes blanks first, as a split at one character needs no pattern."""
    blank = lower_ascii(text)
    for space in "\t\n\x0b\x0c\r":
        blank = F.replace(blank, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(blank, " ", -1), "")


def shingle_hashes(word_list: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles; none for a text without words."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)

        def shingle(_, i):
            return F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])

        many = F.transform(F.slice(hashes, 1, F.greatest(n - (size - 1), F.lit(0))), shingle)
        few = F.array(F.xxhash64(*[F.get(hashes, F.lit(k)) for k in range(size - 1)], n))
        return F.when(n >= size, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(word_list, lambda w: F.xxhash64(w)), of)


def bin_values(hashes: Column) -> Column:
    """``BINS`` values, null where no shingle fell into the bin."""
    # one marker a bin, above all values of the bin: after sorting, the first entry of each bin is its least value
    markers = F.array(*[F.lit(((b << _SHIFT) | _VALUE) - (1 << 63)) for b in range(BINS)])

    def firsts(ordered: Column) -> Column:
        starts = F.filter(
            ordered, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(ordered, i - 1), _SHIFT))
        )
        return F.transform(starts, lambda x: F.when(x.bitwiseAND(F.lit(_VALUE)) != _VALUE, x.bitwiseAND(F.lit(_VALUE))))

    return _let(F.sort_array(F.concat(F.coalesce(hashes, F.array().cast("array<bigint>")), markers)), firsts)


def densified(values: Column) -> Column:
    """Empty bins filled; all null if every bin is empty."""
    dice = random.Random(_SEED)
    tables = [F.array(*[F.lit(dice.randrange(BINS)) for _ in range(BINS)]) for _ in range(PROBES)]

    def fill(bins: Column) -> Column:
        filled = F.filter(
            F.transform(bins, lambda v, j: F.when(v.isNotNull(), F.struct(j.alias("j"), v.alias("v")))), lambda e: e.isNotNull()
        )

        def whole(full: Column) -> Column:
            def one(value: Column, i: Column) -> Column:
                rest = F.array_min(F.transform(full, lambda e: F.struct(F.xxhash64(i, e["j"]).alias("h"), e["v"].alias("v"))))["v"]
                return F.coalesce(value, *[F.get(bins, F.get(t, i)) for t in tables], rest)

            return F.transform(bins, one)

        return _let(filled, whole)

    return _let(values, fill)


def packed(values: Column) -> Column:
    """The low ``BITS`` of each bin in ``BINS * BITS / 64`` numbers; empty for a text without words."""

    def number(bins: Column, k: int) -> Column:
        low = [F.shiftleft(F.get(bins, F.lit(k * _PER_LONG + j)).bitwiseAND(F.lit((1 << BITS) - 1)), j * BITS) for j in range(_PER_LONG)]
        out = low[0]
        for more in low[1:]:
            out = out.bitwiseOR(more)
        return out

    def pack(bins: Column) -> Column:
        numbers = F.array(*[number(bins, k) for k in range(BINS // _PER_LONG)])
        return F.when(F.get(bins, F.lit(0)).isNotNull(), numbers).otherwise(F.array().cast("array<bigint>"))

    return _let(values, pack)


def fingerprint(text: Column) -> Column:
    """Packed fingerprint of a text, an array of 64-bit numbers; empty without words."""
    return packed(densified(bin_values(shingle_hashes(words(text)))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1. Two texts without words are alike (1), with one of them 0."""
    ones = sum(1 << (BITS * j) for j in range(_PER_LONG))
    ones -= 1 << 64 if ones >= 1 << 63 else 0

    def differing(x: Column, y: Column) -> Column:
        folded = x.bitwiseXOR(y)
        spread = folded
        for k in range(1, BITS):
            spread = spread.bitwiseOR(F.shiftrightunsigned(folded, k))
        return F.bit_count(spread.bitwiseAND(F.lit(ones)))

    different = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, n: s + n)
    equal = 1.0 - different / F.lit(float(BINS))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def as_hex(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda n: F.lpad(F.lower(F.hex(n)), 16, "0")), "")


def next_ids(ids: DataFrame) -> DataFrame:
    """``doc_id, chars`` -> ``doc_id, next_id, before_id, before_chars`` in the circle of ascending
    ids, null below all; ``ids`` holds each id once.

    Ids are range-partitioned and looked up within a range; only the ends of a range, one row
    for each, are matched across ranges.
    """
    n = partitions(ids.sparkSession)
    ranged = stored(ids.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()), "id-ranges")
    order = Window.partitionBy("part").orderBy("doc_id")
    inner = ranged.select(
        "part", "doc_id", F.lead(F.struct("doc_id")).over(order).alias("next"), F.lag(F.struct("doc_id", "chars")).over(order).alias("before")
    )
    ends = ranged.groupBy("part").agg(
        F.min(F.struct("doc_id", "chars")).alias("first"), F.max(F.struct("doc_id", "chars")).alias("last")
    )
    # one row for each range
    rows = sorted(ends.collect(), key=lambda r: r["part"])
    links = [
        (r["part"], *rows[(k + 1) % len(rows)]["first"][:1], *rows[k - 1]["last"]) for k, r in enumerate(rows)
    ]
    linked = F.broadcast(ids.sparkSession.createDataFrame(links, "part int, after_id long, prior_id long, prior_chars long"))
    return inner.join(linked, "part").select(
        "doc_id",
        F.when(F.col("next").isNotNull(), F.col("next.doc_id")).otherwise(F.col("after_id")).alias("next_id"),
        F.when(F.col("before").isNotNull(), F.col("before.doc_id")).otherwise(F.col("prior_id")).alias("before_id"),
        F.when(F.col("before").isNotNull(), F.col("before.chars")).otherwise(F.col("prior_chars")).alias("before_chars"),
    )


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form.

    The last quarter of a text's characters (rounded down) gives way to as many from the start
    of the next document by ascending ``doc_id``, or to all it has; the last is followed by the
    first. Result: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, one row per row of ``docs`` (``doc_id``, ``text``; other columns
    are ignored). A null text is empty. Where an id repeats, each row has a result of its own
    and the next document is the least text of the next larger id; a null id sorts first.
    """
    body = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    lengths = body.groupBy("doc_id").agg(F.max(F.char_length("text")).cast("long").alias("chars"))
    order = stored(next_ids(stored(lengths, "id-lengths")), "id-order")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    placed = body.join(order.withColumnRenamed("doc_id", "id"), same).drop("id")
    # only the characters that the document before can need travel to it
    starts = placed.groupBy(F.col("before_id").alias("to_id")).agg(
        F.min(F.substring(F.col("text"), F.lit(1), F.floor(F.col("before_chars") / 4).cast("int"))).alias("start")
    )
    rows = placed.select("doc_id", "next_id", "text").join(starts, F.col("doc_id").eqNullSafe(F.col("to_id")))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.select(
        "doc_id", "next_id", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("start"), F.lit(1), cut)).alias("edited"),
    )
    prints = stored(
        rows.select(
            "doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            F.sha2("text", 256).alias("text_sha256"), fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("edited"),
        ),
        "fingerprints",
    )
    following = prints.groupBy(F.col("doc_id").alias("follower")).agg(F.min(F.struct("text_sha256", "own")).alias("f"))
    return prints.join(following, F.col("next_id").eqNullSafe(F.col("follower"))).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("f.own")).alias("near_next"),
    )
