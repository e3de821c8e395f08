"""Exact de-duplication through an extendible-hash index.

Every text becomes a 64-bit key. A directory of slots (the leading bits of the key)
points to buckets; while a bucket holds more keys than its capacity the directory
doubles and the bucket splits by one more bit. Every row finds its bucket through the
directory and is written to the shared folder, each owner task writing one range of
buckets and keys. The rows of a bucket with equal keys are a chain; a chain of one row
is done. Longer ones are cut into pages of about the capacity, one owner each, where
the rows are compared byte by byte with the head of their chain; a row that differs (a
collision) moves on to the next head of the chain, until no row is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import lower_ascii, partitions, stored, text_of

CAPACITY = 4096
_ID = "_id"


def _directory(keys: DataFrame, capacity: int) -> DataFrame:
    """Slot -> bucket, for the smallest directory whose buckets hold ``capacity`` keys at most.

    Columns ``slot``, ``depth`` (of the directory), ``bucket_depth`` and ``bucket`` (the
    first slot that points to it).
    """
    depth = max(0, (keys.count() - 1).bit_length() - (capacity - 1).bit_length())
    start = depth
    while True:
        slots = keys.groupBy(_slot(depth).alias("slot")).agg(F.count("*").alias("keys"))
        if depth >= 62 or slots.where(F.col("keys") > capacity).isEmpty():
            break
        depth += 1
    slots = stored(slots, "directory")
    local = F.lit(depth)
    for shallow in range(depth - 1, start - 1, -1):
        prefix = F.shiftright("slot", depth - shallow)
        sums = slots.groupBy(prefix.alias("prefix")).agg(F.sum("keys").alias(f"keys_{shallow}"))
        slots = slots.join(sums, prefix == F.col("prefix")).drop("prefix")
        local = F.when(F.col(f"keys_{shallow}") <= capacity, F.lit(shallow)).otherwise(local)
    local = local.cast("long")
    wide = F.expr(f"shiftleft(1L, cast({depth} - bucket_depth as int))")
    return slots.select("slot", F.lit(depth).alias("depth"), local.alias("bucket_depth")).withColumn(
        "bucket", F.col("slot") - F.col("slot") % wide
    )


def _slot(depth: int):
    """The leading ``depth`` bits of the key."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def through_directory(keyed: DataFrame, directory: DataFrame) -> DataFrame:
    """``keyed`` with the ``bucket`` of each ``key``, looked up by the key's slot."""
    depth = directory.agg(F.max("depth")).first()[0] or 0
    slots = directory.select("slot", "bucket")
    return keyed.withColumn("slot", _slot(depth)).join(slots, "slot").drop("slot")


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The stored directory and bucket files for ``entries`` (``key`` and any other columns).

    An entry finds its bucket through the directory. The files hold the entries in ranges of
    (bucket, key, all other columns), so a chain that is longer than a file goes on in the next.
    """
    directory = _directory(stored(entries.select("key").distinct(), "hash-keys"), capacity)
    placed = through_directory(entries, directory)
    order = ["bucket", "key", *[c for c in entries.columns if c != "key"]]
    owners = partitions(entries.sparkSession)
    return directory, stored(placed.repartitionByRange(owners, *order).sortWithinPartitions(*order), "hash-index")


def _on_pages(table: DataFrame) -> DataFrame:
    """``table`` (one row a chain) once for every ``page`` of its chain."""
    return table.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1))).drop("pages")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key=F.xxhash64) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored):
    ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; of a group the largest
    ``doc_id`` stays. A null text is empty. A null ``doc_id`` sorts below all others and is
    matched with other nulls. If a row is repeated with its ``doc_id``, one copy is kept. An
    empty table gives no rows. ``key`` makes the 64-bit key of a text.
    """
    body = lower_ascii(text_of())
    hashed = docs.select(F.col("doc_id").cast("long"), body.alias("body")).select(
        "doc_id", key("body").alias("key"), F.sha2("body", 256).alias("text_sha256")
    )
    entries = stored(
        hashed.groupBy("doc_id", "key", "text_sha256").agg(F.count("*").alias("copies")), "hash-entries"
    )
    _, index = build_index(entries, capacity)

    chain = ["bucket", "key"]
    lengths = index.groupBy(*chain).agg(F.count("*").alias("length")).where("length > 1")
    lengths = stored(lengths.withColumn("pages", F.ceil(F.col("length") / capacity).cast("long")).drop("length"), "chains")
    alone = index.join(lengths, chain, "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"), "text_sha256", "copies"
    )

    # The owner of a page of a chain gets the texts of its entries; no page has many more than ``capacity``.
    page = F.pmod(F.xxhash64("doc_id", "text_sha256"), "pages").alias("page")
    members = index.join(lengths, chain).select(
        *chain, page, "pages", F.col("doc_id").alias(_ID), "text_sha256", "copies"
    )
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    same_row = F.col("doc_id").eqNullSafe(F.col(_ID))
    open_rows = (
        members.join(texts, same_row)
        .select(*members.columns, lower_ascii(F.col("text")).alias("body"))
        .where(F.sha2("body", 256) == F.col("text_sha256"))  # ids may repeat with other texts
    )
    open_rows = stored(open_rows.dropDuplicates([_ID, "key", "text_sha256"]), "hash-chain")
    groups = None
    while True:
        heads = open_rows.groupBy(*[F.col(c).alias(f"head_{c}") for c in chain]).agg(
            F.max(F.struct(_ID, "text_sha256")).alias("head")
        )
        is_head = (
            (F.col("bucket") == F.col("head_bucket"))
            & (F.col("key") == F.col("head_key"))
            & F.col(_ID).eqNullSafe(F.col(f"head.{_ID}"))
            & (F.col("text_sha256") == F.col("head.text_sha256"))
        )
        first = open_rows.join(heads, is_head).select(
            *chain, "pages", F.col(_ID).alias("keep_id"), F.col("body").alias("head_body")
        )
        compared = open_rows.join(_on_pages(first), [*chain, "page"]).select(
            *members.columns, "keep_id", (F.col("body") == F.col("head_body")).alias("equal"),
            F.when(F.col("body") != F.col("head_body"), F.col("body")).alias("body"),
        )
        compared = stored(compared, "hash-compared")
        done = compared.where("equal").drop("equal", "body")
        groups = done if groups is None else groups.unionByName(done)
        open_rows = compared.where("not equal").drop("equal", "keep_id")
        if open_rows.isEmpty():
            break
    group = [*chain, "text_sha256"]
    sizes = groups.groupBy(*group).agg(F.sum("copies").alias("group_size"), F.max("pages").alias("pages"))
    grouped = groups.join(_on_pages(sizes), [*group, "page"]).select(
        F.col(_ID).alias("doc_id"), "keep_id", "group_size", "text_sha256", "copies"
    )
    every = alone.unionByName(grouped)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return every.withColumn("copy", copy).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )
