"""Bulk-synchronous best-fit packing of token sequences.

Items over half the capacity open a sequence each. Then rounds run until every item has its
place. In a round the free gaps and the items are range-sorted by size in one order (an item
before a gap of its size) and swept: each gap takes the largest item not yet taken that fits,
so of several gaps after the same item the nearest wins, and of several items the one ranked
next to the gap. A task sweeps its own range; what is left of a range (gaps without an item,
then items without a gap) is matched across ranges by rank, from one count of each kind for
each range. A gap that is wider than the largest item left counts as several slots. Gaps are
updated, and if a round placed next to nothing, as many sequences are opened as the rest of
the items must fill at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm import tokens
from cartwise.llm.common import give_back, stored, text_batches, text_of

CAPACITY = 4096
SWEPT_ROWS = 100_000  # items and slots that a task sweeps, about
ITEM, GAP = 0, 1
PLACED, FREE_SLOT, LEFT_ITEM = 0, 1, 2
_SWEPT = "state int, part int, at long, uid long, length long, sequence_id long, gap long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces of ``capacity`` ids at most: ``uid, doc_id, piece, start, length, ids_crc32``.

    Only documents longer than that are cut; the last piece may be shorter. A null text is the
    end id alone. ``uid`` numbers the rows (ids may repeat or be null). The table is stored.
    """
    path = tokenizer or tokens.default_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.Encoder(path)
        for batch in tokens.text_slices(batches, 1):
            rows: list[tuple] = []
            flat, ends = own.encode_column(batch.column(1))
            for doc_id, own_ids in zip(batch.column(0).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                ids = own_ids.tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )
        del own
        give_back()

    text_batches(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    made = lean.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return stored(made.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match within a sorted range; ``at`` numbers what is left of it, by kind."""
    part = TaskContext.get().partitionId()
    waiting: list[tuple[int, int]] = []
    free = 0

    def out(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 5)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _SWEPT.split(", ")])

    for batch in batches:
        rows = []
        for size, kind, row_id, gap in zip(*(batch.column(c).to_pylist() for c in ("size", "kind", "id", "gap")), strict=True):
            if kind == ITEM:
                waiting.append((row_id, size))
            elif waiting:
                uid, length = waiting.pop()
                rows.append((PLACED, part, None, uid, length, row_id, gap))
            else:
                rows.append((FREE_SLOT, part, free, None, None, row_id, gap))
                free += 1
        yield out(rows)
    for first in range(0, len(waiting), 10_000):
        yield out([(LEFT_ITEM, part, first + i, u, n, None, None) for i, (u, n) in enumerate(waiting[first : first + 10_000])])


def _match_ranges(counts: dict[tuple[int, int], int]) -> list[tuple]:
    """Which leftover items meet which leftover slots: ``(first match number, item range, first
    item, end of items, slot range, first slot, end of slots)``; two entries a range at most.
    The last items of the nearest lower range go first."""
    found, number = [], 0
    stack: list[tuple[int, int]] = []
    for part in sorted({p for p, _ in counts}):
        slots, at = counts.get((part, FREE_SLOT), 0), 0
        while at < slots and stack:
            owner, top = stack.pop()
            n = min(slots - at, top)
            found.append((number, owner, top - n, top, part, at, at + n))
            number, at = number + n, at + n
            if top > n:
                stack.append((owner, top - n))
        if items := counts.get((part, LEFT_ITEM), 0):
            stack.append((part, items))
    return found


def _resolved(swept: DataFrame) -> DataFrame:
    """The swept rows after leftovers of different ranges have met."""
    counted = swept.where(F.col("state") != PLACED).groupBy("part", "state").count().collect()
    links = _match_ranges({(r["part"], r["state"]): r["count"] for r in counted})
    if not links:
        return swept
    spark = swept.sparkSession
    names = "number long, item_part int, item_from long, item_to long, slot_part int, slot_from long, slot_to long"
    links = F.broadcast(spark.createDataFrame(links, names))  # two rows a range at most
    item = (F.col("state") == LEFT_ITEM) & (F.col("part") == F.col("item_part")) & (F.col("at") >= F.col("item_from")) & (F.col("at") < F.col("item_to"))
    slot = (F.col("state") == FREE_SLOT) & (F.col("part") == F.col("slot_part")) & (F.col("at") >= F.col("slot_from")) & (F.col("at") < F.col("slot_to"))
    kept = swept.columns
    items = swept.where(F.col("state") == LEFT_ITEM).join(links, item, "left")
    items = items.select(*kept, (F.col("number") + F.col("item_to") - 1 - F.col("at")).alias("match"))
    slots = swept.where(F.col("state") == FREE_SLOT).join(links, slot, "left")
    slots = slots.select(*kept, (F.col("number") + F.col("at") - F.col("slot_from")).alias("match"))
    both = items.unionByName(slots)
    met = both.where("match is not null").groupBy("match").agg(*[F.max(c).alias(c) for c in ("uid", "length", "sequence_id", "gap")])
    met = met.select(F.lit(PLACED).alias("state"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("at"), "uid", "length", "sequence_id", "gap")
    return swept.where(F.col("state") == PLACED).unionByName(both.where("match is null").drop("match")).unionByName(met)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for ``pieces`` (``uid``, unique and not null; ``length`` from 1 to ``capacity``):
    ``uid, sequence_id, offset``. The pieces of a sequence follow each other without a gap."""
    spark = pieces.sparkSession
    pieces = pieces.select(F.col("uid").cast("long"), F.col("length").cast("long"))
    low, high = pieces.agg(F.min("length"), F.max("length")).first()
    if low is not None and (low < 1 or high > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}, not from {low} to {high}")
    large = F.col("length") * 2 > capacity
    placed = [pieces.where(large).select("uid", F.col("uid").alias("sequence_id"), "length", F.lit(0).alias("turn"))]
    items = pieces.where(~large).select(F.col("uid").alias("id"), F.col("length").alias("size"))
    gaps = pieces.where(large).select(F.col("uid").alias("id"), (capacity - F.col("length")).alias("size")).where("size > 0")
    opened, turn, last = 0, 0, None
    count, total, least, most = items.agg(F.count("*"), F.sum("size"), F.min("size"), F.max("size")).first()
    while count:
        turn += 1
        gaps = gaps.where(F.col("size") >= least)
        slots = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / most))
        free = gaps.agg(F.sum(slots)).first()[0] or 0
        if (last is not None and last * 1000 < count) or not free:
            new = -(-total // capacity)
            fresh = spark.range(new).select((F.lit(-1 - opened) - F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("size"))
            gaps, opened, free = gaps.unionByName(fresh), opened + new, free + new * max(1, capacity // most)
        slotted = gaps.withColumn("slots", slots).select(
            F.floor(F.col("size") / F.col("slots")).alias("size"), F.lit(GAP).alias("kind"), "id", F.col("size").alias("gap"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("slots"))).alias("slot"),
        )
        events = items.select("size", F.lit(ITEM).alias("kind"), "id", F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("slot"))
        order = ["size", "kind", "id", "slot"]
        n = -(-(count + free) // SWEPT_ROWS)  # more rows make more tasks; few rows are not dealt to many
        ranged = events.unionByName(slotted).repartitionByRange(n, *order).sortWithinPartitions(*order)
        swept = stored(ranged.mapInArrow(_sweep, _SWEPT), "swept")
        state = stored(_resolved(swept), "matched")
        done = state.where(F.col("state") == PLACED)
        placed.append(done.select("uid", "sequence_id", "length", F.lit(turn).alias("turn")))
        items = state.where(F.col("state") == LEFT_ITEM).select(F.col("uid").alias("id"), F.col("length").alias("size"))
        used = F.sum(F.coalesce("length", F.lit(0)))
        gaps = (
            state.where(F.col("state") != LEFT_ITEM).groupBy(F.col("sequence_id").alias("id"))
            .agg((F.max("gap") - used).alias("size")).where("size > 0")
        )
        left = F.col("state") == LEFT_ITEM
        last, count, total, least, most = state.agg(
            F.count(F.when(F.col("state") == PLACED, 1)), F.count(F.when(left, 1)), *[of(F.when(left, F.col("length"))) for of in (F.sum, F.min, F.max)]
        ).first()
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    within = Window.partitionBy("sequence_id").orderBy("turn", "uid")
    return every.select("uid", "sequence_id", (F.sum("length").over(within) - F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack ``docs`` (``doc_id``, ``text``; other columns are ignored): ``doc_id,
    piece, start, length, ids_crc32, sequence_id, offset``. An empty table gives no rows."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity)
    return pieces.join(best_fit(pieces, capacity), "uid").drop("uid")
