"""Hard negatives: rows of another label that score close to an anchor's positives, exactly.

Scores are integer inner products, computed by Kronecker packing: the components of several
candidates are made non-negative by a bias and put side by side into fields of one 64-bit
integer, so that one multiplication by an anchor's component multiplies them all. The sums of
the fields are then the products of the biased vectors; a correction by the component sums
gives the exact scores. Fields are as wide as the largest sum there can be, so none runs over.

Rows are dealt into blocks of bounded size by a hash of their id, anchors into blocks of their
own. Every block of anchors meets every block of rows; a task keeps, for a block of anchors,
only the best rows so far and sends those on. Two scans are needed: the first finds the
positives, the second the negatives in the windows that their scores set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.common import partitions, stored

BLOCK = 1024
NONE = np.iinfo(np.int64).min  # below every score


def pack(rows: np.ndarray, bits: int) -> np.ndarray:
    """Words of ``64 // bits`` fields: word ``[d, w]`` holds component ``d`` of neighbouring rows."""
    per = max(1, 64 // bits)
    n, dims = rows.shape
    fields = np.zeros((-(-n // per) * per, dims), np.uint64)
    fields[:n] = rows
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(bits if per > 1 else 0)
    return np.bitwise_or.reduce(fields.reshape(-1, per, dims) << shifts[None, :, None], axis=1).T.copy()


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of two integer matrices, anchors by rows.

    Where one field needs more than 64 bits, words hold one row each and sums are taken modulo
    2**64, which still gives every product that fits in 64 bits.
    """
    n, dims = rows.shape
    if not (n and dims and len(anchors)):
        return np.zeros((len(anchors), n), np.int64)
    low_a, low_r = int(anchors.min()), int(rows.min())
    a, r = (anchors.astype(np.int64) - low_a).astype(np.uint64), (rows.astype(np.int64) - low_r).astype(np.uint64)
    bits = max(1, (dims * int(a.max()) * int(r.max())).bit_length())
    per = max(1, 64 // bits)
    sums = a @ pack(r, bits)
    if per > 1:
        shifts = np.arange(per, dtype=np.uint64) * np.uint64(bits)
        sums = ((sums[:, :, None] >> shifts) & np.uint64((1 << bits) - 1)).reshape(len(a), -1)[:, :n]
    modulo = lambda x: np.uint64(x % (1 << 64))
    by_anchor = modulo(low_r) * a.sum(1) + modulo(dims * low_a * low_r)
    return (sums + by_anchor[:, None] + (modulo(low_a) * r.sum(1))[None, :]).view(np.int64)


class Best:
    """The ``k`` best (score, then smaller id) rows of each of ``n`` lists, fed block by block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.bound = np.full(n, NONE)  # no row below this score can still be among the best
        self.at, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, usable: np.ndarray) -> None:
        """``scores`` and ``usable`` have a row for each of ``lists`` and a column for each of ``ids``."""
        usable = usable & (scores >= self.bound[lists][:, None])
        if usable.sum() > 8 * self.k * len(lists) and len(ids) > self.k:  # raise the bounds before sorting
            kth = np.partition(np.where(usable, scores, NONE), len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            usable &= scores >= kth[:, None]
        row, column = np.nonzero(usable)
        if not len(row):
            return
        at = np.concatenate([self.at, lists[row]])
        score = np.concatenate([self.score, scores[row, column]])
        own = np.concatenate([self.id, ids[column]])
        order = np.lexsort((own, ~score, at))
        at, score, own = at[order], score[order], own[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.at, self.score, self.id = at[keep], score[keep], own[keep]
        last = rank == self.k - 1
        self.bound[at[last]] = score[last]


def _blocks(rows: DataFrame, count: int, block: int) -> DataFrame:
    """``(dims, block, ids, labels, q)``: rows by hash of their id, about ``block`` together."""
    dealt = rows.withColumn("dims", F.size("q")).withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(max(1, -(-count // block)))))
    members = F.sort_array(F.collect_list(F.struct("label", "vec_id", "q")))
    return dealt.groupBy("dims", "block").agg(members.alias("m")).select(
        "dims", "block", F.col("m.vec_id").alias("ids"), F.col("m.label").alias("labels"), F.flatten("m.q").alias("q")
    )


def _meet(rows: DataFrame, anchors: DataFrame, anchor_blocks: int) -> DataFrame:
    """Each block of rows beside each block of anchors. Where anchors are few, each of their blocks
    is sent to several tasks, so that all have work."""
    slots = max(1, partitions(rows.sparkSession) // anchor_blocks)
    wide = rows.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))).withColumn(
        "anchor_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(anchor_blocks - 1).cast("long")))
    )
    known = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return wide.drop("block").join(known, ["dims", "anchor_block", "slot"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The columns of each row; lists as arrays, vectors as matrices."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(k)[at] for k, name in enumerate(batch.schema.names)}
            row = {k: v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) else v.as_py() for k, v in row.items()}
            for ids, q in (("ids", "q"), ("anchor_ids", "anchor_q")):
                row[q] = row[q].reshape(len(row[ids]), row["dims"])
            yield row


def _find_positives(k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, last = None, None, None

        def result():
            n = len(best.at)
            whole = lambda x: pa.array(np.full(n, x), pa.int64())
            return pa.record_batch(
                [whole(last["dims"]).cast(pa.int32()), whole(last["anchor_block"]), pa.array(best.at.astype(np.int32)), pa.array(best.id), pa.array(best.score)],
                ["dims", "anchor_block", "at", "positive_id", "positive_score"],
            )

        for row in _pairs(batches):
            if key != (row["dims"], row["anchor_block"]):
                if best is not None:
                    yield result()
                key, best = (row["dims"], row["anchor_block"]), Best(len(row["anchor_ids"]), k)
            last = row
            # Only rows of equal label are multiplied; a block is sorted by label.
            for label in np.intersect1d(row["anchor_labels"], row["labels"]):
                a = np.flatnonzero(row["anchor_labels"] == label)
                r = slice(np.searchsorted(row["labels"], label), np.searchsorted(row["labels"], label, "right"))
                other = row["anchor_ids"][a][:, None] != row["ids"][r][None, :]
                best.add(a, products(row["anchor_q"][a], row["q"][r]), row["ids"][r], other)
        if best is not None:
            yield result()

    return find


def _find_negatives(k: int, low: int, high: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, last = None, None, None

        def result():
            pick = lambda name, x: pa.array(last[name][x])
            at = last["at"][best.at]
            n = len(at)
            columns = {
                "dims": pa.array(np.full(n, last["dims"], np.int32)),
                "anchor_block": pa.array(np.full(n, last["anchor_block"], np.int64)),
                "list": pa.array(best.at.astype(np.int32)),
                "anchor_id": pick("anchor_ids", at),
                "positive_id": pick("positive_ids", best.at),
                "positive_score": pick("positive_scores", best.at),
                "negative_id": pa.array(best.id),
                "negative_score": pa.array(best.score),
            }
            return pa.record_batch(list(columns.values()), list(columns))

        for row in _pairs(batches):
            if key != (row["dims"], row["anchor_block"]):
                if best is not None:
                    yield result()
                key, best = (row["dims"], row["anchor_block"]), Best(len(row["at"]), k)
                bounds = [[-(-low * s // 100), high * s // 100] for s in row["positive_scores"].tolist()]
                least, most = np.array(bounds, np.int64).reshape(-1, 2).T
            last = row
            scores = products(row["anchor_q"], row["q"])
            other = row["anchor_labels"][:, None] != row["labels"][None, :]
            # Lists are sorted by rank of the positive: a slice has each anchor once at most.
            for rank in np.unique(row["positive_ranks"]):
                lists = np.flatnonzero(row["positive_ranks"] == rank)
                own = scores[row["at"][lists]]
                inside = (own >= least[lists][:, None]) & (own <= most[lists][:, None])
                best.add(lists, own, row["ids"], inside & other[row["at"][lists]])
        if best is not None:
            yield result()

    return find


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` has ``vec_id`` (long), ``label`` (long) and ``q`` (integers, see ``integer_vectors``).
    For every anchor and each of its ``positives`` best other rows of its label, the best
    ``negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive``
    (scores in percent). Better is a higher score, then a smaller id.

    A row with a null id or label takes no part. Rows with the anchor's own id are no positives;
    rows that repeat an id otherwise count one by one. Only vectors of equal length are compared.
    No anchors, or no rows in a window, give no result rows.
    """
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    counted = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    blocks = stored(_blocks(rows, counted[0], block), "negatives-rows")
    anchors = _blocks(rows.where(is_anchor), counted[1], block).select(
        "dims", F.col("block").alias("anchor_block"), *[F.col(c).alias(f"anchor_{c}") for c in ("ids", "labels", "q")]
    )
    anchors = stored(anchors, "negatives-anchors")
    anchor_blocks = max(1, -(-counted[1] // block))

    found = _meet(blocks, anchors, anchor_blocks).mapInArrow(
        _find_positives(positives), "dims int, anchor_block long, at int, positive_id long, positive_score long"
    )
    order = Window.partitionBy("dims", "anchor_block", "at").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    lists = first.groupBy("dims", "anchor_block").agg(
        F.sort_array(F.collect_list(F.struct("at", "rank", "positive_id", "positive_score"))).alias("p")
    ).select(
        "dims", "anchor_block", F.col("p.at").alias("at"), F.col("p.rank").alias("positive_ranks"),
        F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"),
    )
    asked = stored(anchors.join(lists, ["dims", "anchor_block"]), "negatives-windows")

    found = _meet(blocks, asked, anchor_blocks).mapInArrow(
        _find_negatives(negatives, low, high),
        "dims int, anchor_block long, list int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("dims", "anchor_block", "list").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
