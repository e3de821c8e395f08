"""Near-duplicates by circulant MinHash, banding and exact verification.

A shingle's hash gives a position in a circle of ``CIRCLE`` places (the first permutation); a
second permutation gives each place a value. Coordinate k of a signature is the least value at
the positions shifted by k, so two permutations make all coordinates. Texts with the same
shingle set are one node from the start, whatever their number. Nodes that agree in all rows of
a band share a bucket.

A bucket of many nodes is not expanded into pairs: each node meets the leader of its bucket
first; verified links join nodes to components; only then do nodes that are still apart from
the component of their leader meet the nodes of other components in their bucket. Every two
nodes of a bucket thus end in one component or have been compared on their full sets, or a link
is ruled out exactly: by their sizes; because their distances from the first leader differ by
more than a link allows (the Jaccard distance keeps the triangle inequality); or because counts
of their shingles by groups show that they share too few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import UPPER, slices, stored, text_of

CIRCLE = 1 << 20
BANDS, ROWS = 64, 8  # a pair at 0.8 is missed with probability 8e-6, one at 0.5 met with 0.2
#: Leaders are chosen anew until a round finds less than this part of all links so far. What is
#: left is compared in full, so this decides about work only, not about results.
FEW = 64
GROUPS = 64
NO_ID = -(1 << 63)
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hash of a word; a bounded number of words is kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 50_000:
            self.clear()
        self[word] = out
        return out


def shingle_set(text: str, size: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``size`` are one shingle, none are none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(own))
    run = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        run = (run + own[k : len(own) - width + 1 + k]) * _MULTIPLIER
        run ^= run >> np.uint64(29)
    return np.unique(_mixed(run))


@lru_cache(maxsize=1)
def _circle() -> np.ndarray:
    """Windows of the second permutation: row p holds the values at p, p + 1, ..."""
    values = np.random.default_rng(20_240_613).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: BANDS * ROWS]]), BANDS * ROWS)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the signature."""
    place = (shingles >> np.uint64(44)).astype(np.int64)
    rows = _circle()
    least = np.min([rows[place[i : i + 2048]].min(0) for i in range(0, len(place), 2048)], 0).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):  # a band takes coordinates far from each other
        key = _mixed(key * _MULTIPLIER + row)
    return key


def _signed(numbers: np.ndarray) -> np.ndarray:
    return numbers.view(np.int64)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))


def _signed_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands`` (both null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in slices(batches):
            n, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, size, hashes)
                n.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                bands.append(_signed(band_keys(own)) if len(own) else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "bands"])

    return _documents(docs).mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _full_sets(texts: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of ``doc_id, text``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in slices(batches):
            sets = [_signed(shingle_set(t, size, hashes)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(gather, "node long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node it reaches) for the nodes of ``edges`` (``a``, ``b``)."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("old")
        )
        step = stored(step, "labels")
        jump = step.select(F.col("node").alias("via"), F.col("component").alias("to"))
        step = step.join(jump, F.col("component") == F.col("via"))
        moved = stored(step.select("node", F.least("component", "to").alias("component"), "old"), "labels")
        labels = moved.drop("old")
        if moved.where("component != old").isEmpty():
            return labels


def _sizes_fit(percent: int) -> Column:
    """Whether the numbers of shingles of a row's two nodes let them reach the similarity."""
    return (F.col("low") * percent <= F.col("other_high") * 100) & (F.col("other_low") * percent <= F.col("high") * 100)


def _as_other(prefix: str = "", columns: tuple[str, ...] = ("node", "low", "high")) -> list[Column]:
    return [F.col(f"{prefix}{c}").alias("other" if c == "node" else f"other_{c}") for c in columns]


def _outlines(sets: DataFrame) -> DataFrame:
    """``node, outline``: how many of a node's shingles fall into each of ``GROUPS`` groups of the hash, those
    left out that no other node of ``sets`` has. For nodes with one set.

    Two nodes share at most the sum of the lesser counts, group by group.
    """
    single = sets.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    common = each.distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle")
    group = F.pmod(F.col("shingle"), F.lit(GROUPS))
    counted = each.join(common, "shingle", "left_semi").withColumn("group", group).groupBy("node").agg(
        F.array(*[F.count_if(F.col("group") == g).cast("int") for g in range(GROUPS)]).alias("outline")
    )
    none = F.array(*[F.lit(0)] * GROUPS)  # all shingles are the node's own
    return single.join(counted, "node", "left").select("node", F.coalesce("outline", none).alias("outline"))


def _unled_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that share a bucket, one of them apart from the bucket's
    leading component: each pair once, in the first bucket that both are in, and none whose sizes,
    outlines or distances from the first leader rule a link out."""
    others = apart.select(
        F.col("bucket").alias("other_bucket"),
        *_as_other(columns=("node", "low", "high", "component", "distance", "own", "outline")),
        (F.col("component") != F.col("leading")).alias("other_apart"),
    )
    # What both may share, against what a link needs of it: null where a node has several sets.
    least = F.aggregate(F.zip_with("outline", "other_outline", lambda a, b: F.least(a, b)), F.lit(0), lambda total, x: total + x)
    little = least * (100 + percent) < (F.col("high") + F.col("other_high")) * percent
    far = F.abs(F.col("distance") - F.col("other_distance")) > 1 - percent / 100 + 1e-9
    meet = (
        (F.col("bucket") == F.col("other_bucket"))
        & (F.col("component") != F.col("other_component"))
        & (~F.col("other_apart") | (F.col("node") < F.col("other")))
        & _sizes_fit(percent)
        & ~F.coalesce(far, F.lit(False))
        & ~F.coalesce(little, F.lit(False))
        & (F.col("bucket") == F.array_min(F.array_intersect("own", "other_own")))
    )
    return apart.where("component != leading").join(others, meet)


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``;
    other columns are ignored).

    Two documents are linked when 100 * |intersection| >= ``percent`` * |union| of their sets of
    ``size``-word shingles; ``component_id`` is the smallest ``doc_id`` reachable, and that
    document is kept. A text without words is linked with nothing. Repeated rows are all kept or
    all not; rows that repeat an id with another text are judged by their own text, and links of
    either count for both once one of them stands for its copies. The missing id is below all others
    and shown as null. An empty table gives no rows.
    """
    signed = stored(_signed_sets(docs, size), "signatures")
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"))
    classes = stored(classes, "classes")
    own = signed.select(F.col("set_key").alias("key"), "doc_id", "n_shingles", "bands")
    nodes = classes.join(own, (F.col("set_key") == F.col("key")) & (F.col("doc_id") == F.col("node")))
    banded = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("bucket")
    members = stored(banded.join(shared, "bucket", "left_semi"), "buckets")

    candidates = members.select("node").distinct()
    texts = _documents(docs).join(candidates, F.col("doc_id") == F.col("node")).select("doc_id", "text")
    sets = stored(_full_sets(texts, size).where(F.size("shingles") > 0).distinct(), "shingle-sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    sizes = sets.groupBy("node").agg(F.min(F.size("shingles")).alias("low"), F.max(F.size("shingles")).alias("high"))
    members = stored(members.join(sizes, "node"), "buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        """``a, b, linked, distance`` of each pair, on full sets; several sets of one node count together."""
        both = F.size(F.array_intersect("of_a", "of_b"))
        union = F.size("of_a") + F.size("of_b") - both
        met = pairs.join(left, "a").join(right, "b").select("a", "b", (both * 100 >= union * percent).alias("linked"), (1 - both / union).alias("distance"))
        return met.groupBy("a", "b").agg(F.max("linked").alias("linked"), F.min("distance").alias("distance"), F.count(F.lit(1)).alias("sets"))

    fits = _sizes_fit(percent)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where(fits).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    def with_leader(rows: DataFrame, turn: int) -> DataFrame:
        """Beside every node of a bucket: the node of the bucket's largest component that comes first in
        the order of the turn."""
        rank = F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node", "low", "high", "component")
        heads = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("head"))
        largest = F.max(F.struct("n", F.col("head.rank").alias("by"), "head"))
        return rows.join(heads.groupBy("bucket").agg(largest["head"].alias("leader")), "bucket")

    labelled = members.withColumn("component", F.col("node"))
    compared = links = None
    turn = total = 0
    while True:
        led = with_leader(labelled, turn).where("component != leader.component")
        pairs = ordered(led.select("node", "low", "high", *_as_other("leader.")))
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        found = stored(verified(pairs), "pairs")
        compared = found.select("a", "b") if compared is None else compared.unionByName(found.select("a", "b"))
        if turn == 0:
            # How far each node is from its bucket's first leader, where that is known and the node has one set.
            first = with_leader(labelled, 0).select(
                "bucket", "node", F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")
            )
            known = found.where("sets = 1").select("a", "b", "distance")
            members = stored(members.join(first.join(known, ["a", "b"]).drop("a", "b"), ["bucket", "node"], "left"), "buckets")
        found = found.where("linked").select("a", "b")
        new = found.count()
        total += new
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        labelled = stored(labelled, "buckets")
        turn += 1
        if turn > 1 and new * FEW <= total:
            break
    # Nodes apart from the largest component of their bucket meet the nodes of other components, in the
    # first bucket that both are in.
    led = with_leader(labelled, 0).withColumn("leading", F.col("leader.component")).drop("leader")
    mixed = led.where("component != leading").select("bucket").distinct()
    apart = led.join(mixed, "bucket", "left_semi")
    alone = apart.groupBy("node").agg(F.collect_list("bucket").alias("own"))
    alone = stored(alone.join(_outlines(sets.join(alone, "node", "left_semi")), "node", "left"), "outlines")
    apart = stored(apart.join(alone, "node"), "apart")
    rest = _unled_pairs(apart, percent)
    rest = ordered(rest).join(compared, ["a", "b"], "left_anti")
    found = stored(verified(rest).where("linked").select("a", "b"), "links")
    if not found.isEmpty():
        labels = components(links.unionByName(found))

    named = classes.join(labels.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(
        F.col("set_key").alias("key"), F.coalesce("component", "node").alias("component")
    )
    placed = signed.join(named, F.col("set_key") == F.col("key"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")
    )
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return placed.select(
        shown("doc_id").alias("doc_id"),
        "n_shingles",
        shown("component").alias("component_id"),
        (F.col("doc_id") == F.col("component")).alias("kept"),
    )
