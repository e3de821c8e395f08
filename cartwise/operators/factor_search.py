"""Exact search for the largest inner products between two tables of factors.

Products are sorted by the length of their vector and cut into blocks, longest first. Every
user meets the first block, which gives a score that the user's list cannot fall below. By
Cauchy-Schwarz, ``u . v <= |u| |v|``: a block whose longest vector, times the user's, stays
below that score has nothing for the user. Users are therefore dealt into blocks by the length
a product must have to matter to them, and a block of users is only joined with the blocks of
products that reach the smallest of these lengths. What is left out is never sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators.ranking import number_rows, top_k
from cartwise.session import materialise

BLOCK = 1024
#: Rounding of lengths and products stays far below this share.
MARGIN = 1e-9
FOUND = "user_index long, product_index long, predicted_rating double"


def _length():
    return F.sqrt(F.aggregate("features", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def _blocks(rows: DataFrame, key: str, order: list, block: int) -> DataFrame:
    """``(block, ids, features, longest)``: rows in the given order, ``block`` together."""
    placed = number_rows(rows, order, name="place", start=0).withColumn("block", F.floor(F.col("place") / block))
    members = F.sort_array(F.collect_list(F.struct("place", key, "features")))
    return placed.groupBy("block").agg(members.alias("m"), F.max("length").alias("longest")).select(
        "block", F.col(f"m.{key}").alias("ids"), F.flatten("m.features").alias("features"), "longest"
    )


def _matrix(ids: pa.ListScalar, features: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    ids = ids.values.to_numpy(zero_copy_only=False)
    return ids, features.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def _score(k: int):
    """Best ``k`` products of each user within each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                users, u = _matrix(batch["user_ids"][at], batch["user_features"][at])
                products, v = _matrix(batch["ids"][at], batch["features"][at])
                order = np.argsort(products)  # so that a stable sort leaves ties by product
                products, scores = products[order], u @ v[order].T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                taken = np.take_along_axis(scores, best, axis=1)
                columns = [np.repeat(users, best.shape[1]), products[best].ravel(), taken.ravel()]
                yield pa.record_batch([pa.array(c) for c in columns], ["user_index", "product_index", "predicted_rating"])

    return run


def _best(pairs: DataFrame, k: int) -> DataFrame:
    found = pairs.select("user_ids", "user_features", "ids", "features").mapInArrow(_score(k), FOUND)
    return top_k(found, k, [F.col("predicted_rating").desc(), F.col("product_index").asc()], ["user_index"])


def _as_users(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("block").alias("user_block"), F.col("ids").alias("user_ids"), F.col("features").alias("user_features"))


def search(users: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``top_products`` and, per block of users, ``(user_block, n_users, visited, skipped)`` blocks of products."""
    sized = items.withColumn("length", _length())
    item_blocks = materialise(_blocks(sized, "product_index", [F.col("length").desc(), F.col("product_index").asc()], block))
    known = materialise(users.withColumn("length", _length()))

    # One block of products, the longest; each block of users is one row beside it.
    dealt = F.pmod(F.xxhash64("user_index"), F.ceil(known.select(F.count(F.lit(1))).scalar() / block))
    some = known.groupBy(dealt.alias("block")).agg(F.collect_list(F.struct("user_index", "features")).alias("m"))
    some = _as_users(some.select("block", F.col("m.user_index").alias("ids"), F.flatten("m.features").alias("features")))
    longest = item_blocks.where("block = 0").withColumnRenamed("block", "step")
    first = materialise(_best(some.withColumn("step", F.lit(0).cast("long")).join(F.broadcast(longest), "step"), k))

    # Shorter products than ``reach`` cannot enter a full list; a negative bound rules nothing out.
    bounds = first.groupBy("user_index").agg(F.min("predicted_rating").alias("least"), F.count(F.lit(1)).alias("n"))
    full = (F.col("n") == k) & (F.col("least") > 0) & (F.col("length") > 0)
    reach = F.when(full, F.col("least") / F.col("length") * (1 - MARGIN)).otherwise(F.lit(-1.0))
    bounded = known.join(bounds, "user_index", "left").select("user_index", "features", reach.alias("length"))
    # ``longest`` of a block of users is not needed, the smallest reach is: blocks are sorted by it.
    placed = number_rows(bounded, [F.col("length").asc(), F.col("user_index").asc()], name="place", start=0)
    placed = placed.withColumn("block", F.floor(F.col("place") / block))
    user_blocks = materialise(
        placed.groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("place", "user_index", "features"))).alias("m"), F.min("length").alias("reach"))
        .select("block", F.col("m.user_index").alias("ids"), F.flatten("m.features").alias("features"), "reach")
    )
    # Blocks of products are sorted by length, so those a block of users needs are the first ones:
    # as many as there are at or above its reach in one common order.
    lengths = item_blocks.select(F.lit(None).cast("long").alias("user_block"), F.col("longest").alias("length"))
    asked = user_blocks.select(F.col("block").alias("user_block"), F.col("reach").alias("length"))
    order = [F.col("length").desc(), F.col("user_block").asc_nulls_first()]
    counted = number_rows(lengths.unionByName(asked), order, name="reached", counted=F.col("user_block").isNull())
    needed = materialise(counted.where(F.col("user_block").isNotNull() & (F.col("reached") > 0)).select("user_block", "reached"))
    steps = needed.where("reached > 1").select("user_block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reached") - 1)).alias("block"))
    more = steps.join(_as_users(user_blocks), "user_block").join(item_blocks, "block")
    both = first.unionByName(_best(more, k))
    result = top_k(both, k, [F.col("predicted_rating").desc(), F.col("product_index").asc()], ["user_index"])

    visited = F.greatest(F.coalesce("reached", F.lit(0)), F.lit(1))  # the first block is always visited
    total = item_blocks.select(F.count(F.lit(1))).scalar()
    report = user_blocks.select(F.col("block").alias("user_block"), F.size("ids").alias("n_users")).join(needed, "user_block", "left")
    return result, report.select("user_block", "n_users", visited.alias("visited"), (total - visited).alias("skipped"))


def top_products(users: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """``(user_index, product_index, predicted_rating)``: the ``k`` products with the largest inner product
    with each user, exactly; equal products go by the smaller index.

    ``users`` has ``user_index``, ``items`` has ``product_index``, both long, and both ``features``, an array of
    numbers of one length. Fewer than ``k`` products give shorter lists.
    """
    return search(users, items, k, block)[0]
