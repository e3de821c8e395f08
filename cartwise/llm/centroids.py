"""Exact k-means on integer vectors by Shallot search.

Each vector remembers its centroid, the second-nearest one, an upper bound of its distance to
the first and a lower bound of that to all others. When centroids move, the bounds move with
them; only where they cross is anything computed. Then the vector's exact distances to both
remembered centroids are taken, and the search starts from the closer one: its neighbours are
visited by their distance from it, up to the distance of the vector from the start plus that
to the second-nearest centroid found so far. Nothing beyond this ball can be among the two
nearest. The ball shrinks while the search finds closer centroids. Bounds are floating-point
with a margin; every centroid that they cannot rule out is compared by its integer squared
distance, so that results and ties are exact.

A round is one pass over the vectors, with the few centroids sent along; the vectors with
their bounds are written as a table between rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import forget, slices, stored_at
from cartwise.llm.vectors import integer_vectors

#: Margin of a bound, far above the error of a double's square root and sum.
MARGIN = 1e-9
STATE = "vec_id long, q array<int>, cluster int, second int, upper double, lower double, distance long"


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the centroid in the same row."""
    gap = x - centroids
    return np.einsum("ij,ij->i", gap, gap)


def moved_bounds(first: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that still hold after each centroid went as far as ``moves`` says."""
    order = np.argsort(moves)
    others = np.full(len(moves), moves[order[-1]])
    others[order[-1]] = moves[order[-2]] if len(moves) > 1 else 0.0
    return (upper + moves[first]) * (1 + MARGIN), (lower - others[first]) * (1 - MARGIN)


def assign(
    x: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row of ``x`` (ties: the smaller number), the second-nearest one as far
    as known, the bounds, and how many integer distances were computed."""
    first, second, upper, lower = first.copy(), second.copy(), upper.copy(), lower.copy()
    k = len(centroids)
    if k == 1:
        return first * 0, first * 0, np.zeros(len(x)), np.full(len(x), np.inf), 0
    between = np.sqrt(np.stack([_squared(centroids, np.broadcast_to(c, centroids.shape)) for c in centroids]).astype(float))
    ranked = np.argsort(between, axis=1, kind="stable")
    alone = between.copy()
    np.fill_diagonal(alone, np.inf)
    half = alone.min(1) / 2  # no other centroid is nearer to what lies closer than this

    safe = lambda rows: upper[rows] * (1 + MARGIN) < np.maximum(lower[rows], half[first[rows]]) * (1 - MARGIN)
    rows = np.flatnonzero(~safe(slice(None)))
    near = _squared(x[rows], centroids[first[rows]])
    upper[rows] = np.sqrt(near.astype(float))
    computed = len(rows)
    wide = ~safe(rows)
    rows, near = rows[wide], near[wide]
    if not len(rows):
        return first, second, upper, lower, computed

    # The nearest and the second-nearest of the two remembered centroids.
    a, b, other = first[rows], second[rows], _squared(x[rows], centroids[second[rows]])
    computed += len(rows)
    swap = (other < near) | ((other == near) & (b < a))
    a, b, near, other = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, other, near), np.where(swap, near, other)
    start, known, from_start = a.copy(), b.copy(), np.sqrt(near.astype(float))
    active = np.arange(len(rows))
    for rank in range(k):
        candidate = ranked[start[active], rank]
        ball = (from_start[active] + np.sqrt(other[active].astype(float))) * (1 + MARGIN)
        inside = between[start[active], candidate] * (1 - MARGIN) <= ball
        active, candidate = active[inside], candidate[inside]  # further neighbours are farther still
        if not len(active):
            break
        new = (candidate != start[active]) & (candidate != known[active])
        at, c = active[new], candidate[new]
        distance = _squared(x[rows[at]], centroids[c])
        computed += len(at)
        best = (distance < near[at]) | ((distance == near[at]) & (c < a[at]))
        b[at], other[at] = (
            np.where(best, a[at], np.where(distance < other[at], c, b[at])),
            np.where(best, near[at], np.minimum(distance, other[at])),
        )
        a[at], near[at] = np.where(best, c, a[at]), np.where(best, distance, near[at])
    first[rows], second[rows] = a, b
    upper[rows], lower[rows] = np.sqrt(near.astype(float)), np.sqrt(other.astype(float))
    return first, second, upper, lower, computed


def _round(centroids: np.ndarray, moves: np.ndarray, rows: int = 4096):
    """One pass: bounds follow the centroids, vectors their nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            if not batch.num_rows:
                continue
            vec_id, q, first, second, upper, lower = (batch.column(n) for n in ("vec_id", "q", "cluster", "second", "upper", "lower"))
            x = q.flatten().to_numpy(zero_copy_only=False).reshape(-1, centroids.shape[1]).astype(np.int64)
            first, second = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (first, second))
            bounds = moved_bounds(first, upper.to_numpy(zero_copy_only=False), lower.to_numpy(zero_copy_only=False), moves)
            first, second, high, low, _ = assign(x, first, second, *bounds, centroids)
            distance = _squared(x, centroids[first])
            columns = [vec_id, q, pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(high), pa.array(low), pa.array(distance)]
            yield pa.record_batch(columns, ["vec_id", "q", "cluster", "second", "upper", "lower", "distance"])

    return run


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for each vector kept.

    ``vectors`` has ``vec_id`` (long) and ``embedding``; ``integer_vectors`` says which rows take no
    part. Centroids start as the ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>`` (a
    null id comes last, equal ids by their vectors; fewer than ``k`` rows give fewer centroids).
    After each of ``rounds`` assignments a centroid becomes the floor of its vectors' mean; one
    without vectors stays. Repeated rows count one by one; no rows give no result rows. Sums
    that do not fit in 64 bits are null.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors.withColumn("vec_id", F.col("vec_id").cast("long")), ["vec_id"], scale=scale, dims=dims)
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    picked = rows.orderBy(place.asc_nulls_last(), "q").limit(k).collect()
    centroids = np.array([r.q for r in picked], np.int64).reshape(-1, dims)
    moves = np.zeros(max(1, len(centroids)))
    unknown = {"cluster": F.lit(0), "second": F.lit(min(1, len(centroids) - 1)), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}
    state, path = rows.withColumns(unknown), None
    for turn in range(rounds + 1 if len(centroids) else 0):
        before = path
        state, path = stored_at(state.mapInArrow(_round(centroids, moves), STATE), "centroids-state")
        if before:
            forget(spark, before)  # the new table does not depend on it any more
        if turn == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(dims)])
        updated = centroids.copy()
        for r in sums.collect():  # one row for each centroid at most
            updated[r.cluster] = [s // r.n for s in r[2:]]
        moves = np.sqrt(_squared(centroids, updated).astype(float)) * (1 + MARGIN)
        centroids = updated

    if not len(centroids):
        state = spark.createDataFrame([], STATE)
    # What is known of a centroid: as many rows as there are centroids.
    sums = {r.cluster: r.total for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    fits = lambda total: int(total) if total < 1 << 63 else None
    about = spark.createDataFrame(
        [
            (c, fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c in sorted(sums)
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return state.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
