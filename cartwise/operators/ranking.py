"""Row numbers, top-k and de-duplication that hold when one group is a third of the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.session import written


def top_k(df: DataFrame, k: int, order_by: Sequence[Column], per: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows, overall or per group. ``order_by`` must be a total order.

    The ``row_number() <= k`` form lets Spark cut each group to ``k`` rows before
    the shuffle (WindowGroupLimit), so a hot group never travels whole.
    """
    if not per:
        return df.orderBy(*order_by).limit(k)
    window = Window.partitionBy(*per).orderBy(*order_by)
    return df.withColumn("_row", F.row_number().over(window)).where(F.col("_row") <= k).drop("_row")


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column],
    per: Sequence[str] = (),
    name: str = "rank",
    start: int = 1,
    counted: Column | None = None,
) -> DataFrame:
    """Number *all* rows of each group (or of the table) in order, however large the group.

    With ``counted`` only the rows it is true for count; other rows get the number of
    the last one that counts (``start - 1`` before the first).

    The one exchange deals rows into ranges of (group, order), so a large group spans several
    tasks. A row's place in its sorted range gives its number there; the table is written with
    these. What a range adds to the ranges after it is known from its first and last row: two
    rows per range go to the driver, and at most one shift per range comes back as a broadcast.
    """
    in_order = [*[F.col(c).asc() for c in per], *order_by]
    ranged = df.repartitionByRange(*in_order).sortWithinPartitions(*in_order)
    # The id counts the rows of a partition from 0, below the partition's number.
    ranged = ranged.withColumns({_AT: F.monotonically_increasing_id()})
    own = F.shiftrightunsigned(_AT, 33)
    if not per and counted is None:
        numbered = written(ranged, "numbered")
        rows = numbered.groupBy(own.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        shifts, total = [], 0
        for part, n in sorted(tuple(r) for r in rows):
            shifts.append((part, total))
            total += n
        local, applies = F.col(_AT).bitwiseAND((1 << 33) - 1) + 1, F.lit(True)
    else:
        one = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
        fed = ranged.withColumn(_ONE, one)
        numbered = written(fed.mapInArrow(_count_in_groups(list(per)), _numbered_schema(fed)), "numbered")
        shifts = _shifts(numbered.where(_EDGE).select(_AT, _ROW, _HEAD, *per).orderBy(_AT).collect())
        local, applies = F.col(_ROW), F.col(_HEAD)
    moved = df.sparkSession.createDataFrame(shifts, f"{_PART} long, {_SHIFT} long")
    number = (local + F.coalesce(_SHIFT, F.lit(0)) + F.lit(start - 1)).cast("long")
    joined = numbered.join(F.broadcast(moved), (own == F.col(_PART)) & applies, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], number.alias(name))


_AT, _ONE, _ROW, _HEAD, _EDGE, _PART, _SHIFT = (f"__{n}" for n in ("at", "one", "row", "head", "edge", "part", "shift"))


def _numbered_schema(fed: DataFrame) -> T.StructType:
    kept = [field for field in fed.schema if field.name != _ONE]
    return T.StructType([*kept, T.StructField(_ROW, T.LongType()), T.StructField(_HEAD, T.BooleanType()), T.StructField(_EDGE, T.BooleanType())])


def _same(a, b) -> bool:
    """Equal as group keys: null equals null, NaN equals NaN."""
    return a == b or (a != a and b != b)


def _count_in_groups(per: list[str]):
    """For sorted rows: the count within the group so far in this partition, whether the group is the
    partition's first, and whether the row is its first or last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, count, head = None, None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            for c in per:  # codes are equal for equal values, null and NaN included
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                starts[1:] |= codes[1:] != codes[:-1]
            keys = [[batch.column(c)[at].as_py() for c in per] for at in (0, n - 1)]
            starts[0] = last is not None and not all(map(_same, keys[0], last))
            one = batch.column(_ONE).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(one)
            opened = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            before = np.where(opened >= 0, (total - one)[opened], -count)
            row = total - before
            heads = np.full(n, head) & (opened < 0)
            last, count, head = keys[1], int(row[-1]), bool(heads[-1])
            edge = np.zeros(n, bool)
            if held is None:
                edge[0] = True
            else:
                yield _appended(*held)
            held = (batch, row, heads, edge)
        if held is not None:
            held[3][-1] = True
            yield _appended(*held)

    return run


def _appended(batch: pa.RecordBatch, row: np.ndarray, heads: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != _ONE]
    columns = [*[batch.column(c) for c in kept], pa.array(row), pa.array(heads), pa.array(edge)]
    return pa.RecordBatch.from_arrays(columns, [*kept, _ROW, _HEAD, _EDGE])


def _shifts(edges: list) -> list[tuple[int, int]]:
    """``(part, rows of its first group in earlier parts)`` from the first and last row of each part, in order."""
    shifts, before, last = [], 0, None
    for at, row, head, *key in (tuple(r) for r in edges):
        part = at >> 33
        if last is None or part != last[0]:  # the first row of its part
            shift = before if last is not None and all(map(_same, key, last[1])) else 0
            shifts.append((part, shift))
        before, last = row + (shifts[-1][1] if head else 0), (part, key)
    return [s for s in shifts if s[1]]


def best_per_key(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Highest score per key; same rows as ranking the key's rows and keeping rank 1."""
    return df.groupBy(*keys).agg(F.max(score).alias(score))


def dedupe_across_users(scored: DataFrame) -> DataFrame:
    """One row per (product, score) over all users; the smallest user id keeps it."""
    return scored.groupBy("product_id", "final_score").agg(F.min("user_id").alias("user_id")).select(
        "user_id", "product_id", "final_score"
    )


def first_by_priority(df: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """One row per key: the one with the lowest ``priority``, as an aggregate with map-side combine."""
    others = [c for c in df.columns if c not in keys and c != priority]
    best = F.min(F.struct(F.col(priority), *[F.col(c) for c in others])).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns])
