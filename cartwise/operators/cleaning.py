"""Null handling, duplicates and first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators.ranking import number_rows

# Columns filled before training, by kind.
NUMBER_TYPES = {"product_id": "long", "category_id": "long", "price": "double", "user_id": "long"}
TEXT_COLUMNS = ("category_code", "brand", "user_session")


def fill_missing(events: DataFrame) -> DataFrame:
    """Numbers to 0 with their table type, text to ``''``; other columns untouched."""
    filled = {
        name: F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind))
        for name, kind in NUMBER_TYPES.items()
        if name in events.columns
    }
    filled |= {name: F.coalesce(F.col(name), F.lit("")) for name in TEXT_COLUMNS if name in events.columns}
    return events.withColumns(filled)


def identified(events: DataFrame) -> DataFrame:
    """Events that name their user and their product; after ``fill_missing`` the others would all
    belong to user 0 and product 0."""
    return events.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column, or in any of ``columns``."""
    return df.dropna(how="any", subset=list(columns) if columns else None)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed; copies collapse map-side before the shuffle."""
    return df.dropDuplicates()


def first_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in key order, of any number: rows are numbered in ranges of the key, so no
    task gets them all. ``order_by`` must be a total order."""
    place = "__place"
    numbered = number_rows(df, [F.col(c).asc() for c in order_by], name=place)
    return numbered.where(F.col(place) <= n).select(*df.columns)


def training_rows(events: DataFrame) -> DataFrame:
    """Rows a model is trained on: complete rows, no duplicates."""
    return distinct_rows(drop_incomplete(events))
