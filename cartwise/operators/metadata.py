"""Product metadata and the join that adds it to a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators.joins import skew_join

METADATA_COLUMNS = ["category_code", "brand", "price"]
FOLDED_COLUMNS = ["n_variants", "n_brands", "max_price"]
UNKNOWN = "Unknown"


def metadata_variants(events: DataFrame) -> DataFrame:
    """Every distinct (product, category, brand, price); a product may have several."""
    return events.select("product_id", *METADATA_COLUMNS).distinct()


def latest_metadata(events: DataFrame, tie_break: str = "event_id") -> DataFrame:
    """One row per product: the values of its newest event."""
    newest = F.max_by(F.struct(*METADATA_COLUMNS), F.struct("event_time", tie_break)).alias("_m")
    return events.groupBy("product_id").agg(newest).select("product_id", "_m.*")


def add_metadata(items: DataFrame, metadata: DataFrame, spread_by: Sequence[str] = ()) -> DataFrame:
    """Left join on product; missing brand and category read ``Unknown``.

    With ``spread_by`` a product that many items share is split over tasks by these columns.
    """
    joined = skew_join(items, metadata, "product_id", spread_by) if spread_by else items.join(metadata, "product_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in ("brand", "category_code")}).select(
        *items.columns, *METADATA_COLUMNS
    )


def add_folded_metadata(items: DataFrame, metadata: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """The rows that ``add_metadata`` gives an item, folded to how many there are, their brands and highest price.

    The variants of a product are folded before they meet the items, so each is read once and not once
    for each item that shows the product.
    """
    folded = metadata.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.count_distinct(F.coalesce("brand", F.lit(UNKNOWN))).alias("n_brands"),
        F.max("price").alias("max_price"),
    )
    joined = skew_join(items, folded, "product_id", spread_by)
    # Without metadata there is one row, of an unknown brand.
    one = {c: F.coalesce(c, F.lit(1).cast("long")) for c in ("n_variants", "n_brands")}
    return joined.withColumns(one).select(*items.columns, *FOLDED_COLUMNS)
