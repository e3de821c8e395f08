"""Product documents and exact TF-IDF in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.text import product_terms, without_stop_words


def product_documents(events: DataFrame) -> DataFrame:
    """One ``(product_id, brand, category_code)`` row per product; any text beats a blank."""
    return (
        events.where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(
            F.coalesce(F.max("brand"), F.lit("")).alias("brand"),
            F.coalesce(F.max("category_code"), F.lit("")).alias("category_code"),
        )
    )


def with_terms(documents: DataFrame, keep_blank: bool = True, stop_words: bool = False) -> DataFrame:
    """Add the ``terms`` array; stop words go unless ``stop_words`` is set."""
    terms = product_terms(F.col("brand"), F.col("category_code"), keep_blank)
    return documents.withColumn("terms", terms if stop_words else without_stop_words(terms))


def term_positions(with_terms_df: DataFrame) -> DataFrame:
    """``(product_id, pos, term)``."""
    return with_terms_df.select("product_id", F.posexplode("terms").alias("pos", "term")).withColumn(
        "pos", F.col("pos").cast("long")
    )


def term_frequency(with_terms_df: DataFrame, key: str = "product_id", *carry: str) -> DataFrame:
    """``(key, term, tf)``; exact counts, no hashing."""
    return (
        with_terms_df.select(key, *carry, F.explode("terms").alias("term"))
        .groupBy(key, *carry, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_frequency(tf: DataFrame, weight: str | None = None) -> DataFrame:
    """``(term, df)``: documents with the term. ``weight`` counts a row for several documents."""
    return tf.groupBy("term").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("df"))


def tfidf(tf: DataFrame, df: DataFrame, documents: DataFrame, weight: str | None = None) -> DataFrame:
    """Add ``df`` and ``w = tf * ln((N + 1) / (df + 1))`` to the term frequencies."""
    total = documents.select((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")).scalar()
    idf = F.log((total + 1).cast("double") / (F.col("df") + 1))
    return tf.join(df, "term").withColumn("w", F.col("tf") * idf)


def l2_normalise(weights: DataFrame, key: str = "product_id") -> DataFrame:
    """Divide each document's weights by their norm; a zero vector stays zero."""
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scaled = F.coalesce(F.col("w") / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0))
    return weights.join(norms, key).withColumn("w", scaled).drop("norm")
