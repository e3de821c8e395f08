"""Stages of the corpus pipeline: operators applied to a table with the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import line_dedup, near_dedup, packing, pii, toxicity
from cartwise.llm.common import aside, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model learns from ``labels``.

    A null text is scored as an empty one. Repeated rows are judged alike. All columns of ``docs``
    stay as they are, also if they have the names ``score`` or ``predicted``.
    """
    lean, back = aside(docs, ("score", "predicted"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return back(toxicity.score(lean, model).where("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but for the earliest; a document left without text goes with them. Null and
    empty texts and all columns stay; copies of a row lose the same lines."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest id stays, and every
    document that is in no group. Null and empty texts are in none; rows that repeat an id stay or
    go together."""
    groups = near_dedup.near_groups(docs, size=5, percent=80)
    gone = groups.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id"))
    return docs.alias("d").join(gone.alias("gone"), same, "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by the name of its kind; all documents and columns stay.
    Null and empty texts stay as they are; repeated rows are masked alike."""
    lean, back = aside(docs, ("pii",))
    return back(pii.masked(lean, pii.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in training sequences of 4096 tokens. A null or empty text is a piece
    of its end id alone; rows that repeat an id are packed one by one."""
    return packing.pack_documents(docs)
