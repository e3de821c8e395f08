"""The test tables seen as the tables the jobs work on (``FIXTURES.md``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.operators.ratings import rate_events
from cartwise.session import dealt, tasks_for

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# As-of time of the queries that would otherwise follow the clock.
AS_OF = "2024-01-31 00:00:00"

# Times at which the stream queries cut the events into triggers.
HALF = "2024-01-15 00:00:00"
LAST_DAYS = "2024-01-29 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who did what to which product when: the part of ``shop_events`` that needs no product table."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        F.get_json_object("props", "$.k").cast("long").alias("product_id"),
        F.col("value").alias("price"),
        "user_id",
    )


def shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clickstream events with nulls in category, brand and price."""
    events, part = interactions(spark, sf_dir), table(spark, sf_dir, "part")

    def unless_every(n: int, value):
        return F.when(F.col("event_id") % n != 0, value)

    category = F.lower(F.concat("p_type", F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit("."))))
    day = F.col("event_time").cast("date").cast("string")
    return events.join(part, events.product_id == part.p_partkey, "left").select(
        "event_id",
        "event_time",
        "event_type",
        "product_id",
        F.col("p_size").cast("long").alias("category_id"),
        unless_every(13, category).alias("category_code"),
        unless_every(17, F.col("p_brand")).alias("brand"),
        unless_every(19, F.col("price")).alias("price"),
        "user_id",
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), day).alias("user_session"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.lower(F.concat("p_type", F.lit("."), "p_name")).alias("category_code"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
    )


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders, in as many tasks as the lines need (counted from the files' footers); neither side is held whole."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = tasks_for(lines.count())
    lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    return lines.join(orders.hint("merge"), lines.l_orderkey == orders.o_orderkey)


def purchase_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events: the large event table."""
    kind = (
        F.when(F.col("l_returnflag") == "A", "cart")
        .when(F.col("l_returnflag") == "N", "view")
        .when(F.col("l_returnflag") == "R", "purchase")
    )
    return _order_lines(spark, sf_dir).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_orderdate").alias("event_time"),
        kind.alias("event_type"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


def scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored row per order line, some scores missing (null or NaN) and many pairs repeated."""
    net = F.sqrt(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    score = (
        F.when(F.col("l_tax") == 0, F.lit(None).cast("double"))
        .when(F.col("l_discount") == 0, F.lit(float("nan")))
        .otherwise(net)
    )
    return _order_lines(spark, sf_dir).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"), score.alias("final_score")
    )


def fulfilled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's history as what was ordered and delivered: some have none, most a few, some many."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("event_time"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def cf_standin(events: DataFrame) -> DataFrame:
    """Mean rating per user and product, in place of ALS where the result is checked by SQL."""
    rated = rate_events(events).select("user_id", "product_id", "rating")
    return (
        dealt(rated, "user_id", "product_id")
        .groupBy("user_id", "product_id")
        .agg(F.round(F.avg("rating"), 6).alias("predicted_rating"))
    )


def standin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cf_standin`` of the large event table as scores; scores of a product repeat across users."""
    return cf_standin(purchase_log(spark, sf_dir)).select(
        "user_id", "product_id", F.col("predicted_rating").alias("final_score")
    )


def raw_messages(events: DataFrame) -> DataFrame:
    """Events as they arrive: padded text, some explicit nulls, some not JSON at all."""
    sent = events.withColumns(
        {
            "event_time": F.concat(F.date_format("event_time", TIME_FORMAT), F.lit(" UTC")),
            "brand": F.concat(F.lit("  "), "brand", F.lit(" ")),
        }
    )
    body = F.struct(*sent.columns)
    value = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("ERR event "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "signup", F.to_json(body, {"ignoreNullFields": "false"}))
        .otherwise(F.to_json(body))
    )
    return sent.select(value.alias("value"))


def readable_time(df: DataFrame, column: str = "event_time") -> DataFrame:
    """Time as text, so both engines print it alike."""
    return df.withColumn(column, F.date_format(column, TIME_FORMAT))
