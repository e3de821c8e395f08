"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_FIELDS = [
    T.StructField("event_time", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("user_session", T.StringType()),
]

EVENTS = T.StructType(EVENT_FIELDS)

# Same table with the row key that orders rows for a cap or a split.
KEYED_EVENTS = T.StructType([T.StructField("event_id", T.LongType()), *EVENT_FIELDS])

EVENT_COLUMNS = [field.name for field in EVENT_FIELDS]

RECOMMENDATIONS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("final_score", T.DoubleType()),
    ]
)
