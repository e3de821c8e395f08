from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def events(spark, rows):
    """Events from ``(user_id, event_type, product_id[, hours])``; text and price follow the product."""
    made = []
    for at, row in enumerate(rows):
        user, kind, product = row[:3]
        hours = row[3] if len(row) > 3 else at
        made.append(
            (at, START + timedelta(hours=hours), kind, product, 1, f"home.item{product}", "acme", 1.0 * (product or 0), user, "s")
        )
    from cartwise.schema import KEYED_EVENTS

    return spark.createDataFrame(made, KEYED_EVENTS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())
