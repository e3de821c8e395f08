"""Event time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_timestamp(text: Column) -> Column:
    """Timestamp from ISO text with or without a zone (``2019-10-01 00:00:00 UTC``); null if unreadable."""
    return F.trim(text).try_cast("timestamp")
