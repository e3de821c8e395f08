"""Scores an event type is worth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Implicit rating and ranking weight of each event type.
RATING_OF = {"purchase": 0.5, "cart": 0.3, "view": 0.1}
WEIGHT_OF = {"view": 1, "cart": 2, "purchase": 3}

# Share of the collaborative and of the content score.
CF_SHARE = 0.7
CONTENT_SHARE = 0.3


def _lookup(event_type: Column, table: dict, other) -> Column:
    expression = F
    for name, value in table.items():
        expression = expression.when(event_type == name, F.lit(value))
    return expression.otherwise(F.lit(other))


def implicit_rating(event_type: Column) -> Column:
    """Rating of an event; types without a meaning rate 0."""
    return _lookup(event_type, RATING_OF, 0.0)


def interest_weight(event_type: Column) -> Column:
    """Ranking weight of an event; null for other types, so sums skip it."""
    return _lookup(event_type, WEIGHT_OF, None).cast("long")


def blend(cf_score: Column, content_score: Column) -> Column:
    """Hybrid score; ``content_score`` already carries its share."""
    return cf_score * F.lit(CF_SHARE) + content_score
