"""Score components of retrieval as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weight of an expansion path relative to a direct hit
VIA_WEIGHTS = {
    "continuation": 1.0,
    "shared_entity": 0.8,
    "shared_topic": 0.6,
    "cooccurring_topic": 0.4,
}


def recency(started_at: Column, now: Column, half_life_days: float = 120) -> Column:
    """Half-life decay of age; a future or unknown date scores 1."""
    days = (F.unix_millis(now) - F.unix_millis(started_at)) / F.lit(86_400_000.0)
    age = F.greatest(F.lit(0.0), days)
    return F.coalesce(
        F.pow(F.lit(0.5), age / F.lit(float(max(1, half_life_days)))), F.lit(1.0)
    )


def via_weight(via: Column) -> Column:
    pairs = [F.lit(x) for kv in VIA_WEIGHTS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), via)


def node_size(degree: Column) -> Column:
    """Display radius of a node."""
    return F.lit(4.0) + F.lit(2.0) * F.sqrt(degree.cast("double"))
