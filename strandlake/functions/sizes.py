"""Sizes checked before a table is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dictionary is broadcast; a larger one is shuffled.
SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has most rows or fewer (at most one more is counted)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
