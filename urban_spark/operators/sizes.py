"""Sizes that decide on a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few narrow columns that are broadcast at most.
MOST_ROWS = 200_000


def small(df: DataFrame, rows: int = MOST_ROWS) -> DataFrame:
    """`df`, hinted for a broadcast if it has at most `rows` rows; with more the join shuffles. Counts at most one row more."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
