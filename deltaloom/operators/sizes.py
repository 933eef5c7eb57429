"""Broadcasts behind a check of their size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 100_000


def if_small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` for a broadcast if it has at most ``rows`` rows; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
