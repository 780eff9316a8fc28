"""Size checks before broadcasting a table that is derived from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

MAX_BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the table provably has at most ``max_rows`` rows
    (counted, stopping early); otherwise leave the join to Spark/AQE."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def small_table(df: DataFrame) -> DataFrame:
    """Materialise a small derived table once (reliable checkpoint) so counting it
    for a size check does not re-run the plan that produced it."""
    return checkpointed(df)
