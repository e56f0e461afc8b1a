"""Join helper with a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def join_levels(rows: DataFrame, levels: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join per-level summaries to rows: broadcast while they are counted to be small.

    Beyond ``BROADCAST_ROWS`` the join is left to a shuffle, where adaptive execution splits hot
    keys. ``levels`` should be cheap to count (a written or checkpointed summary).
    """
    small = levels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(levels) if small else levels, on, how)
