"""Broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of names, classes or edges that is broadcast at most; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has few rows; counting stops there."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def spread(table: DataFrame, a_core: int = 4) -> DataFrame:
    """The table dealt evenly over the session's cores, `a_core` pieces to each, for work that is long for its bytes: Spark
    cuts files by bytes, so a few MB of short rows would be one task."""
    return table.repartition(a_core * table.sparkSession.sparkContext.defaultParallelism)
