"""Tasks by rows. Spark sizes the tasks after a shuffle by compressed bytes, so a task would get millions of rows once tables grow."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Rows of a task, about; fewer while cores are free, but not below `LEAST`.
ROWS, LEAST = 100_000, 10_000


def tasks(rows: DataFrame, n: int) -> int:
    """How many tasks n rows are dealt to."""
    return max(1, math.ceil(n / ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST))
