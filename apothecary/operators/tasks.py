"""How many tasks a shuffle gets."""

from __future__ import annotations

from pyspark.sql import DataFrame


def tasks_for(rows: DataFrame, most: int = 250_000, least: int = 60_000) -> int:
    """A number of tasks with about ``most`` of ``rows`` each at the most, however many rows there are.

    Shuffles that are joined by Spark on its own go by their compressed bytes,
    so their tasks grow with the input up to a size whose sorts and hash tables
    fill an executor. Small inputs get up to the shuffle partitions set, with
    ``least`` rows each. The rows are counted, so give a plain table.
    """
    n = rows.count()
    few = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // least))
    return max(1, few, -(-n // most))
