"""Working tables in the folder that all executors share, and the number of tasks for a size."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textloom.scratch import Scratch, shared_root

__all__ = ["Scratch", "partitions", "shared_root"]


def partitions(spark: SparkSession, size: float, each: float) -> int:
    """Number of tasks for ``size`` at ``each`` at most a task, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-size // each)))
