"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
TASK_ROWS = 50_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df`` has at most ``max_rows`` rows.

    The count stops at ``max_rows + 1``. A larger side is returned without a hint, so Spark plans
    a sort-merge join and adaptive execution splits its skewed partitions.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def tune_for_skew(spark) -> None:
    """Let adaptive execution split a hot join key even where that adds a shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def parts_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Partitions that hold about ``rows`` rows of ``df`` each.

    Adaptive execution joins partitions up to a size in compressed bytes. Paths and other repetitive texts are many
    times as large in the sorts of a task, so their shuffles are given a number, which it leaves as it is. Name only columns
    that vary: the optimizer folds a constant one, and the join then shuffles again.
    """
    return math.ceil(df.count() / rows) or 1
