"""Event-time windows over the request stream: an extension beside the exact batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.tokens import sat_sum


def usage_per_window(requests: DataFrame, width: str = "1 hour", late_by: str | None = None) -> DataFrame:
    """Requests and tokens per window and model, on a batch or a stream.

    On a stream ``late_by`` bounds the kept state; rows later than that are dropped, so the result is
    approximate there.
    """
    if late_by is not None:
        requests = requests.withWatermark("ts", late_by)
    return requests.groupBy(F.window("ts", width), "model").agg(
        F.count("*").alias("requests"), sat_sum(F.col("input")).alias("input"), sat_sum(F.col("output")).alias("output")
    )
