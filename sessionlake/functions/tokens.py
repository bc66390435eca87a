"""Token arithmetic. Counters are 64-bit and saturate instead of overflowing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COUNTER = 9223372036854775807
COUNTERS = ["input", "output", "write_5m", "write_1h", "cache_read"]


def sat_add(*columns: Column) -> Column:
    """Saturating sum of non-negative counters."""
    total = columns[0]
    for column in columns[1:]:
        total = F.coalesce(F.try_add(total, column), F.lit(MAX_COUNTER))
    return total


def sat_sum(column: Column) -> Column:
    """Saturating SUM aggregate."""
    return F.least(
        F.coalesce(F.sum(column.cast("decimal(38,0)")), F.lit(0)), F.lit(MAX_COUNTER).cast("decimal(38,0)")
    ).cast("bigint")


def uncached_input(usage) -> Column:
    """Input tokens not served from cache; ``usage`` maps a counter name to its column."""
    inside = F.greatest(F.lit(0), usage("input") - usage("cache_read"))
    return F.when(usage("includes_cache_read"), inside).otherwise(usage("input"))


def total_tokens(usage) -> Column:
    outside = F.when(usage("includes_cache_read"), F.lit(0)).otherwise(usage("cache_read"))
    return sat_add(usage("input"), usage("output"), usage("write_5m"), usage("write_1h"), outside)


def context_tokens(usage) -> Column:
    """Size of the request's prompt, which is the context window in use."""
    outside = F.when(usage("includes_cache_read"), F.lit(0)).otherwise(usage("cache_read"))
    return sat_add(usage("input"), outside, usage("write_5m"), usage("write_1h"))


def flow_tokens(usage) -> Column:
    """New tokens a request adds: uncached input, output and cache writes."""
    return sat_add(uncached_input(usage), usage("output"), usage("write_5m"), usage("write_1h"))


def cost_valid(usd: Column) -> Column:
    """NaN, infinite and negative amounts read as 0."""
    bad = F.isnan(usd) | (usd == float("inf")) | (usd < 0) | usd.isNull()
    return F.when(bad, F.lit(0.0)).otherwise(usd)
