"""Helpers shared by the record projections of both transcript formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as T

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"

USAGE_TYPE = (
    "STRUCT<model STRING, input BIGINT, output BIGINT, write_5m BIGINT, write_1h BIGINT, "
    "cache_read BIGINT, includes_cache_read BOOLEAN, speed STRING, cost_usd DOUBLE>"
)
USAGE_FIELDS = [
    "model", "input", "output", "write_5m", "write_1h", "cache_read", "includes_cache_read", "speed", "cost_usd",
]
REQUEST_COLUMNS = [
    "agent", "node_id", "message_id", "request_id", "byte_offset", "ordinal", "is_sidechain", "is_aggregate",
    *USAGE_FIELDS,
]


def parse_lines(raw: DataFrame, schema: str) -> DataFrame:
    """Add the parsed record ``r`` of every line; unreadable lines and wrongly typed fields drop the line.

    With an option given, the parse keeps its whole schema, so that a wrong type in any field shows.
    Generated rather than projected, the parse is not copied into every filter above it.
    """
    record = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    return raw.select("*", F.explode(F.array(record)).alias("r")).where("r._corrupt_record IS NULL")


def timestamp_of(raw: Column) -> Column:
    """RFC 3339 text as TIMESTAMP; null for anything else."""
    return F.when(F.rlike(raw, F.lit(RFC3339)), F.try_to_timestamp(raw))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def number_or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("bigint")


def usage_total(usage: Column) -> Column:
    from sessionlake.functions.tokens import total_tokens

    return total_tokens(lambda name: usage.getField(name))


def first_known(value: Column, order: Column, when: Column | None = None) -> Column:
    """Aggregate: the earliest non-empty value."""
    known = value.isNotNull() if when is None else value.isNotNull() & when
    return F.min_by(value, F.when(known, order))


def non_empty(column: Column) -> Column:
    return F.when(column != "", column)


def distinct_models(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Models of each group in first-seen order, as ``models``."""
    seen = rows.groupBy(*by, "model").agg(F.min(order).alias("at"))
    packed = F.sort_array(F.collect_list(F.struct("at", "model")))
    return seen.groupBy(*by).agg(F.transform(packed, lambda item: item["model"]).alias("models"))


def cleaned(column: Column) -> Column:
    return T.clean_timeline_text(text_or_empty(column))
