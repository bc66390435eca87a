"""Running aggregates over ordered groups of any size.

A plain ``Window.partitionBy(group)`` sorts a whole group inside one task. Here every group is cut
into blocks of its order key. Each block is aggregated on its own, the one-row-per-block carries
are combined in order, and the window runs only inside a block. A group that holds a third of all
rows is therefore spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlake.plans.staging import stage

BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max, min, first or last (non-null)."""

    kind: str
    expr: Column
    inclusive: bool = True


def _block_value(spec: Running, order: Column) -> Column:
    if spec.kind == "sum":
        return F.sum(spec.expr)
    if spec.kind == "max":
        return F.max(spec.expr)
    if spec.kind == "min":
        return F.min(spec.expr)
    known = F.when(spec.expr.isNotNull(), order)
    return F.min_by(spec.expr, known) if spec.kind == "first" else F.max_by(spec.expr, known)


def _over(kind: str, value: Column, window) -> Column:
    if kind in ("first", "last"):
        picked = F.first(value, ignorenulls=True) if kind == "first" else F.last(value, ignorenulls=True)
        return picked.over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry + local, carry, local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(carry, local) if kind == "first" else F.coalesce(local, carry)


def range_blocks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a block column that cuts the whole table along ``order`` into parts of about equal size.

    Staged, because a range partitioning that is computed again may cut elsewhere.
    """
    return stage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "ranges")


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    block: Column,
    specs: dict[str, Running],
) -> DataFrame:
    """Add the running values ``specs`` to ``df``.

    ``block`` must never decrease along ``order`` inside a group, ``order`` must be total there,
    and the ``by`` columns must not be null.
    """
    key = [*by, BLOCK]
    blocked = df.withColumn(BLOCK, block)
    per_block = blocked.groupBy(*key).agg(
        *[_block_value(spec, F.struct(*order)).alias(f"__b_{name}") for name, spec in specs.items()]
    )
    before = W.partitionBy(*by).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carries = per_block.select(
        *key,
        *[_over(spec.kind, F.col(f"__b_{name}"), before).alias(f"__c_{name}") for name, spec in specs.items()],
    )
    inside = W.partitionBy(*key).orderBy(*order)
    values = []
    for name, spec in specs.items():
        frame = inside.rowsBetween(W.unboundedPreceding, 0 if spec.inclusive else -1)
        local = _over(spec.kind, spec.expr, frame)
        values.append(_combine(spec.kind, F.col(f"__c_{name}"), local).alias(name))
    out = blocked.join(carries, key).select("*", *values)
    return out.drop(BLOCK, *[f"__c_{name}" for name in specs])


def following(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    block: Column,
    name: str,
    expr: Column,
) -> DataFrame:
    """Add ``name``: the next non-null ``expr`` strictly after each row of its group."""
    key = [*by, BLOCK]
    blocked = df.withColumn(BLOCK, block)
    per_block = blocked.groupBy(*key).agg(
        F.min_by(expr, F.when(expr.isNotNull(), F.struct(*order))).alias("__b")
    )
    after = W.partitionBy(*by).orderBy(BLOCK).rowsBetween(1, W.unboundedFollowing)
    carries = per_block.select(*key, F.first("__b", ignorenulls=True).over(after).alias("__c"))
    inside = W.partitionBy(*key).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    out = blocked.join(carries, key).withColumn(
        name, F.coalesce(F.first(expr, ignorenulls=True).over(inside), F.col("__c"))
    )
    return out.drop(BLOCK, "__c")
