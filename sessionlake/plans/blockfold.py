"""Exact sequential folds, run in parallel over blocks of a group.

Some rules depend on their own earlier output, so no window can express them. Groups of ordinary
size are folded whole, many of them in one call, as a call costs more than a small group. A larger group is cut into blocks of equal row count and every block is folded
by itself: the first pass starts each block from the empty state, and a block whose real incoming
state turns out to differ is folded again with that state until no incoming state changes any more.
The result equals one sequential pass, no task ever holds more than one block, and only the small
per-block states are exchanged between passes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlake.plans.running import Running, running
from sessionlake.plans.staging import stage

BLOCK, BIN = "__fold", "__bin"
ROWS_PER_BLOCK = 8192

# (rows of one block in order, incoming state or None) -> (one decision per row, outgoing state)
Step = Callable[[pd.DataFrame, str | None], tuple[pd.DataFrame, str]]


def fold_blocks(
    df: DataFrame, by: list[str], order: str, block: Column, step: Step, decision_schema: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Fold every ``by`` group of ``df`` in ``order``; return one decision row per input row.

    ``step`` must depend on nothing but its arguments. ``decision_schema`` names the columns of
    the decisions, which are returned next to ``by`` and ``order``. ``block`` is any coarse cut along
    ``order``; it only serves to number the rows of large groups.
    """
    types = dict(df.dtypes)
    decided_schema = ", ".join([*(f"`{name}` {types[name]}" for name in [*by, order]), decision_schema])

    def decide(keys, pdf):
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        used = pdf["__carry"].iloc[0]
        decisions, _ = step(pdf, None if pd.isna(used) else used)
        head = pd.DataFrame({name: value for name, value in zip(by, keys)}, index=range(len(pdf)))
        return pd.concat([head, pdf[[order]], decisions.reset_index(drop=True)], axis=1)

    def decide_all(pdf):
        pdf = pdf.assign(**{BIN: pdf.groupby(by, dropna=False, sort=False).ngroup()}).sort_values([BIN, order], kind="stable").reset_index(drop=True)
        cuts = [0, *(np.flatnonzero(np.diff(pdf[BIN])) + 1), len(pdf)]
        decided = [step(pdf.iloc[first:end].reset_index(drop=True), None)[0] for first, end in zip(cuts, cuts[1:])]
        return pd.concat([pdf[[*by, order]], pd.concat(decided, ignore_index=True)], axis=1)

    df = stage(df, "fold-rows")
    no_carry = F.lit(None).cast("string")
    large = stage(df.groupBy(*by).count().where(F.col("count") > rows_per_block).select(*by), "fold-large")
    bins = df.count() // rows_per_block + 1
    bin_of = F.pmod(F.xxhash64(*by), F.lit(bins))
    if large.isEmpty():
        return df.groupBy(bin_of.alias(BIN)).applyInPandas(decide_all, decided_schema)

    whole = df.join(large, by, "left_anti").groupBy(bin_of.alias(BIN)).applyInPandas(decide_all, decided_schema)
    numbered = running(df.join(large, by, "left_semi"), by, [F.col(order)], block, {"__nth": Running("sum", F.lit(1))})
    cut = stage(numbered.withColumn(BLOCK, F.floor((F.col("__nth") - 1) / rows_per_block)).drop("__nth"), "fold-blocks")
    key = [*by, BLOCK]
    state_schema = ", ".join([*(f"`{name}` {types[name]}" for name in by), f"`{BLOCK}` bigint, used string, state string"])

    def states(keys, pdf):
        pdf = pdf.sort_values(order, kind="stable")
        used = pdf["__carry"].iloc[0]
        used = None if pd.isna(used) else used
        return pd.DataFrame([[*keys, used, step(pdf, used)[1]]], columns=[*key, "used", "state"])

    table = stage(cut.withColumn("__carry", no_carry).groupBy(*key).applyInPandas(states, state_schema), "fold-states")
    previous = W.partitionBy(*by).orderBy(BLOCK)
    while True:
        incoming = table.withColumn("want", F.lag("state").over(previous))
        stale = incoming.where(~F.col("want").eqNullSafe(F.col("used"))).select(*key, F.col("want").alias("__carry"))
        if stale.isEmpty():
            break
        redone = cut.join(stale, key).groupBy(*key).applyInPandas(states, state_schema)
        kept = table.join(stale.select(*key), key, "left_anti")
        table = stage(kept.unionByName(redone), "fold-states")
    ready = cut.join(table.select(*key, F.col("used").alias("__carry")), key)
    return whole.unionByName(ready.groupBy(*key).applyInPandas(lambda keys, pdf: decide(keys[:-1], pdf), decided_schema))
