"""Request ledgers: in-file deduplication and ownership across sessions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.tokens import sat_sum, total_tokens
from sessionlake.plans.blockfold import fold_blocks
from sessionlake.sources.records import REQUEST_COLUMNS
from sessionlake.sources.scan import offset_block


def _preference() -> Column:
    """Which report of one request to keep: main chain, more tokens, known speed, earliest."""
    return F.struct(
        (~F.col("is_sidechain")).alias("main"),
        total_tokens(F.col).alias("total"),
        (F.coalesce(F.col("speed"), F.lit("")) != "").alias("fast"),
        (-F.col("byte_offset")).alias("at"),
        (-F.col("ordinal")).alias("nth"),
    )


def _best(rows: DataFrame, by: list[str]) -> DataFrame:
    kept = [name for name in rows.columns if name not in by]
    return (
        rows.groupBy(*by)
        .agg(
            F.max_by(F.struct(*kept), _preference()).alias("best"),
            F.min(F.struct("byte_offset", "ordinal")).alias("ledger_at"),
        )
        .select(*by, "best.*", "ledger_at")
    )


def _assign(rows: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str]:
    """Entry of every report of one message, reports in line order.

    Reports without a request id join the message's first entry. A new request id joins it too
    while the entry's best report has no request id, and opens an entry of its own otherwise.
    """
    held = json.loads(state) if state else {"rank": None, "bare": True, "joined": {}}
    entries = []
    for request_id, main, total, fast in zip(rows["request_id"], rows["main"], rows["total"], rows["fast"]):
        first = held["rank"] is None
        if request_id in held["joined"]:
            joins = held["joined"][request_id]
        else:
            joins = first or request_id == "" or held["bare"]
            held["joined"][request_id] = joins
        rank = [bool(main), int(total), bool(fast)]
        if joins and (first or rank > held["rank"]):
            held["rank"], held["bare"] = rank, request_id == ""
        entries.append("" if joins else request_id)
    return pd.DataFrame({"entry": entries}), json.dumps(held)


def dedup_requests(requests: DataFrame) -> DataFrame:
    """One row per billed request of a file.

    Reports merge on message and request id by a map-side combined arg-max. Messages that mix empty
    and non-empty request ids follow an order-dependent rule and take the blocked fold. Reports
    without a message id are never merged.
    """
    named = requests.where("message_id <> ''")
    loose = requests.where("message_id = ''").withColumn("ledger_at", F.struct("byte_offset", "ordinal"))
    by = ["agent", "node_id", "message_id"]
    mixed = (
        named.groupBy(*by)
        .agg(F.bool_or(F.col("request_id") == "").alias("bare"), F.bool_or(F.col("request_id") != "").alias("given"))
        .where("bare AND given")
        .select(*by)
    )
    columns = [*REQUEST_COLUMNS, "ledger_at"]
    if mixed.isEmpty():
        return _best(named, [*by, "request_id"]).select(*columns).unionByName(loose.select(*columns))
    plain = _best(named.join(mixed, by, "left_anti"), [*by, "request_id"])
    tangled = named.join(mixed, by, "left_semi")
    ranked = tangled.select(*by, "byte_offset", "request_id", _preference().alias("p")).select(
        *by, "byte_offset", "request_id", "p.main", "p.total", "p.fast"
    )
    entries = fold_blocks(ranked, by, "byte_offset", offset_block(), _assign, "entry string")
    resolved = _best(tangled.join(entries, [*by, "byte_offset"]), [*by, "entry"])
    return (
        plain.select(*columns).unionByName(resolved.select(*columns)).unionByName(loose.select(*columns))
    )


def attribute_ownership(priced: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``owner_id`` and ``is_duplicate`` to the requests of top-level sessions.

    ``sessions`` holds node_id, session_id, started_at of the top-level sessions of an agent. The
    session that started first owns a request key; requests without a message id own themselves
    and skip the shuffle by key, where they would form one huge group.
    """
    starts = sessions.select("agent", "node_id", F.struct("started_at", "session_id", "node_id").alias("origin"))
    rooted = priced.join(starts, ["agent", "node_id"])
    keyed = rooted.where("message_id <> ''")
    loose = rooted.where("message_id = ''")
    key = ["agent", "message_id", "request_id"]
    owners = keyed.groupBy(*key).agg(F.min("origin").alias("owner"))
    owned = keyed.join(owners, key)
    both = owned.unionByName(loose.withColumn("owner", F.col("origin")))
    return (
        both.withColumn("owner_id", F.col("owner.node_id"))
        .withColumn("is_duplicate", F.col("owner.node_id") != F.col("node_id"))
        .drop("owner", "origin")
    )


def replay_report(attributed: DataFrame) -> DataFrame:
    """Replayed amount and request count per session and owning session."""
    return (
        attributed.where("is_duplicate")
        .groupBy("agent", "node_id", "owner_id")
        .agg(F.sum("usd").alias("usd"), F.count("*").alias("requests"))
    )


def usage_by_model(priced: DataFrame, attributed: DataFrame | None = None) -> DataFrame:
    """Own tokens and cost of every node per model; with ``attributed`` also the replayed amount."""
    from sessionlake.functions.tokens import uncached_input

    table = priced.groupBy("agent", "node_id", "model").agg(
        sat_sum(uncached_input(F.col)).alias("uncached_input"),
        sat_sum(F.col("output")).alias("output"),
        sat_sum(F.col("write_5m")).alias("write_5m"),
        sat_sum(F.col("write_1h")).alias("write_1h"),
        sat_sum(F.col("cache_read")).alias("cache_read"),
        sat_sum(total_tokens(F.col)).alias("total"),
        F.sum("usd").alias("usd"),
        F.count("*").alias("requests"),
        F.bool_or("missing").alias("missing"),
        F.bool_or("estimated").alias("estimated"),
        F.min(F.struct("byte_offset", "ordinal")).alias("first_at"),
    )
    if attributed is None:
        return table
    replayed = (
        attributed.where("is_duplicate")
        .groupBy("agent", "node_id", "model")
        .agg(F.sum("usd").alias("replayed_usd"))
    )
    joined = table.join(replayed, ["agent", "node_id", "model"], "left").fillna(0.0, ["replayed_usd"])
    return joined.withColumn("owned_usd", F.greatest(F.lit(0.0), F.col("usd") - F.col("replayed_usd")))


def costliest_model(by_model: DataFrame) -> DataFrame:
    """Most expensive model of each node, ties to the first seen, with the count of the others."""
    from sessionlake.functions.text import short_model

    first = F.struct(-F.col("first_at.byte_offset"), -F.col("first_at.ordinal"))
    best = by_model.groupBy("agent", "node_id").agg(
        F.max_by(F.struct("model", "missing"), F.struct(F.col("usd"), first)).alias("top"),
        F.count("*").alias("models"),
        F.max("usd").alias("usd"),
    )
    label = F.concat(
        short_model(F.col("top.model")),
        F.when(F.col("models") > 1, F.concat(F.lit(" +"), (F.col("models") - 1).cast("string"))).otherwise(""),
        F.when(F.col("top.missing"), F.lit("!")).otherwise(""),
    )
    return best.select("agent", "node_id", F.col("top.model").alias("model"), "models", "usd", label.alias("label"))
