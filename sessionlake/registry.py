"""Registered queries: every operator applied to the given tables, whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import text, tokens
from sessionlake.functions.matching import compile_matcher
from sessionlake.operators import graph, ledger, manifest, pricing, search, sessions, timeline, tree
from sessionlake.plans.staging import shared_folder, stage
from sessionlake.sources import claude, codex, scan, tables
from sessionlake.sources.pricing import overlay_pricing
from sessionlake.sources.records import USAGE_FIELDS, distinct_models
from sessionlake.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def usd(column: str, alias: str | None = None):
    """Amounts are compared to eight digits, below every rate granularity in use."""
    return F.round(F.col(column), 8).alias(alias or column)


def priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price_requests(tables.event_requests(spark, sf_dir), tables.event_pricing(spark))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated and priced request ledger of the events table."""
    requests = ledger.dedup_requests(tables.event_requests(spark, sf_dir))
    return stage(pricing.price_requests(requests, tables.event_pricing(spark)), "priced-ledger")  # read several times


def attributed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.attribute_ownership(ledger_events(spark, sf_dir), tables.event_sessions(spark, sf_dir))


@query
def price_requests(spark, sf_dir):
    return priced_events(spark, sf_dir).select(
        F.col("byte_offset").alias("event_id"), "model", "speed", "pricing_model", "priced", "missing", usd("usd")
    )


@query
def cost_buckets(spark, sf_dir):
    buckets = pricing.cost_buckets(priced_events(spark, sf_dir), ["model"])
    return buckets.select("model", "category", F.round("rate", 12).alias("rate"), "tokens", "above")


@query
def cost_buckets_by_node(spark, sf_dir):
    buckets = pricing.cost_buckets(priced_events(spark, sf_dir))
    total = buckets.groupBy("node_id", "category").agg(
        F.sum(F.col("rate") * F.col("tokens")).alias("usd"), F.sum("tokens").alias("tokens"), F.count("*").alias("buckets")
    )
    return total.select("node_id", "category", usd("usd"), "tokens", "buckets")


@query
def standin_prices(spark, sf_dir):
    """Stand-in rates over an overlaid price table; models are made of event types."""
    floor = tables.event_pricing(spark)
    overlay = spark.createDataFrame(
        [("gpt-5-view", 7e-6, 21e-6), ("openai/gpt-5-click", 1e-6, 3e-6), ("click", 9e-6, 9e-6)],
        "model string, input double, output double",
    )
    for name in [name for name in floor.columns if name not in overlay.columns]:
        overlay = overlay.withColumn(name, F.lit(None).cast("double"))
    prices = overlay_pricing(floor, overlay.select(*floor.columns))
    kind = F.col("request_id")
    suffix = (
        F.when(F.col("byte_offset") % 4 == 0, "-sol").when(F.col("byte_offset") % 4 == 1, "-terra").when(F.col("byte_offset") % 4 == 2, "-luna").otherwise("")
    )
    requests = tables.event_requests(spark, sf_dir).withColumns(
        {
            "agent": F.lit("codex"),
            "model": F.when(kind.isin("view", "click"), F.concat(F.lit("gpt-5-"), kind, suffix)).otherwise(kind),
            "speed": F.lit(""),
            "includes_cache_read": F.lit(True),
            "write_5m": F.lit(0).cast("bigint"),
            "write_1h": F.lit(0).cast("bigint"),
        }
    )
    return pricing.price_requests(requests, prices, "purchase").select(
        F.col("byte_offset").alias("event_id"), "model", "pricing_model", "exact", "estimated", usd("usd")
    )


@query
def dedup_requests(spark, sf_dir):
    return ledger.dedup_requests(tables.event_requests(spark, sf_dir)).select(
        F.col("node_id").alias("user_id"), "message_id", "request_id", F.col("byte_offset").alias("event_id"), "input", "is_sidechain",
        F.col("ledger_at.byte_offset").alias("first_event_id"),
    )


@query
def owned_cost(spark, sf_dir):
    return (
        attributed_events(spark, sf_dir)
        .groupBy(F.col("node_id").alias("user_id"))
        .agg(
            F.sum("usd").alias("gross_usd"),
            F.sum(F.when(F.col("is_duplicate"), 0.0).otherwise(F.col("usd"))).alias("owned_usd"),
            F.count_if("is_duplicate").alias("replayed"),
            F.sum(F.when(F.col("is_duplicate"), 0).otherwise(F.col("input"))).alias("owned_input"),
        )
        .select("user_id", usd("gross_usd"), usd("owned_usd"), "replayed", "owned_input")
    )


@query
def replay_report(spark, sf_dir):
    return ledger.replay_report(attributed_events(spark, sf_dir)).select(
        F.col("node_id").alias("user_id"), "owner_id", usd("usd"), "requests"
    )


@query
def usage_by_model(spark, sf_dir):
    rows = ledger.usage_by_model(ledger_events(spark, sf_dir), attributed_events(spark, sf_dir))
    return rows.select(
        F.col("node_id").alias("user_id"), "model", "uncached_input", "output", "write_5m", "write_1h", "cache_read",
        "total", "requests", usd("usd"), usd("replayed_usd"), usd("owned_usd"),
    )


@query
def costliest_model(spark, sf_dir):
    rows = ledger.costliest_model(ledger.usage_by_model(ledger_events(spark, sf_dir)))
    return rows.select(F.col("node_id").alias("user_id"), "model", "models", usd("usd"), "label")


# --- listing -----------------------------------------------------------------------------------


def _user_roots(spark, sf_dir):
    """Users as rolled-up root sessions: owned tokens and cost of the events ledger."""
    attributed = attributed_events(spark, sf_dir)
    own = attributed.where("NOT is_duplicate").groupBy("agent", "node_id").agg(
        F.sum("usd").alias("total_usd"),
        F.sum(F.col("input") + F.col("output") + F.col("write_5m") + F.col("write_1h") + F.col("cache_read")).alias("total_total"),
        F.bool_or("estimated").alias("total_estimated"),
        F.array_sort(F.collect_set(F.when(F.col("missing"), F.col("model")))).alias("total_missing"),
    )
    sessions_of = tables.event_sessions(spark, sf_dir)
    user = F.col("node_id").cast("bigint")
    described = sessions_of.withColumns(
        {
            "project": F.concat(F.lit("p"), (user % 4).cast("string")),
            "cwd": F.concat(F.lit("/work/p"), (user % 4).cast("string"), F.lit("/u"), F.col("node_id")),
            "title": F.concat(F.lit("User "), F.col("node_id")),
        }
    )
    return described.join(own, ["agent", "node_id"], "left").withColumns(
        {
            "total_usd": F.coalesce("total_usd", F.lit(0.0)),
            "total_total": F.coalesce("total_total", F.lit(0)),
            "total_estimated": F.coalesce("total_estimated", F.lit(False)),
            "total_missing": F.coalesce("total_missing", F.array().cast("array<string>")),
        }
    )


@query
def list_sessions(spark, sf_dir):
    """Top twenty by owned tokens below one directory, second page."""
    roots = sessions.filter_sessions(_user_roots(spark, sf_dir), agent="claude", cwd="/work/p1", until="2030-01-01")
    paged = sessions.page(roots, sessions.sort_sessions(roots, "tokens", "desc"), 20, 5)
    return paged.select("session_id", "project", "messages", F.col("total_total").alias("tokens"), usd("total_usd", "usd"))


@query
def list_page_info(spark, sf_dir):
    roots = sessions.filter_sessions(_user_roots(spark, sf_dir), project="p2", since="2024-01-29T12:00:00Z")
    return sessions.page_info(roots, 10, 3)


@query
def list_fuzzy(spark, sf_dir):
    """Fuzzy match over customers as sessions."""
    rows = tables.table(spark, sf_dir, "customer").select(
        F.lit("claude").alias("agent"), F.col("c_mktsegment").alias("project"), F.col("c_name").alias("title"), "c_custkey"
    )
    return sessions.filter_sessions(rows, query="Mach 01").select("c_custkey", "project", "title")


@query
def sort_display(spark, sf_dir):
    """Display order by project, descending, as an explicit rank."""
    roots = _user_roots(spark, sf_dir).withColumn("path", F.col("node_id"))
    order = sessions.sort_display("project", descending=True)
    return sessions.ranked(roots, order).select(F.col("__nth").alias("rank"), "project", "path", "messages")


@query
def corpus_summary(spark, sf_dir):
    row = tree.corpus_summary(_user_roots(spark, sf_dir))
    return row.select("sessions", "projects", usd("usd"), "estimated", F.array_join("missing_pricing", ",").alias("missing_pricing"))


# --- trees -------------------------------------------------------------------------------------


@query
def tree_closure(spark, sf_dir):
    _, edges = tables.place_tree(spark, sf_dir)
    return tree.closure(edges).select("ancestor", "descendant", "depth")


@query
def top_level_only(spark, sf_dir):
    """Places that are nobody's child."""
    nodes, edges = tables.place_tree(spark, sf_dir)
    return tree.roots_of(nodes, edges).select("node_id", "title")


@query
def group_models(spark, sf_dir):
    """Market segments as models of customers; a nation takes the union of its customers'."""
    nodes, edges = tables.place_tree(spark, sf_dir)
    models = tables.table(spark, sf_dir, "customer").select(
        F.lit("claude").alias("agent"), F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"), F.array("c_mktsegment").alias("models")
    )
    return graph.group_models(models, nodes, edges).select("node_id", F.array_join("models", ",").alias("models"))


@query
def cost_valid(spark, sf_dir):
    """Account balances and values beyond numbers as amounts of cost."""
    balance = F.col("c_acctbal")
    odd = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 7 == 1, F.lit(float("inf"))).when(F.col("c_custkey") % 7 == 2, F.lit(None).cast("double")).otherwise(balance)
    return tables.table(spark, sf_dir, "customer").select("c_custkey", tokens.cost_valid(odd).alias("usd"))


@query
def session_graph(spark, sf_dir):
    """Parts as transcript files of every role: direct, grouped and legacy children of their sessions."""
    roles = stage(scan.classify_path(_part_files(spark, sf_dir)), "roles")
    part = F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long")
    session = F.concat(F.lit("p"), (part - part % 5).cast("string"))
    none = F.lit("")
    summaries = roles.select(
        "agent", "path", session.alias("session_id"), session.alias("file_session_id"), none.alias("cwd"), none.alias("project"), none.alias("title"),
        none.alias("title_prompt"), none.alias("git_branch"), F.lit(None).cast("timestamp").alias("started_at"), none.alias("started_raw"),
        F.lit(None).cast("timestamp").alias("updated_at"), none.alias("updated_raw"), F.lit(0).cast("bigint").alias("messages"),
        F.lit(False).alias("has_error"), none.alias("agent_path"), none.alias("parent_id"),
    )
    runs = summaries.select("agent", "path", none.alias("run_id"), none.alias("run_title")).where("false")
    return graph.claude_graph(summaries, roles, runs)[1].select("parent", "child")


def _places(spark, sf_dir):
    nodes, edges = tables.place_tree(spark, sf_dir)
    return nodes, edges, tree.closure(edges)


@query
def tree_rollup(spark, sf_dir):
    nodes, edges = tables.place_tree(spark, sf_dir)
    rolled = tree.rollup(nodes, tables.order_totals(spark, sf_dir), edges)
    return rolled.select(
        "node_id", "self_total", "desc_total", "total_total", F.round("total_usd", 2).alias("total_usd"), F.round("desc_usd", 2).alias("desc_usd"),
        "subagents", "total_estimated", F.array_join("total_missing", ",").alias("missing"), "updated_at",
    )


@query
def tree_standins(spark, sf_dir):
    """Stand-in rates of every subtree, each pair once, where the priorities of pending orders stand for models."""
    nodes, edges = tables.place_tree(spark, sf_dir)
    rates = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.concat(F.lit("c"), F.col("o_custkey")).alias("node_id")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("o_orderpriority").alias("model"), F.substring("o_orderpriority", 1, 1).alias("pricing_model")))).alias("pending"))
    totals = tables.order_totals(spark, sf_dir).join(rates, "node_id", "left")
    none = F.array().cast("array<struct<model:string,pricing_model:string>>")
    totals = totals.withColumn("estimated_rates", F.coalesce(F.col("pending"), none)).drop("pending")
    rolled = tree.rollup(nodes, totals, edges)
    return rolled.select("node_id", F.array_join(F.transform("total_rates", lambda rate: F.concat(rate["model"], F.lit(">"), rate["pricing_model"])), ",").alias("rates"))


@query
def tree_preorder(spark, sf_dir):
    """Depth and position in the pre-order listing of every tree."""
    nodes, _, pairs = _places(spark, sf_dir)
    listed = tree.preorder(nodes, pairs)
    return listed.select("node_id", "root_id", "depth", F.array_join(F.transform("sort_path", lambda key: key["node_id"]), "/").alias("sort_path"))


@query
def cost_tree(spark, sf_dir):
    nodes, edges, pairs = _places(spark, sf_dir)
    rolled = tree.rollup(nodes, tables.order_totals(spark, sf_dir), edges)
    return tree.cost_tree(rolled, pairs, "r1").select(
        "node_id", "depth", "title", "self_uncached_input", "total_uncached_input", F.round("own_usd", 2).alias("own_usd"), F.round("total_usd", 2).alias("total_usd")
    )


@query
def canonical_ref(spark, sf_dir):
    nodes, _, pairs = _places(spark, sf_dir)
    spaced = nodes.withColumn("session_id", F.regexp_replace("title", "#", " ~*&/"))
    return tree.with_refs(spaced, pairs).select("node_id", "root_id", "depth", "ref")


@query
def addressable(spark, sf_dir):
    """Trees in which some reference occurs twice are rejected: customer names repeat modulo 997."""
    nodes, _, pairs = _places(spark, sf_dir)
    key = F.regexp_extract("node_id", r"(\d+)$", 1).cast("bigint")
    folded = nodes.withColumn("session_id", F.when(F.startswith("node_id", F.lit("c")), F.concat(F.lit("c"), key % 997)).otherwise(F.col("node_id")))
    _, rejected = tree.addressable(tree.with_refs(folded, pairs))
    return rejected.select("path", "code", "message")


@query
def resolve_selector(spark, sf_dir):
    """Selectors made from customer names: references, ids, prefixes and misses."""
    nodes, _, pairs = _places(spark, sf_dir)
    named = tree.with_refs(nodes.withColumn("session_id", F.col("title")), pairs)
    name = F.col("c_name")
    selectors = tables.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 4 == 0, name)
        .when(F.col("c_custkey") % 4 == 1, F.substring(name, 1, 17))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("/lake/c"), F.col("c_custkey"), F.lit(".jsonl")))
        .otherwise(F.concat(F.lit("no-"), name))
        .alias("selector")
    )
    found = tree.resolve_selector(selectors, named)
    return found.groupBy("selector", "status").agg(F.max("candidates").alias("candidates"), F.min("ref").alias("first_ref"))


@query
def subagent_refs(spark, sf_dir):
    nodes, edges, pairs = _places(spark, sf_dir)
    return tree.subagent_refs(tree.with_refs(nodes, pairs), edges).select("ref", "child_ref")


@query
def sibling_titles(spark, sf_dir):
    """Customers of a nation with colliding titles take the first prompt line no sibling shares."""
    nodes, edges = tables.place_tree(spark, sf_dir)
    customers = tables.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"),
        F.concat_ws("\n", F.col("c_mktsegment"), F.concat(F.lit("balance "), F.floor(F.col("c_acctbal") / 10).cast("string")), F.col("c_name")).alias("prompt"),
    )
    worded = nodes.join(customers, "node_id").withColumns(
        {"title": F.substring_index("prompt", "\n", 1), "title_prompt": F.col("prompt")}
    ).drop("prompt")
    return tree.sibling_titles(worded, edges).select("node_id", "title")


@query
def filter_scope(spark, sf_dir):
    """Search scope of one nation: the node and its descendants only."""
    nodes, _, pairs = _places(spark, sf_dir)
    named = tree.with_refs(nodes, pairs)
    start = "claude:r1#n1"
    scoped = search.filter_scope(search.scope_nodes(named, start), pairs)
    return scoped.select("node_id", "root_ref")


@query
def link_spawn(spark, sf_dir):
    """Suppliers as spawn calls that name market segments, customers of their nation as children; late results move calls."""
    nation = lambda key: F.concat(F.lit("n"), F.col(key))
    segment = F.element_at(F.array(*map(F.lit, ["automobile", "BUILDING", "Furniture", "nobody", "MACHINERY"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    suppliers, customers = tables.table(spark, sf_dir, "supplier"), tables.table(spark, sf_dir, "customer")
    calls = suppliers.select(
        F.lit("claude").alias("agent"), nation("s_nationkey").alias("node_id"), (F.col("s_suppkey") * 2).cast("bigint").alias("seq"),
        F.when(F.col("s_suppkey") % 4 == 0, None).when(F.col("s_suppkey") % 4 == 1, F.array(F.lit("none"))).otherwise(F.array(F.lit("none"), segment)).alias("names"),
    )
    named = customers.groupBy(nation("c_nationkey").alias("node_id")).agg(F.min("c_custkey").alias("low"), F.min(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey"))).alias("third"))
    results = suppliers.where("s_suppkey % 3 = 1 OR s_suppkey % 4 = 0").select(
        F.lit("claude").alias("agent"), nation("s_nationkey").alias("node_id"), (F.col("s_suppkey") * 2 + 61).cast("bigint").alias("seq"),
        (F.col("s_suppkey") * 2).cast("bigint").alias("call"), (F.col("s_suppkey") % 4 == 0).alias("of_group"),
    ).join(named, "node_id").withColumn("name", F.concat(F.lit("c"), F.when(F.col("of_group"), F.col("third")).otherwise(F.col("low"))))
    children = customers.select(
        F.lit("claude").alias("agent"), nation("c_nationkey").alias("node_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("child"),
        F.concat(F.lit("c"), F.col("c_custkey")).alias("session_id"), F.col("c_mktsegment").alias("title"), (F.col("c_custkey") % 3 == 0).alias("is_group"), F.col("c_name").alias("at"),
    )
    return graph.link_spawn(calls, results, children).select("node_id", (F.col("seq") / 2).cast("bigint").alias("s_suppkey"), "child")


@query
def classify_path(spark, sf_dir):
    """Parts as transcript files of every role."""
    return scan.classify_path(_part_files(spark, sf_dir)).select("path", "role", "parent_path", "group_dir")


@query
def unreadable_scope(spark, sf_dir):
    """Transcripts a scoped search would refuse, where every seventh part file cannot be read."""
    files = _part_files(spark, sf_dir)
    starts = files.where(~F.contains("path", F.lit("agent-"))).select("agent", "path", F.col("path").alias("node_id"), F.col("path").alias("start_id"))
    number = F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long")
    lost = files.select("agent", "path", F.when(number % 7 == 0, "unreadable_session").otherwise("malformed_line").alias("code"))
    return search.unreadable_below(starts, lost).select("path", "failed")


@query
def affected_roots(spark, sf_dir):
    return manifest.affected_roots(_part_files(spark, sf_dir)).select("path", "root_path")


def _part_files(spark, sf_dir):
    key = F.col("p_partkey")
    owner = F.concat(F.lit("/lake/p"), (key - key % 5).cast("string"))
    number = key.cast("string")
    path = (
        F.when(key % 5 == 0, F.concat(owner, F.lit(".jsonl")))
        .when(key % 5 == 1, F.concat(owner, F.lit("/subagents/x"), number, F.lit(".jsonl")))
        .when(key % 5 == 2, F.concat(owner, F.lit("/subagents/flow/w1/agent-"), number, F.lit(".jsonl")))
        .when(key % 5 == 3, F.concat(owner, F.lit("/subagents/flow/w1/journal-"), number, F.lit(".jsonl")))
        .otherwise(F.concat(F.lit("/lake/agent-"), number, F.lit(".jsonl")))
    )
    return tables.table(spark, sf_dir, "part").select(F.lit("claude").alias("agent"), path.alias("path"))


@query
def token_totals(spark, sf_dir):
    """Token columns of both counting rules."""
    requests = tables.event_requests(spark, sf_dir).withColumn("includes_cache_read", F.col("byte_offset") % 2 == 0)
    return requests.select(
        F.col("byte_offset").alias("event_id"), tokens.uncached_input(F.col).alias("uncached_input"), tokens.total_tokens(F.col).alias("total"),
        tokens.flow_tokens(F.col).alias("flow"), tokens.context_tokens(F.col).alias("context"),
    )


# --- ordered operators -------------------------------------------------------------------------


def _day_block():
    """Blocks of the events table in time order."""
    return F.floor(F.col("seq") / 86_400_000_000)


def _event_rows(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), "event_type", tables.event_number().alias("k"),
        F.round(F.col("value") * 1000).cast("bigint").alias("tokens"),
    )


@query
def pair_tool_result(spark, sf_dir):
    """Every purchase with the latest earlier click of the same user and parity of k."""
    rows = _event_rows(spark, sf_dir).withColumn("call_id", F.col("k") % 2)
    paired = timeline.pair_tool_result(
        rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), ["user_id", "call_id"], ["event_id", "tokens"], _day_block()
    )
    return paired.select("event_id", F.col("call.event_id").alias("click_id"), F.col("call.tokens").alias("click_tokens"))


@query
def prompt_context(spark, sf_dir):
    rows = _event_rows(spark, sf_dir).select(
        "user_id", "event_id", "seq", (F.col("event_type") == "view").alias("is_prompt"),
        F.when(F.col("event_type").isin("click", "purchase"), F.col("tokens")).alias("request_context"),
    )
    found = timeline.prompt_context(rows, ["user_id"], _day_block())
    return found.where("is_prompt").select("event_id", "context")


@query
def request_target(spark, sf_dir):
    rows = _event_rows(spark, sf_dir).select(
        "user_id", "seq", (F.col("event_type") == "signup").alias("is_token"), F.col("event_type").isin("click", "purchase").alias("is_eligible")
    )
    return timeline.request_target(rows, ["user_id"], _day_block()).select("user_id", "seq", "target")


@query
def event_index(spark, sf_dir):
    rows = _event_rows(spark, sf_dir).withColumns({"agent": F.lit("claude"), "node_id": F.col("user_id")})
    return timeline.event_index(rows, _day_block()).select("event_id", "event_index")


@query
def mirror_dedup(spark, sf_dir):
    """Replies and prompts repeat within sixteen kept rows; signups are token records."""
    kind = F.col("event_type")
    rows = _event_rows(spark, sf_dir).select(
        "user_id", "seq",
        F.when(kind == "signup", "token").when(kind.isin("click", "purchase"), "target").otherwise("other").alias("role"),
        F.when(kind.isin("click", "view"), F.concat_ws("-", kind, (F.col("k") % 9).cast("string"))).otherwise("").alias("key"),
        (F.col("k") % 2 == 0).alias("billed"),
    )
    week = F.floor(F.col("seq") / (7 * 86_400_000_000))
    return timeline.mirror_dedup(rows, ["user_id"], week).select("user_id", "seq", "slot")


@query
def replay_prefix(spark, sf_dir):
    """Users whose first two deltas fall on one day replay that day."""
    rows = tables.table(spark, sf_dir, "events")
    path = F.col("user_id").cast("string")
    counters = lambda value: F.struct(*[value.alias(name) for name in codex.TOKEN_FIELDS])
    k = tables.event_number()
    tokens = rows.select(
        F.lit("codex").alias("agent"), path.alias("path"), F.col("event_id").alias("byte_offset"), F.date_format("ts", "yyyy-MM-dd").alias("second"),
        F.when(k % 4 != 0, counters(F.col("event_id"))).alias("total"), F.when(F.col("event_type") == "click", counters(k)).alias("delta"),
    )
    forks = tokens.select("agent", "path").distinct().withColumns(
        {"thread_source": F.lit("subagent"), "forked_from_id": F.lit("")}
    )
    found = codex.replay_prefix(tokens, forks)
    return found.select(F.col("path").alias("user_id"), "replay_second", "replay_end", F.col("baseline.input_tokens").alias("baseline"))


# --- whole transcripts derived from the tables ---------------------------------------------------


def _transcripts(spark, sf_dir):
    """Records over lines that are written out once, as transcripts are."""
    return claude.claude_records(stage(tables.event_transcripts(spark, sf_dir), "transcripts"))


def _transcript_lines(spark, sf_dir):
    return stage(claude.claude_lines(_transcripts(spark, sf_dir)), "claude-lines")


@query
def transcript_ledger(spark, sf_dir):
    """Lines of the first format parsed, deduplicated and priced."""
    requests = ledger.dedup_requests(claude.claude_requests(_transcript_lines(spark, sf_dir)))
    priced = pricing.price_requests(requests, tables.event_pricing(spark))
    return priced.select(
        F.regexp_extract("node_id", r"(\d+)\.jsonl$", 1).alias("user_id"), "message_id", "request_id",
        (F.col("byte_offset") / tables.LINE_STRIDE).cast("bigint").alias("event_id"), "input", "output", "write_5m", "write_1h", "cache_read", usd("usd"),
    )


@query
def transcript_summary(spark, sf_dir):
    return claude.claude_summaries(_transcript_lines(spark, sf_dir)).select(
        "session_id", "title", "project", "messages", "has_error", "started_raw", "updated_raw"
    )


@query
def transcript_models(spark, sf_dir):
    """Billed models of every file in first-seen order."""
    requests = ledger.dedup_requests(claude.claude_requests(_transcript_lines(spark, sf_dir)))
    models = distinct_models(requests, ["agent", "node_id"], F.col("ledger_at"))
    return models.select(F.regexp_extract("node_id", r"(\d+)\.jsonl$", 1).alias("user_id"), F.array_join("models", ",").alias("models"))


@query
def transcript_events(spark, sf_dir):
    """Timelines of the first format: blocks, paired results, head usage and index."""
    records = _transcripts(spark, sf_dir)
    lines = stage(claude.claude_lines(records), "claude-lines")
    events = timeline.event_index(stage(timeline.claude_events(records, lines), "events"))
    return events.select(
        F.regexp_extract("node_id", r"(\d+)\.jsonl$", 1).alias("user_id"), "event_index", "kind", "text", "tool_input", "summary", "duration_ms",
        F.col("usage.input").alias("usage_input"), F.col("usage.output").alias("usage_output"),
    )


def _talk(spark, sf_dir):
    records = claude.claude_records(stage(tables.talk_transcripts(spark, sf_dir), "talk"))
    return records, stage(claude.claude_lines(records), "talk-lines")


@query
def talk_events(spark, sf_dir):
    """Timelines with edits, block results, injected prompts and advisors: details, flags and advisor usage."""
    events = timeline.event_index(stage(timeline.claude_events(*_talk(spark, sf_dir)), "talk-events"))
    return events.select(
        F.regexp_extract("node_id", r"(\d+)\.jsonl$", 1).cast("long").alias("conv_id"), "event_index", "kind", "text", "tool_input", "detail_input", "detail_diff", "detail_output",
        "harness", "model", F.col("usage.input").alias("usage_input"),
    )


@query
def talk_requests(spark, sf_dir):
    """Billed requests of advised replies: the reply's own and one for each advisor step."""
    requests = ledger.dedup_requests(claude.claude_requests(_talk(spark, sf_dir)[1]))
    return requests.select(
        F.regexp_extract("node_id", r"(\d+)\.jsonl$", 1).cast("long").alias("conv_id"), F.replace("message_id", F.lit("\0"), F.lit("/")).alias("message_id"), "model", "input", "output",
    )


@query
def scan_records(spark, sf_dir):
    """Documents written as transcript files, found, scanned by byte ranges, and each line read again by its range."""
    folder = f"{shared_folder(spark)}/scan-records/{uuid.uuid4().hex}"
    line = F.to_json(F.struct(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.repeat(F.lit("é"), (F.col("doc_id") % 50).cast("int")).alias("pad")))
    tables.write_lines(tables.table(spark, sf_dir, "documents").select(line.alias("line")), folder)
    raw = stage(scan.scan_jsonl(spark, {"claude": folder}, split_bytes=10_000), "scanned")
    good, _ = scan.skip_malformed(raw)
    events = good.select(
        F.lit("claude").alias("agent"), F.col("path").alias("node_id"), F.get_json_object("line", "$.id").cast("long").alias("event_index"), "path", "byte_offset", "byte_length",
        F.sha2("line", 256).alias("digest"))
    read = sessions.read_record(events)
    return read.select(F.col("event_index").alias("doc_id"), "byte_length", "status", F.get_json_object("raw_json", "$.digest").alias("digest"))


@query
def wire_rows(spark, sf_dir):
    """Conversation turns sunk as versioned JSON rows and read again; arrays and required fields are never absent."""
    folder = f"{shared_folder(spark)}/wire-rows/{uuid.uuid4().hex}"
    turns = tables.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.array("role")).alias("tags"), F.when(F.col("turn") % 3 == 0, F.col("role")).alias("maybe"))
    sessions.sink_json(turns, folder, "list")
    return spark.read.text(folder).select(F.md5("value").alias("digest"), F.get_json_object("value", "$.conv_id").cast("long").alias("conv_id"), F.get_json_object("value", "$.turn").cast("long").alias("turn"))


@query
def reattribute(spark, sf_dir):
    """Owners of the requests of the events table, told by a stream over it."""
    from sessionlake.streaming import ownership

    folder = f"{shared_folder(spark)}/reattribute/{uuid.uuid4().hex}"
    starts = tables.event_sessions(spark, sf_dir).select("node_id", "started_at")
    requests = tables.event_requests(spark, sf_dir).select("agent", "node_id", "message_id", "request_id").distinct().join(starts, "node_id")
    given = requests.select("agent", "message_id", "request_id", F.col("node_id").alias("session_id"), F.concat(F.lit("/lake/"), "node_id").alias("path"), F.col("started_at").cast("timestamp").alias("started_at"))
    given.write.parquet(f"{folder}/requests")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ownership.STATE_STORE)
    try:
        stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1_000).parquet(f"{folder}/requests")
        told = ownership.reattribute(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
        told.foreachBatch(lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/told")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = spark.read.parquet(f"{folder}/told")
    last = rows.groupBy("message_id", "request_id", "session_id").agg(F.max_by(F.struct("is_duplicate", "owner_path"), "batch").alias("last"))
    return last.select("message_id", "request_id", "session_id", "last.is_duplicate", F.substring_index("last.owner_path", "/", -1).alias("owner"))


def _rollouts(spark, sf_dir):
    records = stage(codex.codex_records(stage(tables.event_rollouts(spark, sf_dir), "rollouts")), "records")  # parsed once, read often
    meta = codex.file_meta(records)
    return records, meta, codex.line_state(records, meta)


@query
def rollout_ledger(spark, sf_dir):
    """Deltas against cumulative totals: clean partitions, remaining totals, and per-model sums."""
    _, _, state = _rollouts(spark, sf_dir)
    return codex.codex_ledger(state).select(
        F.regexp_extract("node_id", r"(\d+)\.jsonl$", 1).alias("user_id"), "is_aggregate", "model", "input", "cache_read", "output"
    )


@query
def both_ledgers(spark, sf_dir):
    """Requests of both formats as one ledger: how many each session of each agent has, and their tokens."""
    first = ledger.dedup_requests(claude.claude_requests(_transcript_lines(spark, sf_dir)))
    second = codex.codex_ledger(_rollouts(spark, sf_dir)[2])
    shared = ["agent", "node_id", "input", "output"]
    both = first.select(*shared).unionByName(second.select(*shared))
    return both.groupBy("agent", F.regexp_extract("node_id", r"(\d+)\.jsonl$", 1).alias("user_id")).agg(
        F.count("*").alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"))


@query
def current_model(spark, sf_dir):
    """Model in force at every token record, by the accounting and the timeline rule."""
    _, _, state = _rollouts(spark, sf_dir)
    return state.where(codex.is_token_count()).select(
        (F.col("byte_offset") / tables.LINE_STRIDE - 1).cast("bigint").alias("event_id"), "model", "line_model", "advances"
    )


@query
def rollout_events(spark, sf_dir):
    """Timelines of the second format: kinds, usage targets, explicit usage rows and index."""
    records, meta, state = _rollouts(spark, sf_dir)
    summaries = stage(codex.codex_summaries(records, state, meta), "summaries")
    requests = codex.codex_ledger(state).select(
        "agent", "node_id", "byte_offset", "is_aggregate", F.struct(*USAGE_FIELDS).alias("usage_struct")
    )
    events = timeline.event_index(stage(timeline.codex_events(records, state, meta, requests, summaries), "events"))
    return events.select(
        F.regexp_extract("node_id", r"(\d+)\.jsonl$", 1).alias("user_id"), "event_index", "kind", "text", "usage_aggregate", F.col("usage.input").alias("usage_input"),
    )


@query
def skip_malformed(spark, sf_dir):
    """Document lines, every third cut short: the diagnostics of the unreadable ones."""
    line = F.to_json(F.struct(F.col("lang").alias("type"), F.col("text")))
    raw = tables.table(spark, sf_dir, "documents").select(
        F.lit("claude").alias("agent"), F.lit("/lake/d.jsonl").alias("path"), F.col("doc_id").alias("byte_offset"),
        F.when(F.col("doc_id") % 3 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"),
    )
    _, bad = scan.skip_malformed(raw)
    return bad.select(F.col("byte_offset").alias("doc_id"), "code")


@query
def manifest_diff(spark, sf_dir):
    """Two file manifests over the parts: created, changed and removed files."""
    part = tables.table(spark, sf_dir, "part")
    path = F.concat(F.lit("/lake/p"), F.col("p_partkey"), F.lit(".jsonl"))
    rows = part.select(F.lit("claude").alias("agent"), path.alias("path"), F.col("p_size").cast("bigint").alias("size_bytes"), F.lit(0).cast("timestamp").alias("modified_at"), "p_partkey")
    old = manifest.file_manifest(rows.where("p_partkey % 7 <> 0"), "v1")
    grown = F.when(F.col("p_partkey") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    new = manifest.file_manifest(rows.where("p_partkey % 11 <> 0").withColumn("size_bytes", grown), "v1")
    return manifest.diff_manifest(new, old).select("path", "change")


@query
def removed_sessions(spark, sf_dir):
    """Users of any event who have no purchase above 150."""
    events = tables.table(spark, sf_dir, "events")
    old = events.select(F.col("user_id").alias("node_id")).distinct()
    new = events.where("event_type = 'purchase' AND value > 150").select(F.col("user_id").alias("node_id")).distinct()
    return manifest.removed_sessions(old, new, ["node_id"])


@query
def usage_per_window(spark, sf_dir):
    """Tokens per day and model (an extension; event-time windows)."""
    rows = tables.table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.round(F.col("value") * 1000).cast("bigint").alias("input"), tables.event_number().alias("output"),
    )
    return windows.usage_per_window(rows, "1 day").select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "model", "requests", "input", "output"
    )


# --- search ------------------------------------------------------------------------------------


def _search(spark, sf_dir, pattern, **options):
    nodes = tables.conversation_nodes(spark, sf_dir)
    none = nodes.select("agent", F.col("node_id").alias("ancestor"), F.col("node_id").alias("descendant")).where("false")
    hits = search.search_hits(nodes, tables.conversation_events(spark, sf_dir), none, pattern, **options)
    return hits.select("ref", "event_index", "kind", "field", "range_start", "range_end", "matches", "snippet")


@query
def search_literal(spark, sf_dir):
    """Case-insensitive literal over all turns, with ranges, counts and snippets."""
    return _search(spark, sf_dir, "the", around=20)


@query
def search_literal_cs(spark, sf_dir):
    return _search(spark, sf_dir, "The", case_sensitive=True, around=10, kinds=["user", "tool-call"])


@query
def search_regex(spark, sf_dir):
    return _search(spark, sf_dir, "[a-z]+ing|err?", regex=True, around=12, project="project-2")


@query
def search_page(spark, sf_dir):
    """Second page of ordered hits."""
    nodes = tables.conversation_nodes(spark, sf_dir)
    none = nodes.select("agent", F.col("node_id").alias("ancestor"), F.col("node_id").alias("descendant")).where("false")
    hits = search.search_hits(nodes, tables.conversation_events(spark, sf_dir), none, "on", around=5)
    return sessions.page(hits, search.search_order(), 15, 10).select("ref", "event_index", "field", "range_start", "matches")


@query
def search_counts(spark, sf_dir):
    nodes = tables.conversation_nodes(spark, sf_dir)
    none = nodes.select("agent", F.col("node_id").alias("ancestor"), F.col("node_id").alias("descendant")).where("false")
    hits = search.search_hits(nodes, tables.conversation_events(spark, sf_dir), none, "would")
    return search.search_counts(nodes, hits)


@query
def search_documents(spark, sf_dir):
    """Regex search over whole documents."""
    matcher = compile_matcher(r"\b[a-z]{3}ing\b", regex=True)
    rows = tables.document_texts(spark, sf_dir).where(matcher.hits(F.col("text")))
    start, end = matcher.span(F.col("text"))
    return rows.select("doc_id", start.alias("range_start"), end.alias("range_end"), matcher.count(F.col("text")).alias("matches"))


@query
def byte_budget_page(spark, sf_dir):
    """Leading turns whose texts fit one response budget."""
    rows = tables.table(spark, sf_dir, "conversations")
    size = F.octet_length("text")
    kept = sessions.byte_budget_page(rows, [F.col("conv_id"), F.col("turn")], budget=60_000, size=size)
    return kept.select("conv_id", "turn")


@query
def event_rows(spark, sf_dir):
    """Searchable projection and bounded texts of every turn."""
    shown = sessions.event_text(tables.conversation_events(spark, sf_dir))
    return shown.select(
        "node_id", "event_index", text.bounded_text(F.col("shown_text"), 60).alias("text"), text.bounded_text(F.col("shown_input"), 60).alias("input"),
        text.is_cut(F.col("shown_text"), 60).alias("cut"),
    )


@query
def token_scan(spark, sf_dir):
    """Documents and pages that contain three words in a row of the benchmark texts."""
    names = tables.table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+ [A-Za-z]+ [A-Za-z]+"), F.lit(0))).alias("name")
    )
    texts = tables.document_texts(spark, sf_dir).select(F.concat(F.lit("document "), "doc_id").alias("text_id"), "text")
    pages = tables.table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), "page_id").alias("text_id"), F.col("html").alias("text"))
    texts = texts.unionByName(pages)
    return search.token_scan(texts, search.scan_tokens(names))


# --- texts -------------------------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    """Documents wrapped in harness tags, cleaned."""
    noisy = F.concat(
        F.lit("<system-reminder>be kind\n</system-reminder>\n"), F.replace("text", F.lit(". "), F.lit(".  \n\n\n")),
        F.when(F.col("doc_id") % 2 == 0, F.lit("\nwarmup\nx <permission-preamble> tail")).otherwise(F.lit("\n<local-command-caveat>c</local-command-caveat>")),
    )
    return tables.document_texts(spark, sf_dir).select("doc_id", F.md5(text.clean_timeline_text(noisy)).alias("digest"))


@query
def clean_title(spark, sf_dir):
    marked = F.concat(F.lit("\n  ## <b>"), F.col("text"))
    return tables.document_texts(spark, sf_dir).select("doc_id", text.clean_title(marked).alias("title"))


@query
def elide_encrypted(spark, sf_dir):
    """Every document carries a token of its own length between its words."""
    size = (F.col("doc_id") % 90).cast("int")
    token = F.concat(F.lit("gAAAA"), F.repeat(F.lit("xY"), size), F.lit("=="))
    laced = F.concat(F.replace("text", F.lit(" the "), F.concat(F.lit(" "), token, F.lit(" "))), F.lit(" x"), token, F.lit(" "), token)
    return tables.document_texts(spark, sf_dir).select("doc_id", F.md5(text.elide_encrypted(laced)).alias("digest"))


@query
def bounded_text(spark, sf_dir):
    return tables.document_texts(spark, sf_dir).select(
        "doc_id", text.bounded_text(F.col("text"), 101).alias("bounded"), text.is_cut(F.col("text"), 101).alias("cut")
    )


@query
def terminal_safe(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", F.md5(text.terminal_safe(F.col("html"))).alias("digest"))


@query
def basename(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("name"))


@query
def short_model(spark, sf_dir):
    name = F.concat(F.lit("claude-"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.when(F.col("p_size") % 2 == 0, "-4-8").otherwise("-sol"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", text.short_model(name).alias("model"))


@query
def prompt_texts(spark, sf_dir):
    """Documents behind preambles: the remaining task and its title."""
    doc = F.col("doc_id") % 4
    wrapped = (
        F.when(doc == 0, F.concat(F.lit("<instructions>be brief</instructions>\n# AGENTS.md instructions for /work\n"), "text"))
        .when(doc == 1, F.concat(F.lit("You are an autonomous implementation agent.\nrules\n---\n# Task\n## Brief - "), "text"))
        .when(doc == 2, F.concat(F.lit("<environment_context>\n"), "text"))
        .otherwise(F.concat(F.lit("Requirements\n\n"), "text"))
    )
    return tables.document_texts(spark, sf_dir).select(
        "doc_id", F.md5(text.prompt_task_text(wrapped)).alias("task_digest"), text.task_title(wrapped).alias("title")
    )


@query
def patch_counts(spark, sf_dir):
    """Parts as patches: files touched and lines added and removed."""
    patch = F.concat(
        F.lit("*** Begin Patch\n*** Update File: src/"), F.col("p_brand"), F.lit(".py\n+++ b\n"), F.repeat(F.lit("+x\n"), F.col("p_size")),
        F.lit("--- a\n"), F.repeat(F.lit("-y\n"), (F.col("p_partkey") % 9).cast("int")), F.lit("*** Add File: lib/"), F.col("p_type"), F.lit("\n*** Delete File: "), F.col("p_brand"), F.lit(".py\n"),
    )
    added, removed = text.patch_line_counts(patch)
    return tables.table(spark, sf_dir, "part").select(
        "p_partkey", added.alias("added"), removed.alias("removed"), F.array_join(text.patch_files(patch), ",").alias("files")
    )


@query
def nested_tool(spark, sf_dir):
    """Parts as wrapper scripts: calls outside strings and comments."""
    script = F.concat(
        F.lit("const a = 'tools.hidden(1)'; // tools.note(2)\nawait tools."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("({x: 1});"),
        F.when(F.col("p_size") % 3 == 0, F.lit("/* tools.c(3) */ await tools.second(`tools.q(`)")).otherwise(F.lit("")),
    )
    calls = text.nested_tools(script)
    return tables.table(spark, sf_dir, "part").select("p_partkey", F.size(calls).alias("calls"), F.when(F.size(calls) == 1, calls[0]).alias("tool"))


@query
def result_summary(spark, sf_dir):
    """Order remarks as shell results: header split, exit code and summary."""
    output = F.when(
        F.col("o_orderkey") % 3 == 0,
        F.concat(F.lit("Process exited with code "), (F.col("o_orderkey") % 5).cast("string"), F.lit("\nWall time 1.5 seconds\nOutput:\n"), F.col("o_orderpriority")),
    ).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Script completed\nWall time 2 seconds\nFinal output:\n\n "), F.col("o_orderstatus"))).otherwise(F.col("o_orderpriority"))
    body, code = text.split_exec_preamble(output)
    return tables.table(spark, sf_dir, "orders").select(
        "o_orderkey", body.alias("body"), code.alias("code"), text.exit_summary(output, "Process exited with code ").alias("summary")
    )
