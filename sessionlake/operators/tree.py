"""Session graphs: closure, rollup, references, pre-order, addressability and selectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import refs
from sessionlake.functions.tokens import sat_add, sat_sum, total_tokens, uncached_input
from sessionlake.plans.staging import stage

# Fixed value.
SELECTOR_PREFIX = 6

TOTALS = ["uncached_input", "output", "cache_write", "cache_read", "total"]


def closure(edges: DataFrame) -> DataFrame:
    """All ``(agent, ancestor, descendant, depth)`` pairs of the forest, depth at least 1, however deep.

    Reach doubles per round: paths up to length n join with paths of length n. A tree of depth d
    takes about log2(d) joins, and every round is a staged table. A node that is its own ancestor marks a
    cycle; from then on only pairs not known before count, with their shortest path, so the rounds end.
    """
    base = edges.select(
        "agent", F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth")
    ).where("ancestor <> descendant")
    known = stage(base, "closure")
    reach, cyclic = 1, False
    while True:
        # Every path longer than `reach` splits into a head of exactly `reach` and a shorter tail.
        head = known.where(F.col("depth") == reach).select("agent", "ancestor", F.col("descendant").alias("via"))
        tail = known.select("agent", F.col("ancestor").alias("via"), "descendant", F.col("depth").alias("rest"))
        longer = (
            head.join(tail, ["agent", "via"])
            .select("agent", "ancestor", "descendant", (F.col("rest") + reach).alias("depth"))
        )
        longer = stage(longer, "closure")
        cyclic = cyclic or not longer.where("ancestor = descendant").isEmpty()
        if cyclic:
            new = longer.where("ancestor <> descendant").join(known, ["agent", "ancestor", "descendant"], "left_anti")
            longer = stage(new.groupBy("agent", "ancestor", "descendant").agg(F.min("depth").alias("depth")), "closure")
        if longer.isEmpty():
            return known
        known = known.unionByName(longer)
        reach *= 2


def with_self(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The closure plus every node as its own ancestor at depth 0."""
    own = nodes.select("agent", F.col("node_id").alias("ancestor"), F.col("node_id").alias("descendant"), F.lit(0).alias("depth"))
    return pairs.select(*own.columns).unionByName(own)


def roots_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are nobody's child; a linked child is never listed as a root."""
    return nodes.join(edges.select("agent", F.col("child").alias("node_id")), ["agent", "node_id"], "left_anti")


def node_totals(priced: DataFrame, attributed: DataFrame | None = None) -> DataFrame:
    """Own tokens and cost of every node; with ``attributed`` the replayed part is taken off."""
    gross = priced.groupBy("agent", "node_id").agg(
        sat_sum(uncached_input(F.col)).alias("uncached_input"),
        sat_sum(F.col("output")).alias("output"),
        sat_sum(sat_add(F.col("write_5m"), F.col("write_1h"))).alias("cache_write"),
        sat_sum(F.col("cache_read")).alias("cache_read"),
        sat_sum(total_tokens(F.col)).alias("total"),
        F.sum("usd").alias("gross_usd"),
        F.bool_or("estimated").alias("estimated"),
        F.array_sort(F.collect_set(F.when(F.col("missing"), F.col("model")))).alias("missing_pricing"),
        F.array_sort(
            F.collect_set(F.when(F.col("estimated") & ~F.col("missing"), F.struct("model", "pricing_model")))
        ).alias("estimated_rates"),
    )
    if attributed is None:
        return gross.withColumn("usd", F.col("gross_usd"))
    replayed = attributed.where("is_duplicate").groupBy("agent", "node_id").agg(
        *[sat_sum(value).alias(f"__{name}") for name, value in {
            "uncached_input": uncached_input(F.col),
            "output": F.col("output"),
            "cache_write": sat_add(F.col("write_5m"), F.col("write_1h")),
            "cache_read": F.col("cache_read"),
            "total": total_tokens(F.col),
        }.items()],
        F.sum("usd").alias("replayed_usd"),
        F.count("*").alias("replayed_requests"),
    )
    joined = gross.join(replayed, ["agent", "node_id"], "left")
    owned = {name: F.col(name) - F.coalesce(F.col(f"__{name}"), F.lit(0)) for name in TOTALS}
    owned["usd"] = F.col("gross_usd") - F.coalesce("replayed_usd", F.lit(0.0))
    return joined.withColumns(owned).drop(*[f"__{name}" for name in TOTALS])


class CyclicTree(ValueError):
    """A node is its own ancestor, so it has no subtree to add up."""


def subtree(own: DataFrame, edges: DataFrame, combine: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``own`` (agent, node_id and the columns of ``combine``) added up over every node and all below it.

    What lies fewer than 2 ** k steps below a node is known in round k; the next round adds what the nodes exactly
    2 ** k steps below know, at their ancestor. A round is one aggregate by node and its jumps are one join, each as large as
    the tree, so a chain of any length costs the logarithm of its length. Rows of ``own`` that share a key are combined; columns
    beside ``combine`` belong to the key.
    """
    key = [name for name in own.columns if name not in combine]
    merge = lambda rows: rows.groupBy(*key).agg(*[function(F.col(name)).alias(name) for name, function in combine.items()]) if combine else rows.select(*key).distinct()
    jumps = stage(edges.select("agent", F.col("child").alias("node_id"), F.col("parent").alias("up")).where("node_id <> up").distinct(), "jumps")
    known, most, rounds = stage(merge(own), "subtree"), jumps.count(), 0
    while not jumps.isEmpty():
        if 1 << rounds > most:
            raise CyclicTree("some node is its own ancestor")
        risen = known.join(jumps, ["agent", "node_id"]).drop("node_id").withColumnRenamed("up", "node_id")
        known = stage(merge(known.unionByName(risen.select(*known.columns))), "subtree")
        further = jumps.select("agent", F.col("node_id").alias("up"), F.col("up").alias("__up"))
        jumps = stage(jumps.join(further, ["agent", "up"]).select("agent", "node_id", F.col("__up").alias("up")), "jumps")
        rounds += 1
    return known


def _below(own: DataFrame, edges: DataFrame, combine: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``own`` added up over all nodes below each node, the node itself left out.

    Where links form a cycle (broken transcripts) the pairs of the closure say once what is below what.
    """
    up = edges.select("agent", F.col("child").alias("node_id"), "parent").where("node_id <> parent").distinct()
    key = [name for name in own.columns if name not in combine]
    try:
        added = subtree(own, edges, combine)
    except CyclicTree:
        added, up = own, closure(edges).select("agent", F.col("descendant").alias("node_id"), F.col("ancestor").alias("parent"))
    risen = added.join(up, ["agent", "node_id"]).drop("node_id").withColumnRenamed("parent", "node_id")
    return risen.groupBy(*key).agg(*[function(F.col(name)).alias(name) for name, function in combine.items()]) if combine else risen.select(*key).distinct()


def rollup(nodes: DataFrame, totals: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``self_*``, ``desc_*`` and ``total_*`` tokens and cost over their subtree.

    Also ``subagents`` (group containers excluded) and ``updated_at`` as the subtree's latest.
    """
    numeric = [*TOTALS, "usd", "gross_usd"]
    measured = nodes.select("agent", "node_id", "is_group", F.struct("updated_at", "updated_raw").alias("desc_updated")).join(
        totals, ["agent", "node_id"], "left"
    )
    own = measured.select(
        "agent", "node_id", *[F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(f"desc_{name}") for name in TOTALS],
        *[F.coalesce(F.col(name), F.lit(0.0)).alias(f"desc_{name}") for name in ("usd", "gross_usd")],
        F.coalesce("estimated", F.lit(False)).alias("desc_estimated"), F.when(F.col("is_group"), 0).otherwise(1).cast("bigint").alias("subagents"), "desc_updated",
    )
    combine = {f"desc_{name}": sat_sum for name in TOTALS} | {"desc_usd": F.sum, "desc_gross_usd": F.sum, "desc_estimated": F.bool_or, "subagents": F.sum, "desc_updated": F.max}
    below = _below(own, edges, combine)
    # One row per distinct element, so no reducer holds a set of sets.
    missing = totals.select("agent", "node_id", F.explode("missing_pricing").alias("model")).withColumns({"pricing_model": F.lit(None).cast("string"), "priced": F.lit(False)})
    rates = totals.select("agent", "node_id", F.explode("estimated_rates").alias("rate")).select("agent", "node_id", "rate.model", "rate.pricing_model", F.lit(True).alias("priced"))
    elements = stage(missing.unionByName(rates), "tree-elements")
    if not elements.isEmpty():
        sets = _below(elements, edges, {}).groupBy("agent", "node_id").agg(
            F.collect_list(F.when(~F.col("priced"), F.col("model"))).alias("desc_missing"),
            F.collect_list(F.when(F.col("priced"), F.struct("model", "pricing_model"))).alias("desc_rates"))
    else:
        sets = nodes.select("agent", "node_id", F.array().cast("array<string>").alias("desc_missing"), F.array().cast("array<struct<model:string,pricing_model:string>>").alias("desc_rates"))
    below = below.join(sets, ["agent", "node_id"], "left")
    out = nodes.join(totals, ["agent", "node_id"], "left").join(below, ["agent", "node_id"], "left")
    zero = {name: F.lit(0).cast("bigint") for name in TOTALS} | {"usd": F.lit(0.0), "gross_usd": F.lit(0.0)}
    sums = {}
    for name in numeric:
        own = F.coalesce(F.col(name), zero[name])
        desc = F.coalesce(F.col(f"desc_{name}"), zero[name])
        sums |= {f"self_{name}": own, f"desc_{name}": desc, f"total_{name}": sat_add(own, desc) if name in TOTALS else own + desc}
    out = out.withColumns(sums).drop(*numeric)
    none = F.array().cast("array<string>")
    no_rates = F.array().cast("array<struct<model:string,pricing_model:string>>")
    own_missing = F.coalesce(F.col("missing_pricing"), none)
    own_estimated = F.coalesce(F.col("estimated"), F.lit(False))
    latest = F.greatest(
        F.struct("updated_at", "updated_raw"), F.coalesce("desc_updated", F.struct("updated_at", "updated_raw"))
    )
    return (
        out.withColumn("latest", latest)
        .withColumns(
            {
                "subagents": F.coalesce("subagents", F.lit(0)),
                "self_missing": own_missing,
                "desc_missing": F.array_sort(F.coalesce("desc_missing", none)),
                "total_missing": F.array_sort(F.array_union(own_missing, F.coalesce("desc_missing", none))),
                "total_rates": F.array_sort(
                    F.array_union(F.coalesce("estimated_rates", no_rates), F.coalesce("desc_rates", no_rates))
                ),
                "self_estimated": own_estimated,
                "desc_estimated": F.coalesce("desc_estimated", F.lit(False)),
                "total_estimated": own_estimated | F.coalesce("desc_estimated", F.lit(False)),
                "updated_at": F.col("latest.updated_at"),
                "updated_raw": F.col("latest.updated_raw"),
            }
        )
        .drop("latest", "desc_updated", "missing_pricing", "estimated", "estimated_rates", "desc_rates")
    )


def preorder(nodes: DataFrame, pairs: DataFrame, key: Column | None = None) -> DataFrame:
    """Add ``depth``, ``root_id`` and ``sort_path``; ordering by them lists each tree in pre-order.

    The path holds one sort key per ancestor and needs no window over siblings.
    """
    if key is None:
        key = F.struct(F.col("started_at").isNull().alias("late"), "started_at", "session_id", "node_id")
    keyed = nodes.withColumn("__key", key)
    chains = (
        with_self(nodes, pairs)
        .join(keyed.select("agent", F.col("node_id").alias("ancestor"), "__key"), ["agent", "ancestor"])
        .groupBy("agent", F.col("descendant").alias("node_id"))
        .agg(
            F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("up"), F.col("__key").alias("key"), "ancestor"))).alias("chain")
        )
    )
    return nodes.join(chains, ["agent", "node_id"]).select(
        *nodes.columns,
        (F.size("chain") - 1).alias("depth"),
        F.col("chain")[0]["ancestor"].alias("root_id"),
        F.transform("chain", lambda link: link["key"]).alias("sort_path"),
    )


def with_refs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``root_id``, ``depth``, ``ref_path`` and the canonical ``ref`` of every node.

    An agent path or a ``#`` suffix addresses a node from its root; any other node appends its
    escaped id to the parent's path.
    """
    agent_path = F.regexp_replace(F.regexp_replace("agent_path", "^/+|/+$", ""), "^root/", "")
    suffix = F.regexp_replace(F.when(F.instr("path", "#") > 0, F.regexp_replace("path", "^[^#]*#", "")), "^/+|/+$", "")
    stem = F.regexp_replace(F.regexp_replace(F.substring_index("path", "/", -1), "^agent-", ""), r"\.[^.]*$", "")
    absolute = F.when(F.col("agent_path") != "", agent_path)
    absolute = F.coalesce(F.when(absolute != "", absolute), F.when(suffix != "", suffix))
    segment = F.coalesce(
        refs.escape_path(absolute),
        refs.escape_component(F.when(F.col("session_id") != "", F.col("session_id")).otherwise(stem)),
    )
    named = nodes.select(
        "agent", F.col("node_id").alias("ancestor"), segment.alias("segment"), absolute.isNotNull().alias("absolute"),
        refs.root_ref(F.col("agent"), F.col("session_id")).alias("own_root"),
    )
    chains = (
        with_self(nodes, pairs)
        .join(named, ["agent", "ancestor"])
        .groupBy("agent", F.col("descendant").alias("node_id"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("up"), "ancestor", "segment", "absolute", "own_root"))).alias("chain"))
    )
    links = F.slice("chain", F.lit(2), F.greatest(F.size("chain") - 1, F.lit(0)))
    path = F.aggregate(
        links,
        F.lit(""),
        lambda held, link: F.when(link["absolute"] | (held == ""), link["segment"]).otherwise(
            F.concat(held, F.lit("/"), link["segment"])
        ),
    )
    out = nodes.join(chains, ["agent", "node_id"]).withColumn("ref_path", path)
    return out.select(
        *nodes.columns,
        (F.size("chain") - 1).alias("depth"),
        F.col("chain")[0]["ancestor"].alias("root_id"),
        "ref_path",
        F.when(F.size("chain") == 1, F.col("chain")[0]["own_root"])
        .otherwise(F.concat(F.col("chain")[0]["own_root"], F.lit("#"), F.col("ref_path")))
        .alias("ref"),
    )


def addressable(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split referenced nodes into addressable trees and diagnostics about rejected roots."""
    twice = nodes.groupBy("ref").agg(F.count("*").alias("uses")).where("uses > 1").select("ref")
    clash = nodes.join(twice, "ref", "left_semi").select("agent", "root_id", F.lit(1).alias("rank"))
    nameless = nodes.where("node_id = root_id AND session_id = ''").select("agent", "root_id", F.lit(2).alias("rank"))
    rejected = clash.unionByName(nameless).groupBy("agent", "root_id").agg(F.min("rank").alias("rank"))
    good = nodes.join(rejected, ["agent", "root_id"], "left_anti")
    message = F.when(F.col("rank") == 1, F.lit("two nodes of this tree share one reference")).otherwise(
        F.lit("the root carries no id to refer to")
    )
    roots = nodes.where("node_id = root_id").select("agent", "root_id", "path")
    diagnostics = rejected.join(roots, ["agent", "root_id"]).select(
        "agent", "path", F.lit(None).cast("bigint").alias("byte_offset"), F.lit("unaddressable_session").alias("code"), message.alias("message")
    )
    return good, diagnostics


def resolve_selector(selectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Matches of each selector: exact reference, absolute path, exact id, then an id prefix.

    One row per match of the best kind, so an ambiguous selector lists its candidates. ``status``
    is ok, ambiguous_ref, not_found or usage (a prefix below six characters).
    """
    asked = selectors.select("selector").distinct()
    last = F.substring_index("ref_path", "/", -1)
    eligible = (
        F.col("is_group") | (F.col("ref_path") == "") | (F.instr("path", "#") == 0) | (refs.escape_component(F.col("session_id")) != last)
    )
    # Ids are cut to the lengths that selectors have, so whole selectors are the join key; the lengths are one row.
    lengths = asked.where(F.char_length("selector") >= SELECTOR_PREFIX).agg(F.collect_set(F.char_length("selector")).alias("lengths"))
    named = eligible & (F.col("session_id") != "")
    key = lambda value, priority: F.struct(value.alias("selector"), F.lit(priority).alias("priority"))
    some = lambda condition, keys: F.when(condition, keys).otherwise(F.array().cast("array<struct<selector:string,priority:int>>"))
    fitting = F.filter("lengths", lambda length: length <= F.char_length("session_id"))
    keys = F.concat(
        F.array(key(F.col("ref"), 1)),
        some((F.instr("path", "#") == 0) & F.startswith("path", F.lit("/")), F.array(key(F.col("path"), 2))),
        some(named, F.array(key(F.col("session_id"), 3))),
        some(named, F.transform(fitting, lambda length: key(F.substring(F.col("session_id"), F.lit(1), length), 4))),
    )
    every = nodes.select("ref", "ref_path", "session_id", "path", "is_group").crossJoin(F.broadcast(lengths)).select("ref", F.explode(keys).alias("key"))
    found = stage(every.select("key.selector", "key.priority", "ref").join(asked, "selector"), "selected")
    best = found.groupBy("selector", "priority").agg(F.count("*").alias("n")).groupBy("selector").agg(F.min(F.struct("priority", "n")).alias("best"))
    listed = found.join(best, "selector").where("priority = best.priority").select("selector", "ref", F.col("best.n").alias("candidates"))
    out = asked.join(listed, "selector", "left")
    short = F.when(F.char_length("selector") < SELECTOR_PREFIX, F.lit("usage")).otherwise(F.lit("not_found"))
    status = F.when(F.col("candidates").isNull(), short).when(F.col("candidates") > 1, F.lit("ambiguous_ref")).otherwise(F.lit("ok"))
    return out.select("selector", status.alias("status"), "ref", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def subagent_refs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct child references of every node, one row per child."""
    child = nodes.select("agent", F.col("node_id").alias("child"), F.col("ref").alias("child_ref"))
    parent = nodes.select("agent", F.col("node_id").alias("parent"), "ref")
    return edges.join(child, ["agent", "child"]).join(parent, ["agent", "parent"]).select("ref", "child_ref")


def cost_tree(rolled: DataFrame, pairs: DataFrame, root_id: str | None = None) -> DataFrame:
    """Own and subtree flow and gross cost of every node, in pre-order."""
    listed = preorder(rolled, pairs)
    if root_id is not None:
        listed = listed.where(F.col("root_id") == root_id)
    flow = ["uncached_input", "output", "cache_write", "cache_read"]
    return listed.orderBy("agent", "root_id", "sort_path").select(
        "agent", "root_id", "node_id", "depth", "title", "is_group",
        *[f"self_{name}" for name in flow], F.col("self_gross_usd").alias("own_usd"),
        *[f"total_{name}" for name in flow], F.col("total_gross_usd").alias("total_usd"),
    )


def corpus_summary(rolled: DataFrame) -> DataFrame:
    """One row over the listed roots: sessions, projects, owned cost, estimates, missing models."""
    from sessionlake.functions.tokens import cost_valid

    missing = rolled.select(F.explode("total_missing").alias("model")).distinct()
    named = missing.agg(F.array_sort(F.collect_list("model")).alias("missing_pricing"))
    return rolled.agg(
        F.count("*").alias("sessions"),
        F.count_distinct("project").alias("projects"),
        F.sum("total_usd").alias("usd"),
        F.coalesce(F.bool_or("total_estimated"), F.lit(False)).alias("estimated"),
    ).join(named).withColumn("usd", cost_valid(F.col("usd")))


def sibling_titles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Replace colliding sibling titles by the first prompt line no sibling shares.

    A node whose prompt was not retained (empty ``title_prompt``) keeps its title, which still
    counts as one of its lines.
    """
    from sessionlake.functions.text import title_lines

    placed = nodes.join(edges.select("agent", "parent", F.col("child").alias("node_id")), ["agent", "node_id"])
    collided = placed.groupBy("agent", "parent", "title").agg(F.count("*").alias("uses")).where("uses > 1")
    crowded = collided.select("agent", "parent").distinct()
    lines = F.when(F.col("title_prompt") != "", title_lines(F.col("title_prompt"))).otherwise(
        F.filter(F.array("title"), lambda title: title != "")
    )
    spread = placed.join(crowded, ["agent", "parent"], "left_semi").select(
        "agent", "parent", "node_id", F.posexplode(lines).alias("at", "line")
    )
    shared = (
        spread.groupBy("agent", "parent", "line", "node_id").agg(F.lit(1).alias("one"))
        .groupBy("agent", "parent", "line").agg(F.count("*").alias("nodes")).where("nodes > 1").select("agent", "parent", "line")
        .unionByName(collided.select("agent", "parent", F.col("title").alias("line")))
        .distinct()
    )
    renamed = (
        placed.where("title_prompt <> ''")
        .join(collided.select("agent", "parent", "title"), ["agent", "parent", "title"], "left_semi")
        .select("agent", "node_id")
    )
    free = (
        spread.join(renamed, ["agent", "node_id"], "left_semi")
        .join(shared, ["agent", "parent", "line"], "left_anti")
        .groupBy("agent", "node_id")
        .agg(F.min_by("line", "at").alias("free_title"))
    )
    first = F.when(F.col("title_prompt") != "", F.get(title_lines(F.col("title_prompt")), F.lit(0)))
    out = nodes.join(free, ["agent", "node_id"], "left").join(renamed.withColumn("renamed", F.lit(True)), ["agent", "node_id"], "left")
    title = F.when(F.col("renamed"), F.coalesce("free_title", first, F.col("title"))).otherwise(F.col("title"))
    return out.withColumn("title", title).select(*nodes.columns)
