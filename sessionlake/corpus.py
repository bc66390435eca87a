"""Assemble the canonical tables of a transcript corpus."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators import graph, ledger, pricing, timeline, tree
from sessionlake.plans.joins import tune_for_skew
from sessionlake.plans.staging import stage
from sessionlake.sources import claude, codex, scan
from sessionlake.sources.records import REQUEST_COLUMNS, USAGE_FIELDS, distinct_models


@dataclass
class Corpus:
    """Lazy canonical tables over ``raw_records`` and a price table.

    Tables that several others read are staged once in the shared folder.
    """

    spark: SparkSession
    files: DataFrame
    raw: DataFrame
    prices: DataFrame
    default_model: str | None = None

    def _agent_raw(self, agent: str) -> DataFrame:
        return self.raw.where((F.col("agent") == agent) & F.col("line").isNotNull())

    @cached_property
    def roles(self) -> DataFrame:
        return stage(scan.classify_path(self.files), "roles")

    @cached_property
    def claude_records(self) -> DataFrame:
        return claude.claude_records(self._agent_raw(scan.CLAUDE))

    @cached_property
    def claude_lines(self) -> DataFrame:
        return stage(claude.claude_lines(self.claude_records), "claude-lines")

    @cached_property
    def codex_records(self) -> DataFrame:
        return codex.codex_records(self._agent_raw(scan.CODEX))

    @cached_property
    def codex_meta(self) -> DataFrame:
        return stage(codex.file_meta(self.codex_records), "codex-meta")

    @cached_property
    def codex_state(self) -> DataFrame:
        return codex.line_state(self.codex_records, self.codex_meta)

    @cached_property
    def claude_summaries(self) -> DataFrame:
        return stage(claude.claude_summaries(self.claude_lines), "claude-summaries")

    @cached_property
    def codex_summaries(self) -> DataFrame:
        return stage(codex.codex_summaries(self.codex_records, self.codex_state, self.codex_meta), "codex-summaries")

    @cached_property
    def ledger(self) -> DataFrame:
        """Deduplicated, unpriced request ledger of every file of both formats."""
        first = ledger.dedup_requests(claude.claude_requests(self.claude_lines))
        second = codex.codex_ledger(self.codex_state)
        columns = [*REQUEST_COLUMNS, "ledger_at"]
        return stage(first.select(*columns).unionByName(second.select(*columns)), "ledger")

    @cached_property
    def runs(self) -> DataFrame:
        return claude.workflow_names(self.claude_lines)

    @cached_property
    def codex_activities(self) -> DataFrame:
        return self.codex_state.where("type = 'event_msg' AND item = 'sub_agent_activity'")

    @cached_property
    def codex_models(self) -> DataFrame:
        return codex.codex_models(self.codex_records)

    @cached_property
    def requests(self) -> DataFrame:
        """Priced ledger: prices apply per request, below every aggregation."""
        priced = pricing.price_requests(self.ledger, self.prices, self.default_model).drop("price")
        return stage(priced, "requests")

    @cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        first = graph.claude_graph(self.claude_summaries, self.roles, self.runs)
        second = graph.codex_graph(self.codex_summaries, self.codex_activities)
        nodes = stage(first[0].unionByName(second[0]), "nodes")
        edges = stage(first[1].unionByName(second[1]), "edges")
        return stage(tree.sibling_titles(nodes, edges), "titled"), edges

    @property
    def edges(self) -> DataFrame:
        return self._graph[1]

    @cached_property
    def pairs(self) -> DataFrame:
        return tree.closure(self.edges)

    @cached_property
    def _addressed(self) -> tuple[DataFrame, DataFrame]:
        referenced = tree.with_refs(self._graph[0], self.pairs)
        return tree.addressable(referenced)

    @cached_property
    def attributed(self) -> DataFrame:
        roots = tree.roots_of(self._graph[0], self.edges)
        return ledger.attribute_ownership(self.requests, roots)

    @cached_property
    def models(self) -> DataFrame:
        billed = self.requests.where(F.col("agent") == scan.CLAUDE)
        first = distinct_models(billed, ["agent", "node_id"], F.col("ledger_at"))
        both = first.unionByName(self.codex_models)
        return graph.group_models(both, self._graph[0], self.edges)

    @cached_property
    def nodes(self) -> DataFrame:
        """Addressable nodes with references, models, and owned tokens and cost rolled up."""
        totals = tree.node_totals(self.requests, self.attributed)
        rolled = tree.rollup(self._addressed[0], totals, self.edges)
        return stage(rolled.join(self.models, ["agent", "node_id"], "left"), "rolled")

    @property
    def roots(self) -> DataFrame:
        return self.nodes.where("node_id = root_id")

    @cached_property
    def diagnostics(self) -> DataFrame:
        _, bad = scan.skip_malformed(self.raw)
        return bad.unionByName(self._addressed[1])

    @cached_property
    def file_events(self) -> DataFrame:
        """Indexed timelines of every file, without prices; a node's events all come from one file."""
        requests = self.ledger.select(
            "agent", "node_id", "byte_offset", "is_aggregate", F.struct(*USAGE_FIELDS).alias("usage_struct")
        )
        first = timeline.claude_events(self.claude_records, self.claude_lines)
        second = timeline.codex_events(self.codex_records, self.codex_state, self.codex_meta, requests, self.codex_summaries)
        return stage(timeline.event_index(stage(first.unionByName(second), "unindexed")), "file-events")

    def linked_events(self) -> DataFrame:
        """Timelines of the addressable nodes, priced, spawn events linked to their child's reference."""
        nodes = self.nodes.select("agent", "node_id", "ref")
        placed = self.file_events.join(nodes.select("agent", "node_id"), ["agent", "node_id"], "left_semi")
        links = graph.spawn_links(self.file_events, self.nodes, self.edges)
        child = nodes.select("agent", F.col("node_id").alias("child"), F.col("ref").alias("subagent_ref"))
        targets = links.join(child, ["agent", "child"]).select("agent", "node_id", "seq", "subagent_ref")
        linked = placed.join(targets, ["agent", "node_id", "seq"], "left")
        return price_events(linked, self.prices, self.default_model)

    @cached_property
    def events(self) -> DataFrame:
        """Linked and priced timelines, kept sorted by node so that one node's rows sit together."""
        return stage(self.linked_events().sortWithinPartitions("node_id", "event_index"), "events")


def price_events(events: DataFrame, prices: DataFrame, default_model: str | None = None) -> DataFrame:
    """Add ``event_usd``, ``event_priced``, ``event_estimated`` and ``pricing_model`` from the event's own usage."""
    kept = events.withColumnRenamed("model", "shown_model")
    flat = kept.select("*", *[F.col(f"usage.{name}").alias(name) for name in USAGE_FIELDS])
    priced = pricing.resolve_prices(flat, prices, default_model)
    known = F.col("usage").isNotNull()
    usd = F.when(known & F.col("priced"), pricing.rate_cost()).otherwise(F.lit(0.0))
    out = priced.withColumns(
        {
            "event_usd": usd,
            "event_priced": known & F.col("priced"),
            "event_estimated": known & (F.col("agent") == scan.CODEX) & ~F.col("exact"),
            "pricing_model": F.when(known & (F.col("agent") == scan.CODEX) & ~F.col("exact"), F.col("pricing_model")),
        }
    )
    return out.drop(*USAGE_FIELDS, "price", "exact", "priced").withColumnRenamed("shown_model", "model")


def open_corpus(
    spark: SparkSession, roots: dict[str, str | list[str]], prices: DataFrame, default_model: str | None = None
) -> Corpus:
    """Canonical tables of all transcripts below the roots of each agent."""
    tune_for_skew(spark)
    files = stage(scan.list_files(spark, roots), "files")
    # Every line goes through Python once; all later passes read the staged table.
    raw = stage(scan.scan_files(files).sortWithinPartitions("agent", "path", "byte_offset"), "raw")
    return Corpus(spark, files, raw, prices, default_model)
