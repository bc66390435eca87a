"""Full-text search over event fields, and the token scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.matching import Matcher, compile_matcher, snippet
from sessionlake.operators.sessions import byte_budget_page, event_text, filter_sessions, page, paging_state, parse_kinds, resolve
from sessionlake.plans import grams
from sessionlake.plans.staging import stage

# Fixed values.
FIELDS = ["text", "tool.input", "tool.diff", "tool.output", "tool.summary"]
SCAN_ALLOWED = [
    "docker-desktop", "minikube", "kind", "k3s", "k3d", "default", "kube-system", "kube-public", "kube-node-lease",
    "kubernetes", "kubernetes-admin", "aws_profile", "local", "in-cluster",
]
SCAN_MIN_CHARS = 5
INDEX_LITERALS = 1_000
ACCOUNT_ID = r"\b\d{12}\b"
ARN_TAIL = r"/([^/:\s]+)\z"


class UnreadableScope(RuntimeError):
    """A scoped search met a descendant that could not be read."""


def search_fields(events: DataFrame) -> DataFrame:
    """Add ``fields``: the five searchable texts of an event in fixed order, empty ones dropped."""
    shown = event_text(events)
    texts = [F.col("shown_text"), F.col("shown_input"), F.col("detail_diff"), F.col("detail_output"), F.col("summary")]
    cells = [F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"), text.alias("text")) for rank, (name, text) in enumerate(zip(FIELDS, texts))]
    return shown.withColumn("fields", F.filter(F.array(*cells), lambda field: field["text"] != ""))


def match_fields(rows: DataFrame, matcher: Matcher, around: int = 200) -> DataFrame:
    """One row per matching field with range, snippet and match count.

    Fields are tested inside the array, so rows without a match are never exploded.
    """
    kept = rows.withColumn("fields", F.filter("fields", lambda field: matcher.hits(field["text"]))).where("size(fields) > 0")
    hits = kept.withColumn("field", F.explode("fields")).drop("fields")
    text = F.col("field.text")
    start, end = matcher.span(text)
    hits = hits.withColumns({"range_start": start, "range_end": end, "matches": matcher.count(text)})
    return hits.withColumn("snippet", snippet(text, F.col("range_start"), F.col("range_end"), around))


def search_order() -> list[Column]:
    return [F.col("root_updated_at").desc_nulls_last(), F.col("root_ref"), F.col("ref"), F.col("event_index"), F.col("field_rank")]


def scope_nodes(nodes: DataFrame, session: str | None = None, **filters) -> DataFrame:
    """Nodes to search: subtrees of the matching roots, or of the node that ``session`` selects."""
    if session is None:
        starts = filter_sessions(nodes.where("node_id = root_id"), **filters)
        starts = starts.select("agent", "root_id", F.col("ref").alias("root_ref"), F.col("updated_at").alias("root_updated_at"))
        return nodes.join(starts, ["agent", "root_id"])
    start = filter_sessions(nodes.where(F.col("ref") == resolve(nodes, session)), **filters)
    start = start.select("agent", "root_id", F.col("ref").alias("root_ref"), F.col("updated_at").alias("root_updated_at"), F.col("node_id").alias("start_id"))
    return nodes.join(start, ["agent", "root_id"])


def filter_scope(scoped: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keep the start node and its descendants."""
    if "start_id" not in scoped.columns:
        return scoped
    below = pairs.select("agent", F.col("ancestor").alias("start_id"), F.col("descendant").alias("node_id"))
    own = scoped.where("node_id = start_id")
    return scoped.join(below, ["agent", "start_id", "node_id"], "left_semi").select(*own.columns).unionByName(own)


def unreadable_below(scoped: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``agent, path, failed``: the start transcripts of a scope and the files in their companion folders that could not be read.

    Every failed file is keyed by each folder above it, and every transcript by its companion folder, so the two meet by
    equality: the work follows the failures and the depth of their paths.
    """
    companion = F.regexp_replace("path", r"\.[^./]*$", "")
    starts = scoped.where("node_id = start_id AND instr(path, '#') = 0").select("agent", "path", companion.alias("folder")).distinct()
    failed = diagnostics.where("code = 'unreadable_session'").select("agent", F.col("path").alias("failed")).distinct()
    parts = F.split("failed", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    placed = failed.where(F.contains("failed", F.lit("/"))).select("agent", "failed", F.explode(above).alias("folder"))
    return placed.join(starts, ["agent", "folder"]).select("agent", "path", "failed")


def require_readable(scoped: DataFrame, diagnostics: DataFrame) -> None:
    """A scoped search fails when a file below its start could not be read."""
    if not unreadable_below(scoped, diagnostics).isEmpty():
        raise UnreadableScope("a file below the chosen session cannot be read")


def search_hits(
    nodes: DataFrame,
    events: DataFrame,
    pairs: DataFrame,
    pattern: str,
    regex: bool = False,
    case_sensitive: bool = False,
    kinds: list[str] | None = None,
    session: str | None = None,
    around: int = 200,
    diagnostics: DataFrame | None = None,
    index: DataFrame | None = None,
    **filters,
) -> DataFrame:
    """Every hit, unpaged: summary filters first, then only the events of the nodes in scope.

    ``index`` (rows of ``gram_index``) rules files out before any of their events is read.
    """
    matcher = compile_matcher(pattern, regex, case_sensitive)
    kinds = parse_kinds(kinds)
    scoped = scope_nodes(nodes, session, **filters)
    if session is not None and diagnostics is not None:
        require_readable(scoped, diagnostics)
    scoped = filter_scope(scoped, pairs).select(
        "agent", "node_id", "ref", "project", "title", F.col("updated_raw").alias("session_updated_at"), "root_ref", "root_updated_at"
    )
    if kinds:
        events = events.where(F.col("kind").isin(kinds))
    if index is not None and not regex:
        events = _only_promising(events, index, pattern, case_sensitive)
    # Matching runs below the join, so only hits are joined to their session.
    live = events.join(scoped.select("agent", "node_id"), ["agent", "node_id"], "left_semi")
    hits = match_fields(search_fields(live), matcher, around).select(
        "agent", "node_id", "event_index", "ts_raw", "kind", "tool_name", F.col("field.name").alias("field"),
        F.col("field.rank").alias("field_rank"), "range_start", "range_end", "snippet", "matches",
    )
    return hits.join(scoped, ["agent", "node_id"])


def gram_index(events: DataFrame) -> DataFrame:
    """``path, bits``: filters over the grams of the searchable texts of every file, a few per cent of the texts."""
    texts = search_fields(events).select("path", F.transform("fields", lambda field: field["text"]).alias("texts"))
    return texts.sortWithinPartitions("path").mapInArrow(grams.sketch, "path string, bits binary")


def _only_promising(events: DataFrame, index: DataFrame, pattern: str, case_sensitive: bool) -> DataFrame:
    """Events of the files whose filter does not rule the pattern out.

    Letters are folded in ASCII alone, so a pattern that folds beyond it, or one too short for a gram, rules nothing out.
    Few files go to the scan as literals, which skips the row groups of all others; many are joined.
    """
    if not case_sensitive and not pattern.isascii():
        return events
    test = grams.may_hold(pattern.encode())
    if test is None:
        return events
    promising = index.select("path", "bits").mapInArrow(test, "path string").distinct()
    few = [row.path for row in promising.limit(INDEX_LITERALS + 1).collect()]
    if len(few) <= INDEX_LITERALS:
        return events.where(F.col("path").isin(few)) if few else events.where("false")
    return events.join(promising, "path", "left_semi").select(*events.columns)


def search_events(nodes, events, pairs, pattern: str, limit: int | None = 30, offset: int = 0, **options) -> DataFrame:
    """Ordered, paged hits within the response budget."""
    hits = search_hits(nodes, events, pairs, pattern, **options)
    paged = page(hits, search_order(), limit, offset)
    return byte_budget_page(paged, search_order(), limit=limit)


def search_state(hits: DataFrame, returned: DataFrame, offset: int = 0, diagnostics: DataFrame | None = None) -> DataFrame:
    """Paging state of an answer; complete only if all input was readable and all hits went out."""
    clean = diagnostics is None or diagnostics.isEmpty()
    return paging_state(hits, returned, offset, clean)


def search_counts(scoped_nodes: DataFrame, hits: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row: nodes scanned and matched, hits in total, and whether the answer is complete."""
    scanned = scoped_nodes.agg(F.count("*").alias("sessions_scanned"))
    matched = hits.agg(F.count_distinct("ref").alias("sessions_matched"), F.count("*").alias("total"))
    clean = diagnostics is None or diagnostics.isEmpty()
    return scanned.withColumn("one", F.lit(1)).join(matched.withColumn("one", F.lit(1)), "one").drop("one").withColumn("complete", F.lit(clean))


def scan_tokens(names: DataFrame) -> DataFrame:
    """Tokens to look for: names, or the account ids and tail of a resource name; noise dropped."""
    name = F.trim("name")
    is_arn = F.contains(name, F.lit("arn:"))
    ids = F.transform(F.regexp_extract_all(name, F.lit(ACCOUNT_ID), F.lit(0)), lambda token: F.struct(token.alias("token"), F.lit(True).alias("exempt")))
    tail = F.regexp_extract(name, ARN_TAIL, 1)
    single = lambda token: F.array(F.struct(F.trim(token).alias("token"), F.lit(False).alias("exempt")))
    found = F.when(is_arn, F.concat(ids, single(tail))).otherwise(single(name))
    tokens = names.select(F.explode(found).alias("t")).select("t.*")
    kept = (F.col("token") != "") & ~F.lower("token").isin(SCAN_ALLOWED) & (F.col("exempt") | (F.char_length("token") >= SCAN_MIN_CHARS))
    return tokens.where(kept).select("token").distinct()


def token_scan(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(text_id, token)`` for every text that contains a token, ignoring case; null texts and empty tokens match nothing.

    Every token is anchored at its rarest gram of fixed length, by counts of hashed grams over all texts; a token with a
    gram that stands in no text is out at once. A second linear pass finds the texts that hold an anchor, past a
    filter of ``2 ** FILTER_BITS`` bits for each gram length, and only these are tested for the whole token.
    What is sent to the tasks (counts and filters) is bounded whatever the number of tokens or texts.
    """
    spark = texts.sparkSession
    bodies = texts.where("text IS NOT NULL").select("text_id", F.lower("text").alias("body"))
    low = tokens.select("token", F.lower("token").alias("needle")).where("needle <> ''").distinct()
    long = F.octet_length("needle")
    size = F.when(long >= 8, 8).when(long >= 4, 4).when(long >= 2, 2).otherwise(1)
    sizes = sorted(row[0] for row in low.select(size).distinct().collect())  # at most four
    if not sizes:
        return texts.select("text_id", F.lit(None).cast("string").alias("token")).where("false")
    counts = {each: np.zeros(1 << grams.COUNT_BITS, np.int64) for each in sizes}
    counted = bodies.select("body").mapInArrow(grams.count_grams(sizes), "size int, bucket long, n long").groupBy("size", "bucket").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # at most 2 ** COUNT_BITS rows a size
        counts[row["size"]][row["bucket"]] = row["n"]
    anchored = stage(low.mapInArrow(grams.anchor(spark.sparkContext.broadcast(counts)), "token string, needle string, size int, code long"), "anchors")
    filters = {each: np.zeros(1 << grams.FILTER_BITS, bool) for each in sizes}
    for row in anchored.mapInArrow(_filter_bits, "size int, bit long").distinct().collect():  # at most 2 ** FILTER_BITS rows a size
        filters[row["size"]][row["bit"]] = True
    found = bodies.mapInArrow(grams.find_grams(spark.sparkContext.broadcast(filters)), f"text_id {dict(bodies.dtypes)['text_id']}, size int, code long")
    suspects = found.join(anchored, ["size", "code"]).select("text_id", "token", "needle").distinct()
    return bodies.join(suspects, "text_id").where(F.contains("body", F.col("needle"))).select("text_id", "token").distinct()


def _filter_bits(batches):
    for batch in batches:
        code = batch.column(3).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(grams.spread(code, grams.FILTER_BITS))], ["size", "bit"])
