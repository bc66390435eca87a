"""List and show: filters, sorting, paging and the wire rows of sessions and events."""

from __future__ import annotations

import hashlib
import os.path
import re
from datetime import datetime, timedelta, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.functions.matching import fuzzy_pattern
from sessionlake.functions.tokens import context_tokens, cost_valid, flow_tokens, sat_add, uncached_input
from sessionlake.operators.timeline import KINDS
from sessionlake.operators.tree import resolve_selector
from sessionlake.plans.running import Running, range_blocks, running
from sessionlake.sources.scan import MAX_LINE_BYTES, offset_block

# Fixed values.
SCHEMA_VERSION = 1
RESPONSE_BUDGET_BYTES = 256 * 1024
PAGE_ROWS = 10_000
NO_TIME = "0001-01-01T00:00:00Z"
SORT_KEYS = ["updated", "started", "tokens", "cost", "messages"]
DISPLAY_KEYS = ["agent", "project", "title", "model", "age", "messages", "subagents", "tokens", "cost"]


class UsageError(ValueError):
    """An argument the query does not accept."""


def parse_time(value: str | datetime, now: datetime | None = None, zone=timezone.utc) -> datetime:
    """RFC 3339 time, date in ``zone``, or an age such as ``7d``, ``24h`` or ``90m``."""
    if isinstance(value, datetime):
        return value
    now = now or datetime.now(timezone.utc)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})", value):
        return datetime.fromisoformat(value.replace("Z", "+00:00"))
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return datetime.fromisoformat(value).replace(tzinfo=zone)
    if re.fullmatch(r"\d+(\.\d+)?d", value) and float(value[:-1]) > 0:
        return now - timedelta(days=float(value[:-1]))
    units = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
    pieces = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ms|us|µs|ns|h|m|s)", value)
    if pieces and "".join(number + unit for number, unit in pieces) == value:
        seconds = sum(float(number) * units[unit] for number, unit in pieces)
        if seconds > 0:
            return now - timedelta(seconds=seconds)
    raise UsageError(f"invalid time {value!r}")


def cwd_within(root: str, column: Column) -> Column:
    """Is the directory ``root`` itself or below it? An empty directory never is."""
    root = os.path.normpath(os.path.abspath(root))
    tidy = F.regexp_replace(F.regexp_replace(column, "/+", "/"), "(?<=.)/$", "")
    below = F.startswith(tidy, F.lit(root if root == "/" else root + "/"))
    return (column != "") & ((tidy == root) | below)


def filter_sessions(
    roots: DataFrame,
    agent: str | None = None,
    project: str | None = None,
    cwd: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    query: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Summary filters; a session without an update time is older than any bound."""
    if agent:
        roots = roots.where(F.col("agent") == agent)
    if project:
        roots = roots.where(F.col("project") == project)
    if cwd:
        roots = roots.where(cwd_within(cwd, F.col("cwd")))
    if since:
        roots = roots.where(F.col("updated_at") >= F.lit(parse_time(since, now)))
    if until:
        roots = roots.where(F.col("updated_at").isNull() | (F.col("updated_at") <= F.lit(parse_time(until, now))))
    if query and query.strip():
        haystack = F.lower(F.concat_ws(" ", "agent", "project", "title"))
        roots = roots.where(F.rlike(haystack, F.lit(fuzzy_pattern(query))))
    return roots


def sort_sessions(rows: DataFrame, sort: str = "updated", order: str = "desc") -> list[Column]:
    """Sort columns; ties always go by agent and id ascending."""
    if sort not in SORT_KEYS:
        raise UsageError(f"invalid sort {sort!r}")
    if order not in ("asc", "desc"):
        raise UsageError(f"invalid order {order!r}")
    key = {
        "updated": F.col("updated_at"),
        "started": F.col("started_at"),
        "tokens": F.col("total_total"),
        "cost": cost_valid(F.col("total_usd")),
        "messages": F.col("messages"),
    }[sort]
    lead = key.desc_nulls_last() if order == "desc" else key.asc_nulls_first()
    return [lead, F.col("agent"), F.col("session_id")]


def sort_display(sort: str, descending: bool = False) -> list[Column]:
    """Sort columns of the display table; sessions without a time come last both ways."""
    if sort not in DISPLAY_KEYS:
        raise UsageError(f"invalid sort {sort!r}")
    key = {
        "agent": F.col("agent"),
        "project": F.col("project"),
        "title": F.lower(F.substring_index("title", "\n", 1)),
        "model": F.col("model_label"),
        "age": F.col("updated_at"),
        "messages": F.col("messages"),
        "subagents": F.col("subagents"),
        "tokens": F.col("total_total"),
        "cost": cost_valid(F.col("total_usd")),
    }[sort] if sort != "model" else F.col("model_label")
    lead = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return [lead, F.col("agent"), F.col("path"), F.col("session_id")]


def rendered_time(raw: str) -> Column:
    return F.coalesce(F.when(F.col(raw) != "", F.col(raw)), F.lit(NO_TIME))


def session_rows(rolled: DataFrame) -> DataFrame:
    """Wire columns of a session: owned tokens and cost over its subtree, arrays never null."""
    return rolled.select(
        "ref", "agent", "project", "cwd", "title", "git_branch",
        F.array_sort(F.coalesce("models", F.array().cast("array<string>"))).alias("models"),
        rendered_time("started_raw").alias("started_at"),
        rendered_time("updated_raw").alias("updated_at"),
        "messages", "subagents", "has_error",
        F.struct(
            F.col("total_uncached_input").alias("uncached_input"), F.col("total_output").alias("output"),
            F.col("total_cache_write").alias("cache_write"), F.col("total_cache_read").alias("cache_read"),
            F.col("total_total").alias("total"),
        ).alias("tokens"),
        cost_row("total").alias("cost"),
        "path",
    )


def cost_row(scope: str) -> Column:
    return F.struct(
        cost_valid(F.col(f"{scope}_usd")).alias("usd"),
        (F.size(f"{scope}_missing") == 0).alias("complete"),
        F.col(f"{scope}_estimated").alias("estimated"),
        F.col(f"{scope}_missing").alias("missing_pricing"),
    )


def _page_bounds(limit: int | None, offset: int) -> None:
    if limit is not None and limit <= 0:
        raise UsageError(f"a page holds at least one row, not {limit}")
    if offset < 0:
        raise UsageError(f"a page starts at row 0 or later, not {offset}")


def ranked(rows: DataFrame, order: list[Column], size: Column | None = None) -> DataFrame:
    """Add ``__nth`` (from 1) and ``__sum`` (running ``size``) along ``order``, however many rows there are.

    The rows are sorted by range into parts; only one row per part is combined in a single task.
    """
    sized = rows.withColumn("__size", F.lit(0) if size is None else size)
    parts = range_blocks(sized, order, "__part")
    specs = {"__nth": Running("sum", F.lit(1)), "__sum": Running("sum", F.col("__size"))}
    return running(parts, [], order, F.col("__part"), specs).drop("__size", "__part")


def page(rows: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order; with a limit Spark keeps only the top rows per task."""
    _page_bounds(limit, offset)
    if limit is None and offset:
        return ranked(rows, order).where(F.col("__nth") > offset).drop("__nth", "__sum").orderBy(*order)
    ordered = rows.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def page_info(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """One row: offset, limit, returned, total, has_more, next_offset."""
    _page_bounds(limit, offset)
    total = F.count("*")
    left = F.greatest(total - offset, F.lit(0))
    returned = left if limit is None else F.least(left, F.lit(limit))
    return rows.agg(
        F.lit(offset).cast("bigint").alias("offset"),
        F.lit(limit or 0).cast("bigint").alias("limit"),
        returned.cast("bigint").alias("returned"),
        total.alias("total"),
        (returned + offset < total).alias("has_more"),
        (returned + offset).cast("bigint").alias("next_offset"),
    )


def list_sessions(
    roots: DataFrame, sort: str = "updated", order: str = "desc", limit: int | None = 50, offset: int = 0, **filters
) -> DataFrame:
    """Wire rows of the matching top-level sessions, filtered, sorted and paged."""
    kept = filter_sessions(roots, **filters)
    return session_rows(page(kept, sort_sessions(kept, sort, order), limit, offset))


def byte_budget_page(
    rows: DataFrame, order: list[Column], budget: int = RESPONSE_BUDGET_BYTES, size: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Leading rows whose serialised size fits the budget, ``limit`` at most if given; the first row always stays."""
    size = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})) if size is None else size
    head = rows if limit is None else rows.orderBy(*order).limit(limit)
    if limit is not None and limit <= PAGE_ROWS:  # as many rows as one task sorts anyway
        so_far = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        counted = head.withColumns({"__sum": F.sum(size).over(so_far), "__nth": F.row_number().over(W.orderBy(*order))})
    else:
        counted = ranked(head, order, size)
    return counted.where((F.col("__sum") <= budget) | (F.col("__nth") == 1)).drop("__sum", "__nth")


def paging_state(rows: DataFrame, returned: DataFrame, offset: int = 0, complete: bool = True, index: str | None = None) -> DataFrame:
    """One row about an answer: total, returned, has_more, next_offset, complete.

    ``rows`` are all that match, ``returned`` those that went out. The next offset counts rows, or goes behind
    the largest ``index`` that went out; ``complete`` also needs that nothing is left to fetch.
    """
    position = F.lit(offset).cast("bigint") + F.count("*") if index is None else F.coalesce(F.max(index).cast("bigint") + 1, F.lit(offset).cast("bigint"))
    sent = returned.agg(F.count("*").alias("returned"), position.alias("next_offset"))
    skipped = offset if index is None else 0
    return rows.agg(F.count("*").alias("total")).join(sent).select(
        "total", "returned", (F.col("returned") + skipped < F.col("total")).alias("has_more"), "next_offset",
        (F.lit(complete) & (F.col("returned") + skipped >= F.col("total"))).alias("complete"),
    )


def fit_single_event(wire: DataFrame, budget: int = RESPONSE_BUDGET_BYTES) -> DataFrame:
    """Bound the texts of an event too large for the budget by the largest limit that fits; smaller events stay.

    All texts of an event share one limit. It is found by halving the range of limits inside the row; an event too
    large for the budget even with a limit of one character keeps that limit.
    """
    fields = {"text": F.col("text")} | {f"tool.{name}": F.col(f"tool.{name}") for name in ("summary", "input", "diff", "output")}
    filled = {name: F.coalesce(value, F.lit("")) for name, value in fields.items()}
    encoded = lambda value: F.octet_length(F.to_json(F.struct(value.alias("x"))))
    total = lambda values: reduce(lambda one, other: one + other, values)
    size = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))

    def needed(limit: Column) -> Column:
        texts = [encoded(T.bounded_text(value, limit)) for value in filled.values()]
        names = [F.when(T.is_cut(value, limit) & ~F.array_contains("truncated", name), len(name) + 3).otherwise(0) for name, value in filled.items()]
        first = F.when((F.size("truncated") == 0) & (total(names) > 0), 1).otherwise(0)  # the first name has no comma before it
        return F.col("__fixed") + total(texts + names) - first

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"] + 1).bitwiseAND(F.lit(-2)) / 2
        middle = middle.cast("int")
        fits = needed(middle) <= budget
        return F.struct(F.when(fits, middle).otherwise(state["low"]).alias("low"), F.when(fits, state["high"]).otherwise(middle - 1).alias("high"))

    longest = F.greatest(*[F.char_length(value) for value in filled.values()])
    start = F.struct(F.lit(1).alias("low"), F.greatest(longest, F.lit(1)).alias("high"))
    sized = wire.withColumn("__fixed", F.when(size > budget, size - total([encoded(value) for value in filled.values()])))
    roomed = sized.withColumn("__room", F.when(F.col("__fixed").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve)["low"]))
    over, room = F.col("__room").isNotNull(), F.col("__room")
    cut = {name: F.when(over, T.bounded_text(value, room)).otherwise(value) for name, value in fields.items()}
    tool = F.col("tool")
    for name in ("summary", "input", "diff", "output"):
        tool = tool.withField(name, cut[f"tool.{name}"])
    longer = [F.when(over & T.is_cut(value, room), F.lit(name)) for name, value in filled.items()]
    return roomed.withColumns({
        "text": cut["text"], "tool": F.when(F.col("tool").isNotNull(), tool), "truncated": F.array_union("truncated", F.array_compact(F.array(*longer))),
    }).drop("__fixed", "__room")


def parse_kinds(kinds: list[str] | None) -> list[str] | None:
    for kind in kinds or []:
        if kind not in KINDS:
            raise UsageError(f"invalid event kind {kind!r}")
    return kinds or None


def event_text(events: DataFrame) -> DataFrame:
    """Add the searchable projection: ``shown_text`` and ``shown_input``."""
    named = F.when(F.col("tool_input") == "", F.col("tool_name")).otherwise(
        F.concat("tool_name", F.lit("("), "tool_input", F.lit(")"))
    )
    text = F.when(F.col("text") != "", F.col("text")).when(F.col("tool_name") == "", F.lit("")).otherwise(named)
    full = F.when(F.col("detail_input") != "", F.col("detail_input")).otherwise(F.col("tool_input"))
    return events.withColumns({"shown_text": text, "shown_input": full})


def event_rows(events: DataFrame, max_text: int = 2000) -> DataFrame:
    """Wire columns of events, long texts bounded and named in ``truncated``."""
    shown = event_text(events)
    fields = {
        "text": F.col("shown_text"), "tool.summary": F.col("summary"), "tool.input": F.col("shown_input"),
        "tool.diff": F.col("detail_diff"), "tool.output": F.col("detail_output"),
    }
    cut = F.array_compact(F.array(*[F.when(T.is_cut(value, max_text), F.lit(name)) for name, value in fields.items()]))
    keep = {name: T.bounded_text(value, max_text) for name, value in fields.items()}
    has_tool = (F.col("tool_name") != "") | (F.col("call_id") != "") | F.col("has_detail") | (F.col("summary") != "")
    use = lambda name: F.col(f"usage.{name}")
    usage = F.struct(
        uncached_input(use).alias("uncached_input"), use("output").alias("output"), sat_add(use("write_5m"), use("write_1h")).alias("cache_write"),
        use("cache_read").alias("cache_read"), flow_tokens(use).alias("flow"), context_tokens(use).alias("context"),
    )
    cost = F.struct(F.col("event_usd").alias("usd"), F.col("event_priced").alias("complete"), F.col("event_estimated").alias("estimated"))
    columns = [
        F.col("event_index").alias("index"),
        rendered_time("ts_raw").alias("timestamp"),
        "kind",
        keep["text"].alias("text"),
        "model",
        F.when(
            has_tool,
            F.struct(
                F.col("tool_name").alias("name"), "call_id", keep["tool.summary"].alias("summary"), keep["tool.input"].alias("input"),
                keep["tool.diff"].alias("diff"), keep["tool.output"].alias("output"), "duration_ms",
            ),
        ).alias("tool"),
        F.when(F.col("usage").isNotNull(), usage).alias("usage"),
        F.when(F.col("usage").isNotNull(), cost).alias("cost"),
        cut.alias("truncated"),
        F.when(F.col("byte_length") > 0, F.struct("path", F.col("byte_offset").alias("offset"), F.col("byte_length").alias("length"))).alias("record"),
        "harness",
        F.when(F.col("kind") == "compact", F.struct(F.col("compact_trigger").alias("trigger"), F.col("compact_post_tokens").alias("post_tokens"))).alias("compact"),
        "usage_aggregate",
    ]
    if "subagent_ref" in events.columns:
        columns.append("subagent_ref")
    return shown.select(*columns)


def resolve(nodes: DataFrame, selector: str) -> str:
    """The reference that a reference, path, id or id prefix names; an unclear or unknown one is an error."""
    return _chosen(nodes, selector).ref


def _chosen(nodes: DataFrame, selector: str) -> Row:
    """``ref, agent, node_id`` of the node that a selector names; a reference costs one job."""
    keys = nodes.select("ref", "agent", "node_id")
    exact = keys.where(F.col("ref") == selector).head(1)
    if exact:
        return exact[0]
    asked = nodes.sparkSession.createDataFrame([(selector,)], "selector string")
    found = resolve_selector(asked, nodes).orderBy("ref").limit(11).collect()
    if found[0].status == "ok":
        return keys.where(F.col("ref") == found[0].ref).first()
    if found[0].status == "ambiguous_ref":
        raise UsageError(f"{selector!r} fits {found[0].candidates} sessions, among them {', '.join(row.ref for row in found)}")
    raise UsageError(f"{selector!r} names no session" if found[0].status == "not_found" else f"{selector!r} is too short for the start of an id")


def timeline_of(nodes: DataFrame, events: DataFrame, selector: str, kinds: list[str] | None = None) -> DataFrame:
    """All events of the node that ``selector`` names, of the given kinds."""
    kinds = parse_kinds(kinds)
    # The node's key goes to the scan as a literal and prunes the files.
    chosen = _chosen(nodes, selector)
    rows = events.where((F.col("agent") == chosen.agent) & (F.col("node_id") == chosen.node_id))
    return rows.where(F.col("kind").isin(kinds)) if kinds else rows


def show_session(
    nodes: DataFrame, events: DataFrame, ref: str, kinds: list[str] | None = None, offset: int = 0, limit: int | None = 200, max_text: int = 2000
) -> DataFrame:
    """Timeline rows of one node from the full-timeline index ``offset`` on, within the byte budget."""
    _page_bounds(limit, offset)
    wire = event_rows(timeline_of(nodes, events, ref, kinds).where(F.col("event_index") >= offset), max_text)
    return fit_single_event(byte_budget_page(wire, [F.col("index")], limit=limit))


def show_state(nodes: DataFrame, events: DataFrame, ref: str, shown: DataFrame, kinds: list[str] | None = None, offset: int = 0, complete: bool = True) -> DataFrame:
    """Paging state of what ``show_session`` returned for the same arguments; ``total`` counts from ``offset`` on."""
    left = timeline_of(nodes, events, ref, kinds).where(F.col("event_index") >= offset)
    return paging_state(left, shown, offset, complete, index="index")


def show_totals(rolled: DataFrame) -> DataFrame:
    """Self, descendants and total tokens and cost of every node."""
    scopes = ["self", "desc", "total"]
    tokens = ["uncached_input", "output", "cache_write", "cache_read", "total"]
    return rolled.select(
        "ref",
        *[F.struct(*[F.col(f"{scope}_{name}").alias(name) for name in tokens]).alias(f"{scope}_tokens") for scope in scopes],
        *[cost_row(scope).alias(f"{scope}_cost") for scope in scopes],
    )


def read_record(events: DataFrame, index: int | None = None) -> DataFrame:
    """Exact source line of events with status ok, record_changed or record_unavailable.

    Every task opens the files of its events and reads the recorded range of each and nothing else. Events of
    one file are dealt by blocks of it, so a huge file is read by many tasks. A range that the file no longer
    holds, or that holds other bytes, has changed; an event without a range (a total) is unavailable.
    """
    if index is not None:
        events = events.where(F.col("event_index") == index)
    wanted = events.select("agent", "node_id", "event_index", "path", "byte_offset", "byte_length", "digest")
    dealt = wanted.repartition("path", offset_block()).sortWithinPartitions("path", "byte_offset")
    types = dict(wanted.dtypes)
    schema = ", ".join([f"{name} {types[name]}" for name in wanted.columns[:-1]] + ["status string", "raw_json string"])
    return dealt.mapInArrow(_read_ranges, schema)


def _read_ranges(batches):
    from pyarrow import fs

    for batch in batches:
        states, texts, opened, stream = [], [], None, None
        for path, at, size, digest in zip(*(batch.column(k).to_pylist() for k in range(3, 7))):
            if not path or at is None or at < 0 or not size or size < 0 or size > MAX_LINE_BYTES:
                states.append("record_unavailable")
                texts.append(None)
                continue
            if path != opened:
                system, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
                stream = system.open_input_file(inner) if system.get_file_info(inner).type == fs.FileType.File else None
                opened = path
            raw = b"" if stream is None or at + size > stream.size() else stream.read_at(size, at)
            text = raw.decode("utf-8", "replace")
            # The digest was taken of the line as it was decoded.
            same = raw != b"" and hashlib.sha256(text.encode()).hexdigest() == digest
            states.append("ok" if same else "record_changed")
            texts.append(text if same else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(states, pa.string()), pa.array(texts, pa.string())], [str(k) for k in range(8)])


def sink_json(rows: DataFrame, path: str, command: str) -> None:
    """Write versioned JSON rows; required fields are always present and arrays are never null."""
    filled = rows.withColumns(
        {
            field.name: F.coalesce(F.col(field.name), F.array().cast(field.dataType))
            for field in rows.schema.fields
            if field.dataType.typeName() == "array"
        }
    )
    stamped = filled.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(command).alias("command"), "*")
    stamped.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)
