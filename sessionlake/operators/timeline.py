"""Event timelines: blocks, tool pairing, usage placement, mirrored messages, event index."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.plans.blockfold import ROWS_PER_BLOCK, fold_blocks
from sessionlake.plans.running import Running, following, running
from sessionlake.plans.staging import stage
from sessionlake.sources import claude
from sessionlake.sources.records import USAGE_TYPE, cleaned, non_empty, text_or_empty, usage_total
from sessionlake.sources.scan import offset_block

# Fixed values.
KINDS = [
    "user", "assistant-text", "thinking", "tool-call", "tool-result", "subagent", "advisor", "system", "compact", "usage",
]
USAGE_TARGETS = ["assistant-text", "thinking", "tool-call", "advisor"]
MIRROR_WINDOW = 16
MINUS = "−"

EVENT_COLUMNS = [
    "agent", "node_id", "seq", "ts", "ts_raw", "kind", "text", "model", "call_id", "tool_name", "tool_input", "summary",
    "detail_input", "detail_diff", "detail_output", "has_detail", "duration_ms", "agent_id", "usage", "usage_aggregate", "harness",
    "compact_trigger", "compact_post_tokens", "spawn_names", "spawn_result", "spawn_run", "spawn_call", "path", "byte_offset", "byte_length", "digest",
]


def _defaults(frame: DataFrame) -> DataFrame:
    """Fill the event columns a branch does not set, in the canonical order."""
    empty = {
        "text": F.lit(""), "model": F.lit(""), "call_id": F.lit(""), "tool_name": F.lit(""), "tool_input": F.lit(""),
        "summary": F.lit(""), "detail_input": F.lit(""), "detail_diff": F.lit(""), "detail_output": F.lit(""),
        "has_detail": F.lit(False), "duration_ms": F.lit(0).cast("bigint"), "agent_id": F.lit(""),
        "usage": F.lit(None).cast(USAGE_TYPE), "usage_aggregate": F.lit(False), "harness": F.lit(False),
        "compact_trigger": F.lit(""), "compact_post_tokens": F.lit(0).cast("bigint"),
        "spawn_names": F.lit(None).cast("array<string>"), "spawn_result": F.lit(""), "spawn_run": F.lit(""),
        "spawn_call": F.lit(None).cast("bigint"),
    }
    missing = {name: value for name, value in empty.items() if name not in frame.columns}
    return frame.withColumns(missing).select(*EVENT_COLUMNS) if missing else frame.select(*EVENT_COLUMNS)


def pair_tool_result(calls: DataFrame, results: DataFrame, by: list[str], carried: list[str], block: Column) -> DataFrame:
    """As-of join: every result gets the latest earlier call with its key, as struct ``call``.

    ``calls`` and ``results`` share ``by`` and a unique ``seq``; ``carried`` names the call columns to
    hand over. ``call`` is null where no earlier call exists.
    """
    marked = calls.select(*by, "seq", F.struct("seq", *carried).alias("__call"))
    both = marked.unionByName(results.select(*by, "seq"), allowMissingColumns=True)
    known = running(both, by, [F.col("seq")], block, {"call": Running("last", F.col("__call"))})
    found = known.where("__call IS NULL").select(*by, "seq", "call")
    return results.join(found, [*by, "seq"])


def prompt_context(events: DataFrame, by: list[str], block: Column) -> DataFrame:
    """Add ``context`` to prompt rows: the context size of the next request before the next prompt.

    ``events`` needs ``seq``, ``is_prompt`` and ``request_context`` (null where the row carries no own
    request).
    """
    mark = F.when(F.col("is_prompt"), F.struct(F.lit(None).cast("bigint").alias("v"), F.lit(True).alias("stop"))).when(
        F.col("request_context").isNotNull(), F.struct(F.col("request_context").cast("bigint").alias("v"), F.lit(False).alias("stop"))
    )
    ahead = following(events, by, [F.col("seq")], block, "__ahead", mark)
    return ahead.withColumn("context", F.when(F.col("is_prompt"), F.coalesce(F.col("__ahead.v"), F.lit(0)))).drop("__ahead")


def request_target(events: DataFrame, by: list[str], block: Column) -> DataFrame:
    """Target of every token record: the first eligible row since the token record before it.

    ``events`` needs ``seq``, ``is_token`` and ``is_eligible``. Returns the token rows with ``target``,
    null where the segment has no eligible row.
    """
    counted = running(
        events, by, [F.col("seq")], block, {"segment": Running("sum", F.when(F.col("is_token"), 1).otherwise(0), inclusive=False)}
    ).withColumn("segment", F.coalesce("segment", F.lit(0)))
    heads = counted.groupBy(*by, "segment").agg(
        F.min(F.when(F.col("is_eligible"), F.col("seq"))).alias("target"),
        F.max(F.when(F.col("is_token"), F.col("seq"))).alias("seq"),
    )
    return heads.where("seq IS NOT NULL").select(*by, "seq", "target")


def event_index(events: DataFrame, block: Column | None = None) -> DataFrame:
    """Stable 0-based position in a node's full timeline, taken before any kind filter."""
    block = offset_block("seq") if block is None else block
    ranked = running(events, ["agent", "node_id"], [F.col("seq")], block, {"event_index": Running("sum", F.lit(1))})
    return ranked.withColumn("event_index", F.col("event_index") - 1)


# --- first transcript format -------------------------------------------------------------------


def _edit_fields(raw: Column) -> Column:
    return F.from_json(raw, "file_path STRING, old_string STRING, new_string STRING, content STRING, command STRING, "
                            "description STRING, offset INT, limit INT, edits ARRAY<STRUCT<old_string STRING, new_string STRING>>, "
                            "name STRING, subagent_type STRING")


def tool_input(name: Column, raw: Column, fields: Column | None = None) -> Column:
    """One-line summary of a tool invocation; ``fields`` is the input where it is parsed already."""
    fields = _edit_fields(raw) if fields is None else fields
    get = lambda key: fields.getField(key)
    size = lambda key: T.short_text_lines(text_or_empty(get(key))).cast("string")
    edit = F.concat(
        text_or_empty(get("file_path")), F.lit(" · +"), size("new_string"), F.lit(f" {MINUS}"), size("old_string")
    )
    picked = (
        F.when(name == "Edit", edit)
        .when(name.isin("Read", "Write"), get("file_path"))
        .when(name == "Bash", get("command"))
        .when(name.isin("Agent", "Task"), get("description"))
    )
    return F.coalesce(picked, T.collapse(text_or_empty(raw)))


def tool_detail(name: Column, raw: Column, fields: Column | None = None) -> tuple[Column, Column]:
    """Full input and diff of a tool invocation; edits become removed and added line blocks."""
    fields = _edit_fields(raw) if fields is None else fields
    get = lambda key: fields.getField(key)
    many = F.array_join(
        F.transform(
            get("edits"),
            lambda edit: T.replace_block(text_or_empty(edit["old_string"]), text_or_empty(edit["new_string"])),
        ),
        "\n\n",
    )
    diff = (
        F.when(name == "Edit", T.replace_block(text_or_empty(get("old_string")), text_or_empty(get("new_string"))))
        .when(name == "MultiEdit", many)
        .when(name == "Write", T.replace_block(F.lit(""), text_or_empty(get("content"))))
        .otherwise(F.lit(""))
    )
    read = F.concat_ws(
        " · ",
        text_or_empty(get("file_path")),
        F.concat(F.lit("offset "), get("offset").cast("string")),
        F.concat(F.lit("limit "), get("limit").cast("string")),
    )
    full = (
        F.when(name.isin("Edit", "MultiEdit", "Write", "Agent", "Task"), F.lit(""))
        .when(name == "Bash", text_or_empty(get("command")))
        .when(name == "Read", read)
        .otherwise(text_or_empty(raw))
    )
    return T.elide_encrypted(full), T.elide_encrypted(text_or_empty(diff))


def _variant_text(value: Column, join_only_text: bool) -> Column:
    """Result text of a polymorphic value: the string, its text blocks, or its JSON."""
    blocks = F.try_variant_get(value, "$", "array<struct<type string, text string>>")
    if join_only_text:
        blocks = F.filter(blocks, lambda block: block["type"] == "text")
    joined = F.array_join(F.transform(blocks, lambda block: text_or_empty(block["text"])), "\n")
    return text_or_empty(F.coalesce(joined, F.try_variant_get(value, "$", "string")))


def result_summary(tool: Column, text: Column, is_error: Column) -> Column:
    """``exit N``, ``error`` or ``exit 0`` for the shell tool, the collapsed text otherwise."""
    shell = F.coalesce(
        T.exit_summary(text, "Exit code "), F.when(is_error, F.lit("error")).otherwise(F.lit("exit 0"))
    )
    return F.when(tool == "Bash", shell).otherwise(text)


def claude_blocks(records: DataFrame) -> DataFrame:
    """One row per prompt, compaction and content block of the first format, in line and block order."""
    base = records.withColumns({"node_id": F.col("path"), "digest": F.sha2("line", 256)})
    common = ["agent", "node_id", "path", "byte_offset", "byte_length", "digest", "ts", "ts_raw"]
    compact = base.where("type = 'system' AND subtype = 'compact_boundary'").select(
        *common,
        F.col("byte_offset").alias("seq"),
        F.lit("compact").alias("kind"),
        T.elide_encrypted(F.col("notice")).alias("text"),
        text_or_empty(F.col("compact.trigger")).alias("compact_trigger"),
        F.coalesce("compact.postTokens", F.lit(0)).alias("compact_post_tokens"),
    )
    prompts = (
        base.where("type = 'user'")
        .withColumn("prompt", claude.user_text())
        .where("prompt <> ''")
        .select(
            *common,
            F.col("byte_offset").alias("seq"),
            F.lit("user").alias("kind"),
            T.elide_encrypted(F.col("prompt")).alias("text"),
            claude.harness_flag(F.col("prompt")).alias("harness"),
        )
    )
    exploded = base.where("type IN ('user', 'assistant')").select(
        *common, "type", "model", "message_id", "request_id", "tool_result_of", F.posexplode("blocks").alias("pos", "b")
    )
    by_assistant = F.col("type") == "assistant"
    kind = (
        F.when(by_assistant & (F.col("b.type") == "text"), "assistant-text")
        .when(by_assistant & (F.col("b.type") == "thinking"), "thinking")
        .when(by_assistant & (F.col("b.type") == "tool_use"), F.when(F.col("b.name").isin(claude.SPAWN_TOOLS), "subagent").otherwise("tool-call"))
        .when(F.col("b.type") == "tool_result", "tool-result")
        .when(by_assistant & (F.col("b.type") == "server_tool_use") & (F.col("b.name") == "advisor"), "advisor")
    )
    name = text_or_empty(F.col("b.name"))
    is_call = F.col("kind").isin("tool-call", "subagent")
    full, diff = tool_detail(name, F.col("b.input"), F.col("fields"))
    text = (
        F.when(F.col("kind") == "assistant-text", T.elide_encrypted(cleaned(F.col("b.text"))))
        .when(F.col("kind") == "thinking", T.elide_encrypted(text_or_empty(F.col("b.thinking"))))
        .when(F.col("kind") == "tool-result", T.collapse(_raw_text(F.col("b.content"))))
        .otherwise(F.lit(""))
    )
    blocks = (
        exploded.withColumn("kind", kind)
        .where("kind IS NOT NULL")
        .withColumn("fields", F.when(is_call, _edit_fields(F.col("b.input"))))  # parsed once, read by name below
        .select(
            *common,
            (F.col("byte_offset") + F.col("pos") + 1).alias("seq"),
            "kind",
            text.alias("text"),
            "model",
            text_or_empty(F.when(F.col("kind") == "tool-result", F.col("b.tool_use_id")).otherwise(F.col("b.id"))).alias("call_id"),
            F.when(is_call | (F.col("kind") == "advisor"), name).otherwise(F.lit("")).alias("tool_name"),
            F.when(is_call, T.elide_encrypted(tool_input(name, F.col("b.input"), F.col("fields")))).otherwise(F.lit("")).alias("tool_input"),
            F.when(is_call, full).otherwise(F.lit("")).alias("detail_input"),
            F.when(is_call, diff).otherwise(F.lit("")).alias("detail_diff"),
            (is_call & ~name.isin("Agent", "Task")).alias("has_detail"),
            F.when(F.col("kind") == "tool-result", T.elide_encrypted(_variant_text(F.col("b.content"), True))).alias("result_text"),
            F.coalesce("b.is_error", F.lit(False)).alias("result_error"),
            text_or_empty(F.col("tool_result_of.agentId")).alias("result_agent"),
            text_or_empty(F.col("tool_result_of.runId")).alias("result_run"),
            F.when(F.col("kind") == "subagent", spawn_names(F.col("fields"))).alias("spawn_names"),
            "message_id",
            "request_id",
        )
        .where("text <> '' OR kind IN ('tool-call', 'tool-result', 'subagent', 'advisor')")
    )
    return blocks.unionByName(prompts, allowMissingColumns=True).unionByName(compact, allowMissingColumns=True)


def _raw_text(value: Column) -> Column:
    return text_or_empty(F.try_variant_get(value, "$", "string"))


def spawn_names(fields: Column) -> Column:
    return F.array(*[text_or_empty(fields.getField(key)) for key in ("name", "description", "subagent_type")])


def _usage_lines(lines: DataFrame) -> DataFrame:
    """Assistant lines that report billable usage, for the timeline."""
    blank = F.lit("")
    usage = claude.claude_usage(F.col("model"), F.col("tokens"), blank, F.lit(None))
    return (
        lines.where((F.col("type") == "assistant") & ~F.col("model").isin("", claude.SYNTHETIC_MODEL) & F.col("tokens").isNotNull())
        .withColumn("usage", usage)
        .where(claude.is_valid_usage(F.col("usage")))
        .withColumn("total", usage_total(F.col("usage")))
        .where("total > 0")
        .select("agent", F.col("path").alias("node_id"), "byte_offset", "message_id", "request_id", "usage", "total")
    )


def head_event_usage(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Usage of each request on the first event its lines produced: ``(agent, node_id, seq, usage)``.

    The largest report at or after that event's line counts; only a strictly larger one replaces.
    """
    by = ["agent", "node_id"]
    firsts = blocks.where("kind NOT IN ('user', 'compact')").groupBy(*by, "byte_offset").agg(F.min("seq").alias("first_seq"))
    reports = lines.join(firsts, [*by, "byte_offset"], "left")
    loose = reports.where("message_id = '' AND first_seq IS NOT NULL").select(*by, F.col("first_seq").alias("seq"), "usage")
    key = [*by, "message_id", "request_id"]
    named = reports.where("message_id <> ''")
    heads = named.groupBy(*key).agg(
        F.min(F.when(F.col("first_seq").isNotNull(), F.struct("byte_offset", "first_seq"))).alias("head")
    ).where("head IS NOT NULL")
    largest = (
        named.join(heads, key)
        .where(F.col("byte_offset") >= F.col("head.byte_offset"))
        .groupBy(*key)
        .agg(F.max_by("usage", F.struct("total", -F.col("byte_offset"))).alias("usage"), F.min("head.first_seq").alias("seq"))
    )
    return largest.select(*by, "seq", "usage").unionByName(loose)


def advisor_usage(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Usage of the nth advisor row of a message: the nth advisor step of its fullest report."""
    by = ["agent", "node_id"]
    calls = blocks.where("kind IN ('advisor', 'tool-call', 'subagent')").groupBy(*by, "call_id").agg(F.min("seq").alias("first_seq"))
    rows = (
        blocks.where("kind = 'advisor'")
        .select(*by, "seq", "call_id", "message_id")
        .join(calls, [*by, "call_id"])
        .where("seq = first_seq")
        .select(*by, "seq", "message_id")
    )
    nth = running(rows, [*by, "message_id"], [F.col("seq")], offset_block("seq"), {"nth": Running("sum", F.lit(1))})
    steps = (
        lines.where("type = 'assistant'")
        .select("agent", F.col("path").alias("node_id"), "message_id", "byte_offset", claude.advisor_usages(F.col("tokens")).alias("steps"))
        .where("size(steps) > 0")
        .groupBy(*by, "message_id")
        .agg(F.max_by("steps", F.struct(F.size("steps"), -F.col("byte_offset"))).alias("steps"))
    )
    return nth.join(steps, [*by, "message_id"], "left").select(
        *by, "seq", F.get("steps", (F.col("nth") - 1).cast("int")).alias("advisor_usage")
    )


def claude_events(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Timeline of the first format, one row per event, without its index.

    ``records`` carries the contents, ``lines`` is the narrow staged table of the same records.
    """
    by = ["agent", "node_id"]
    blocks = stage(claude_blocks(records), "blocks")
    advisors = advisor_usage(blocks, lines)
    calls = blocks.where("kind IN ('tool-call', 'subagent', 'advisor')").select(
        *by, "call_id", "seq", "tool_name", "ts", "has_detail"
    )
    results = blocks.where("kind = 'tool-result'").select(
        *by, "call_id", "seq", "ts", "text", "result_text", "result_error", "result_agent", "result_run"
    )
    paired = pair_tool_result(calls, results, [*by, "call_id"], ["tool_name", "ts", "has_detail"], offset_block("seq"))
    paired = paired.withColumn(
        "shown",
        T.elide_encrypted(F.when(F.col("call").isNull(), F.col("text")).otherwise(
            result_summary(F.col("call.tool_name"), F.col("text"), F.col("result_error"))
        )),
    )
    paired = stage(paired, "paired")
    elapsed = F.floor((F.unix_micros("ts") - F.unix_micros("call.ts")) / 1000)
    answered = (
        paired.where("call IS NOT NULL")
        .groupBy(*by, F.col("call.seq").alias("seq"))
        .agg(
            F.max_by("shown", "seq").alias("answer"),
            F.max_by("result_text", F.when(F.col("call.has_detail") & (F.col("call_id") != ""), F.col("seq"))).alias("answer_output"),
            F.max_by(elapsed, F.when(elapsed >= 0, F.col("seq"))).alias("answer_ms"),
        )
    )
    heads = head_event_usage(blocks, _usage_lines(lines))
    joined = (
        blocks.join(heads, [*by, "seq"], "left")
        .join(advisors, [*by, "seq"], "left")
        .join(paired.select(*by, "seq", "shown", F.col("call.seq").alias("spawn_call")), [*by, "seq"], "left")
        .join(answered, [*by, "seq"], "left")
        .join(advisors.select(*by, "seq").withColumn("kept", F.lit(True)), [*by, "seq"], "left")
        .where("kind <> 'advisor' OR kept")
    )
    out = joined.withColumns(
        {
            "text": F.coalesce("shown", "text"),
            "model": text_or_empty(F.coalesce(F.col("advisor_usage.model"), F.col("model"))),
            "usage": F.coalesce("advisor_usage", "usage"),
            "summary": text_or_empty(F.col("answer")),
            "detail_output": text_or_empty(F.col("answer_output")),
            "duration_ms": F.coalesce("answer_ms", F.lit(0)),
            "spawn_result": text_or_empty(F.col("result_agent")),
            "spawn_run": text_or_empty(F.col("result_run")),
            "agent_id": F.lit(""),
            "usage_aggregate": F.lit(False),
            "harness": F.coalesce("harness", F.lit(False)),
            "compact_trigger": text_or_empty(F.col("compact_trigger")),
            "compact_post_tokens": F.coalesce("compact_post_tokens", F.lit(0)),
            "has_detail": F.coalesce("has_detail", F.lit(False)),
        }
        | {name: text_or_empty(F.col(name)) for name in ("call_id", "tool_name", "tool_input", "detail_input", "detail_diff")}
    )
    return _defaults(out)


# --- second transcript format ------------------------------------------------------------------


def codex_event_kind(is_subagent: Column) -> Column:
    """Event kind of a line: from its type, item, role and delegated-message prefix."""
    response = F.col("type") == "response_item"
    posted = F.col("type") == "event_msg"
    delegated = F.startswith("body", F.lit("Message Type:"))
    message = F.col("item").isin("message", "agent_message")
    return (
        F.when(posted & (F.col("item") == "user_message"), "user")
        .when(posted & (F.col("item") == "agent_message"), "assistant-text")
        .when(posted & (F.col("item") == "context_compacted"), "compact")
        .when(posted & (F.col("item") == "token_count"), "token")
        .when(response & message & delegated, F.when(is_subagent, "user"))
        .when(response & message & (F.col("role") == "user"), "user")
        .when(response & message & ((F.col("role") == "assistant") | (F.col("item") == "agent_message")), "assistant-text")
        .when(response & (F.col("item") == "reasoning"), "thinking")
        .when(response & F.col("item").isin("function_call", "custom_tool_call"), "tool-call")
        .when(response & F.col("item").isin("function_call_output", "custom_tool_call_output"), "tool-result")
    )


def _joined_text(raw: Column) -> Column:
    blocks = F.from_json(raw, "ARRAY<STRUCT<text STRING>>")
    return T.strip(text_or_empty(F.array_join(F.transform(blocks, lambda block: text_or_empty(block["text"])), "\n")))


def _delegated_payload(body: Column) -> Column:
    marker = "\nPayload:\n"
    at = F.instr(body, marker)
    return F.when(at > 0, T.strip(F.substr(body, at + len(marker)))).otherwise(body)


def _call_fields(raw: Column) -> Column:
    return F.from_json(raw, "cmd STRING, path STRING")


def codex_tool_input(name: Column, raw: Column, fields: Column | None = None, nested: Column | None = None) -> Column:
    """One-line summary of a tool invocation of the second format; ``fields`` and ``nested`` where they are known already."""
    added, removed = T.patch_line_counts(raw)
    patch = F.concat(F.lit("+"), added.cast("string"), F.lit(f" {MINUS}"), removed.cast("string"))
    fields = _call_fields(raw) if fields is None else fields
    nested = T.nested_tools(raw) if nested is None else nested
    picked = (
        F.when(name == "exec_command", fields.getField("cmd"))
        .when(name.isin("view_image", "Read", "Edit", "Write"), fields.getField("path"))
    )
    return (
        F.when(name == "apply_patch", patch)
        .when((name == "exec") & F.exists(nested, lambda tool: tool != "exec_command"), F.lit(""))
        .when((name == "exec") & (F.size(nested) > 1), F.lit(""))
        .otherwise(F.coalesce(picked, T.collapse(raw)))
    )


def codex_tool_detail(name: Column, raw: Column, fields: Column | None = None) -> tuple[Column, Column]:
    fields = _call_fields(raw) if fields is None else fields
    full = F.when(name == "apply_patch", F.lit("")).when(
        name == "exec_command", F.coalesce(fields.getField("cmd"), raw)
    ).otherwise(raw)
    return full, F.when(name == "apply_patch", raw).otherwise(F.lit(""))


def _fold_mirrors(rows: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str]:
    """Slot of every row: its own ``seq``, or that of the earlier copy it repeats.

    A message repeats when one of the last 16 kept rows has its kind and text. A token record with
    usage and no row to attach it to keeps a row of its own.
    """
    held = json.loads(state) if state else {"recent": [], "candidate": False}
    recent, candidate = held["recent"], held["candidate"]
    slots = []
    for seq, role, key, billed in zip(rows["seq"], rows["role"], rows["key"], rows["billed"]):
        slot = int(seq)
        if role == "token":
            keeps = bool(billed) and not candidate
            candidate = False
        else:
            keeps = True
            if key:
                for held_key, held_seq in reversed(recent):
                    if held_key == key:
                        slot, keeps = held_seq, False
                        break
            if keeps and role == "target":
                candidate = True
        if keeps:
            recent = [*recent, [key if key and role != "token" else "", int(seq)]][-MIRROR_WINDOW:]
        slots.append(slot)
    return pd.DataFrame({"slot": slots}), json.dumps({"recent": recent, "candidate": candidate})


def mirror_dedup(rows: DataFrame, by: list[str], block: Column, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``slot`` to every row; a row whose slot is another row's ``seq`` is a mirrored copy.

    ``rows`` needs ``seq``, ``role`` (token, target or other), ``key`` (kind and text digest of a message,
    empty otherwise) and ``billed``. Only these narrow columns reach Python.
    """
    narrow = rows.select(*by, "seq", "role", "key", "billed")
    return fold_blocks(narrow, by, "seq", block, _fold_mirrors, "slot bigint", rows_per_block)


def bridge_cut(records: DataFrame, meta: DataFrame) -> DataFrame:
    """``cut`` of each sub-agent file: offset of its first bridge record. Files without one have no row."""
    by = ["agent", "path"]
    marked = records.where("type = 'session_meta' AND thread_source = 'subagent'").groupBy(*by).agg(F.min("byte_offset").alias("from_meta"))
    named = meta.where("agent_path <> ''").select(*by, F.lit(-1).cast("bigint").alias("from_path"))
    waits = marked.join(named, by, "full").select(*by, F.coalesce("from_path", "from_meta").alias("waits_from"))
    bridges = records.where("type = 'inter_agent_communication_metadata'").select(*by, "byte_offset")
    return (
        bridges.join(waits, by)
        .where(F.col("byte_offset") > F.col("waits_from"))
        .groupBy(*by)
        .agg(F.min("byte_offset").alias("cut"))
    )


def codex_events(records: DataFrame, state: DataFrame, meta: DataFrame, requests: DataFrame, summaries: DataFrame) -> DataFrame:
    """Timeline of the second format, one row per event, without its index."""
    by = ["agent", "path"]
    node = ["agent", "node_id"]
    cuts = bridge_cut(records, meta)
    subagents = (
        records.where("type = 'session_meta' AND thread_source = 'subagent'").groupBy(*by).agg(F.min("byte_offset").alias("sub_from"))
        .join(meta.where("agent_path <> ''").select(*by, F.lit(True).alias("by_path")), by, "full")
    )
    lines = (
        records.where("type IN ('event_msg', 'response_item')")
        .join(state.select(*by, "byte_offset", "line_model"), [*by, "byte_offset"])
        .join(cuts, by, "left")
        .join(subagents, by, "left")
    )
    is_subagent = F.coalesce("by_path", F.lit(False)) | F.coalesce(F.col("byte_offset") > F.col("sub_from"), F.lit(False))
    posted = F.col("type") == "event_msg"
    raw_call = F.when(F.col("arguments") != "", F.col("arguments")).otherwise(F.col("input"))
    lines = (
        lines.withColumn("body", F.when(posted, F.col("message")).otherwise(_joined_text(F.col("content"))))
        .withColumn("kind", codex_event_kind(is_subagent))
        .where("kind IS NOT NULL")
        .withColumn("call_raw", F.when(F.col("kind") == "tool-call", T.elide_encrypted(raw_call)))
        # Parsed once, read by name below.
        .withColumns({"call_fields": _call_fields(F.col("call_raw")), "nested": F.when(F.col("name") == "exec", T.nested_tools(F.col("call_raw")))})
    )
    nested = F.col("nested")
    tool = F.when((F.col("name") == "exec") & (F.size(nested) == 1), nested[0]).otherwise(F.col("name"))
    delegated = ~posted & F.startswith("body", F.lit("Message Type:"))
    text = (
        F.when(F.col("kind") == "user", T.prompt_task_text(F.when(delegated, _delegated_payload(F.col("body"))).otherwise(F.col("body"))))
        .when(F.col("kind") == "assistant-text", F.col("body"))
        .when(F.col("kind") == "thinking", _joined_text(F.col("summary")))
        .when(F.col("kind") == "compact", F.lit("context compacted"))
        .otherwise(F.lit(""))
    )
    full, diff = codex_tool_detail(F.col("name"), F.col("call_raw"), F.col("call_fields"))
    is_call = F.col("kind") == "tool-call"
    message = F.col("kind").isin("user", "assistant-text")
    rows = lines.withColumn("plain", text).withColumn("clean", F.when(message, T.clean_timeline_text(F.col("plain"))).otherwise(F.col("plain")))
    rows = rows.select(
        "agent",
        F.col("path").alias("node_id"),
        "path",
        "byte_offset",
        "byte_length",
        F.sha2("line", 256).alias("digest"),
        (F.col("byte_offset") + 1).alias("seq"),
        "ts",
        "ts_raw",
        "kind",
        T.elide_encrypted(F.col("clean")).alias("text"),
        F.when(message, F.sha2(F.concat_ws("\0", F.col("kind"), F.col("clean")), 256)).otherwise(F.lit("")).alias("key"),
        F.col("line_model").alias("model"),
        F.when(F.col("kind").isin("tool-call", "tool-result"), F.col("call_id")).otherwise(F.lit("")).alias("call_id"),
        F.when(is_call, tool).otherwise(F.lit("")).alias("tool_name"),
        F.when(is_call, codex_tool_input(F.col("name"), F.col("call_raw"), F.col("call_fields"), nested)).otherwise(F.lit("")).alias("tool_input"),
        F.when(is_call, full).otherwise(F.lit("")).alias("detail_input"),
        F.when(is_call, diff).otherwise(F.lit("")).alias("detail_diff"),
        is_call.alias("has_detail"),
        F.when(is_call, F.col("name").isin("exec", "wait")).alias("has_header"),
        F.when(F.col("kind") == "tool-result", T.elide_encrypted(_variant_text(F.col("output"), False))).alias("result_text"),
        (~posted).alias("preferred"),
        ((F.col("kind") == "user") & ~posted).alias("harness"),
        "cut",
    ).where("kind NOT IN ('user', 'assistant-text', 'thinking') OR text <> ''")
    rows = stage(rows, "lines")
    after = F.col("cut").isNull() | (F.col("byte_offset") > F.col("cut"))
    live = rows.where(after)
    billed = requests.where("NOT is_aggregate").select(*node, "byte_offset", "usage_struct")

    # Mirrored copies, with the token records that would add rows of their own.
    role = F.when(F.col("kind") == "token", "token").when(F.col("kind").isin(USAGE_TARGETS), "target").otherwise("other")
    spotted = live.join(billed.select(*node, "byte_offset").withColumn("billed", F.lit(True)), [*node, "byte_offset"], "left")
    counted = spotted.select(*node, "seq", role.alias("role"), "key", F.coalesce("billed", F.lit(False)).alias("billed"))
    activity = activity_events(records, summaries, cuts)
    counted = counted.unionByName(
        activity.where("node_id = path").select(
            *node, "seq", F.lit("other").alias("role"), F.lit("").alias("key"), F.lit(False).alias("billed")
        )
    )
    slots = stage(mirror_dedup(counted, node, offset_block("seq")), "slots")
    placed = live.join(slots, [*node, "seq"])
    shown = F.struct(*[name for name in live.columns if name not in ("agent", "node_id", "seq", "harness")])
    lead = F.col("preferred") | (F.col("seq") == F.col("slot"))
    merged = (
        placed.where("kind IN ('user', 'assistant-text')")
        .groupBy(*node, F.col("slot").alias("seq"))
        .agg(
            F.max_by(shown, F.when(lead, F.col("seq"))).alias("shown"),
            F.bool_and(F.when(lead, F.col("harness"))).alias("harness"),
        )
        .select(*node, "seq", "shown.*", "harness")
    )
    others = placed.where("kind NOT IN ('user', 'assistant-text', 'token')").select(*merged.columns)
    events = stage(merged.unionByName(others), "merged")

    # Usage goes to the first eligible row of its segment, else to a row of its own.
    segments = events.select(*node, "seq", F.lit(False).alias("is_token"), F.col("kind").isin(USAGE_TARGETS).alias("is_eligible")).unionByName(
        placed.where("kind = 'token'").select(*node, "seq", F.lit(True).alias("is_token"), F.lit(False).alias("is_eligible"))
    )
    targets = request_target(segments, node, offset_block("seq"))
    spent = placed.where("kind = 'token'").join(billed, [*node, "byte_offset"]).join(targets, [*node, "seq"], "left")
    attached = spent.where("target IS NOT NULL").select(*node, F.col("target").alias("seq"), F.col("usage_struct").alias("usage"))
    unattached = spent.where("target IS NULL")
    early = rows.where("kind = 'token' AND cut IS NOT NULL AND byte_offset < cut").join(billed, [*node, "byte_offset"])
    explicit = unattached.select(*early.columns).unionByName(early)
    explicit = explicit.withColumns(
        {"kind": F.lit("usage"), "text": F.lit("unattributed usage"), "model": F.col("usage_struct.model"), "usage": F.col("usage_struct")}
    )
    latest = summaries.select("agent", F.col("path").alias("node_id"), "updated_at", "updated_raw")
    aggregates = requests.where("is_aggregate").join(latest, node).select(
        *node,
        F.col("node_id").alias("path"),
        # After every line, in ledger order.
        (F.lit(1 << 62) - F.col("byte_offset")).alias("seq"),
        F.col("updated_at").alias("ts"),
        F.col("updated_raw").alias("ts_raw"),
        F.lit("usage").alias("kind"),
        F.lit("session usage").alias("text"),
        F.col("usage_struct.model").alias("model"),
        F.col("usage_struct").alias("usage"),
        F.lit(True).alias("usage_aggregate"),
        F.lit(None).cast("bigint").alias("byte_offset"),
        F.lit(None).cast("int").alias("byte_length"),
        F.lit(None).cast("string").alias("digest"),
    )

    # Results attach to the latest earlier call of their id.
    calls = events.where("kind = 'tool-call'").select(*node, "call_id", "seq", "tool_name", "detail_diff", "has_header", "ts")
    results = events.where("kind = 'tool-result'").select(*node, "call_id", "seq", "ts", "result_text")
    paired = pair_tool_result(calls, results, [*node, "call_id"], ["tool_name", "detail_diff", "has_header", "ts"], offset_block("seq"))
    body, code = T.split_exec_preamble(F.col("result_text"))
    headed = F.coalesce(F.col("call.has_header"), F.lit(False))
    paired = paired.withColumns({"output": F.when(headed, body).otherwise(F.col("result_text")), "code": F.when(headed, code)})
    plain = F.coalesce(
        F.concat(F.lit("exit "), F.col("code")), T.exit_summary(F.col("output"), "Process exited with code "), T.collapse(F.col("output"))
    )
    files = F.when(F.col("call.tool_name") == "apply_patch", T.patch_files(F.col("call.detail_diff")))
    paired = paired.withColumn("shown", T.elide_encrypted(F.when(F.size(files) > 0, F.array_join(files, ", ")).otherwise(plain)))
    paired = stage(paired, "paired")
    elapsed = F.floor((F.unix_micros("ts") - F.unix_micros("call.ts")) / 1000)
    answered = (
        paired.where("call IS NOT NULL")
        .groupBy(*node, F.col("call.seq").alias("seq"))
        .agg(
            F.max_by("shown", "seq").alias("answer"),
            F.max_by("output", F.when(F.col("call_id") != "", F.col("seq"))).alias("answer_output"),
            F.max_by(elapsed, F.when(elapsed >= 0, F.col("seq"))).alias("answer_ms"),
        )
    )
    joined = (
        events.join(attached, [*node, "seq"], "left")
        .join(paired.select(*node, "seq", F.col("shown").alias("result")), [*node, "seq"], "left")
        .join(answered, [*node, "seq"], "left")
        .withColumns(
            {
                "text": F.coalesce("result", "text"),
                "summary": text_or_empty(F.col("answer")),
                "detail_output": text_or_empty(F.col("answer_output")),
                "duration_ms": F.coalesce("answer_ms", F.lit(0)),
                "harness": F.coalesce("harness", F.lit(False)),
            }
        )
    )
    lean = ["agent", "node_id", "path", "seq", "ts", "ts_raw", "kind", "text", "model", "usage", "byte_offset", "byte_length", "digest"]
    return (
        _defaults(joined)
        .unionByName(_defaults(explicit.select(*lean)))
        .unionByName(_defaults(aggregates))
        .unionByName(_defaults(activity))
    )


def activity_events(records: DataFrame, summaries: DataFrame, cuts: DataFrame) -> DataFrame:
    """Sub-agent starts on their parent's timeline, other activity on the child's own placeholder."""
    from sessionlake.sources.codex import agent_path_parts

    by = ["agent", "path"]
    base = F.coalesce(agent_path_parts(non_empty(F.col("own_path"))), F.array().cast("array<string>"))
    rows = (
        records.where("type = 'event_msg' AND item = 'sub_agent_activity'")
        .join(summaries.select(*by, F.col("agent_path").alias("own_path")), by)
        .join(cuts, by, "left")
        .where("cut IS NULL OR byte_offset > cut")
        .withColumn("base", base)
        .withColumn("full", agent_path_parts(F.col("agent_path")))
        .where("size(full) > size(base) AND slice(full, 1, size(base)) = base")
        .withColumn("parts", F.expr("slice(full, size(base) + 1, size(full))"))
    )
    started = F.col("kind") == "started"
    above = F.expr("slice(parts, 1, size(parts) - 1)")
    seat = lambda parts: F.concat(F.col("path"), F.lit("#"), F.array_join(parts, "/"))
    holder = F.when(started & (F.size("parts") == 1), F.col("path")).when(started, seat(above)).otherwise(seat(F.col("parts")))
    return rows.select(
        "agent",
        holder.alias("node_id"),
        "path",
        "byte_offset",
        "byte_length",
        F.sha2("line", 256).alias("digest"),
        (F.col("byte_offset") + 1).alias("seq"),
        "ts",
        "ts_raw",
        F.when(started, F.lit("subagent")).otherwise(F.lit("system")).alias("kind"),
        F.when(started, F.lit("")).otherwise(F.col("kind")).alias("text"),
        F.col("agent_thread_id").alias("agent_id"),
    )
