"""Record projection of the first transcript format: one envelope per line, content blocks inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.sources.records import (
    REQUEST_COLUMNS,
    cleaned,
    first_known,
    non_empty,
    number_or_zero,
    parse_lines,
    text_or_empty,
    timestamp_of,
    usage_total,
)

# Fixed values.
SYNTHETIC_MODEL = "<synthetic>"
ADVISOR_STEP = "advisor_message"
TITLE_PROMPT_BYTES = 16 << 10
TITLE_PROMPT_LINES = 128
HARNESS_PREFIXES = [
    "<command-name>",
    "<command-message>",
    "<local-command-stdout>",
    "<bash-input>",
    "<bash-stdout>",
    "<bash-stderr>",
    "[Request interrupted by user",
]
SPAWN_TOOLS = ["Agent", "Task", "Workflow"]

_TOKENS = (
    "input_tokens BIGINT, output_tokens BIGINT, cache_creation_input_tokens BIGINT, cache_read_input_tokens BIGINT, "
    "cache_creation STRUCT<ephemeral_1h_input_tokens BIGINT, ephemeral_5m_input_tokens BIGINT>"
)
_ENVELOPE = (
    "type STRING, subtype STRING, content STRING, timestamp STRING, sessionId STRING, agentId STRING, cwd STRING, "
    "gitBranch STRING, requestId STRING, isSidechain BOOLEAN, speed STRING, costUSD DOUBLE, aiTitle STRING, "
    "toolUseResult STRING, error STRING, apiErrorStatus STRING, isApiErrorMessage BOOLEAN, "
    "compactMetadata STRUCT<trigger STRING, postTokens BIGINT>, "
    "message STRUCT<id STRING, model STRING, content STRING, usage STRUCT<" + _TOKENS + ", "
    "iterations ARRAY<STRUCT<type STRING, model STRING, " + _TOKENS + ">>>>, _corrupt_record STRING"
)
_BLOCKS = (
    "message STRUCT<content ARRAY<STRUCT<type STRING, text STRING, thinking STRING, id STRING, name STRING, "
    "input STRING, tool_use_id STRING, content VARIANT, is_error BOOLEAN>>>"
)
_MARKERS = "isMeta BOOLEAN, isCompactSummary BOOLEAN, promptSource STRING, origin STRING"
_RESULT = "agentId STRING, runId STRING, workflowName STRING"


def claude_records(raw: DataFrame) -> DataFrame:
    """Typed columns of every readable line; unknown fields are ignored."""
    parsed = parse_lines(raw, _ENVELOPE)
    blocks = F.when(
        F.col("r.type").isin("user", "assistant"), F.from_json("line", _BLOCKS).getField("message").getField("content")
    )
    return parsed.select(
        "agent",
        "path",
        "byte_offset",
        "byte_length",
        "line",
        text_or_empty(F.col("r.type")).alias("type"),
        text_or_empty(F.col("r.subtype")).alias("subtype"),
        text_or_empty(F.col("r.content")).alias("notice"),
        text_or_empty(F.col("r.timestamp")).alias("ts_raw"),
        timestamp_of(F.col("r.timestamp")).alias("ts"),
        text_or_empty(F.col("r.sessionId")).alias("session_id"),
        text_or_empty(F.col("r.agentId")).alias("agent_id"),
        text_or_empty(F.col("r.cwd")).alias("cwd"),
        text_or_empty(F.col("r.gitBranch")).alias("git_branch"),
        text_or_empty(F.col("r.requestId")).alias("request_id"),
        F.coalesce(F.col("r.isSidechain"), F.lit(False)).alias("is_sidechain"),
        text_or_empty(F.col("r.speed")).alias("speed"),
        F.col("r.costUSD").alias("cost_usd"),
        text_or_empty(F.col("r.aiTitle")).alias("ai_title"),
        F.from_json("r.toolUseResult", _RESULT).alias("tool_result_of"),
        has_error(F.col("r")).alias("is_error"),
        F.col("r.compactMetadata").alias("compact"),
        text_or_empty(F.col("r.message.id")).alias("message_id"),
        text_or_empty(F.col("r.message.model")).alias("model"),
        F.col("r.message.content").alias("content"),
        blocks.alias("blocks"),
        F.col("r.message.usage").alias("tokens"),
        F.contains("line", F.lit('"usage"')).alias("has_usage"),
    )


def has_error(record: Column) -> Column:
    """An assistant record that carries an API error marker."""

    def meaningful(name: str) -> Column:
        value = F.trim(record.getField(name))
        return value.isNotNull() & ~value.isin("", "null", "false", "0")

    marked = F.coalesce(record.getField("isApiErrorMessage"), F.lit(False))
    return (record.getField("type") == "assistant") & (marked | meaningful("error") | meaningful("apiErrorStatus"))


def claude_usage(model: Column, tokens: Column, speed: Column, cost_usd: Column) -> Column:
    """Usage struct of a token report; a structured cache write replaces the flat counter."""
    made = tokens.getField("cache_creation")
    return F.struct(
        model.alias("model"),
        number_or_zero(tokens.getField("input_tokens")).alias("input"),
        number_or_zero(tokens.getField("output_tokens")).alias("output"),
        number_or_zero(
            F.when(made.isNotNull(), made.getField("ephemeral_5m_input_tokens")).otherwise(
                tokens.getField("cache_creation_input_tokens")
            )
        ).alias("write_5m"),
        number_or_zero(made.getField("ephemeral_1h_input_tokens")).alias("write_1h"),
        number_or_zero(tokens.getField("cache_read_input_tokens")).alias("cache_read"),
        F.lit(False).alias("includes_cache_read"),
        speed.alias("speed"),
        cost_usd.cast("double").alias("cost_usd"),
    )


def is_valid_usage(usage: Column) -> Column:
    ok = F.lit(True)
    for name in ["input", "output", "write_5m", "write_1h", "cache_read"]:
        ok = ok & (usage.getField(name) >= 0)
    usd = usage.getField("cost_usd")
    return ok & (usd.isNull() | ((usd >= 0) & ~F.isnan(usd) & (usd != float("inf"))))


def advisor_usages(tokens: Column) -> Column:
    """Valid advisor steps of one request, each billed on its own model."""
    steps = F.filter(
        F.coalesce(tokens.getField("iterations"), F.array()),
        lambda step: (step.getField("type") == ADVISOR_STEP) & (text_or_empty(step.getField("model")) != ""),
    )
    usages = F.transform(
        steps, lambda step: claude_usage(step.getField("model"), step, F.lit(""), F.lit(None))
    )
    return F.filter(usages, lambda usage: is_valid_usage(usage) & (usage_total(usage) > 0))


def claude_requests(records: DataFrame) -> DataFrame:
    """Billed request reports of every assistant line, advisor steps as requests of their own."""
    billed = (
        records.where(
            (F.col("type") == "assistant") & F.col("has_usage") & ~F.col("model").isin("", SYNTHETIC_MODEL)
        )
        .withColumn("usage", claude_usage(F.col("model"), F.col("tokens"), F.col("speed"), F.col("cost_usd")))
        .where(is_valid_usage(F.col("usage")))
    )
    own = F.array(F.struct(F.col("message_id").alias("id"), F.col("usage").alias("usage")))
    steps = F.transform(
        advisor_usages(F.col("tokens")),
        lambda usage, at: F.struct(
            F.concat(F.col("message_id"), F.lit("\0advisor\0"), at.cast("string")).alias("id"), usage.alias("usage")
        ),
    )
    rows = billed.select(
        "agent",
        F.col("path").alias("node_id"),
        "request_id",
        "byte_offset",
        "is_sidechain",
        F.lit(False).alias("is_aggregate"),
        F.posexplode(F.concat(own, steps)).alias("ordinal", "item"),
    )
    return rows.select("*", F.col("item.id").alias("message_id"), "item.usage.*").select(*REQUEST_COLUMNS)


def user_text() -> Column:
    """Prompt text of a user record: the string, or its text blocks joined by newlines."""
    parts = F.transform(
        F.filter(F.col("blocks"), lambda block: block.getField("type") == "text"),
        lambda block: cleaned(block.getField("text")),
    )
    joined = F.array_join(F.filter(parts, lambda part: part != ""), "\n")
    text = F.when(F.col("blocks").isNotNull(), joined).otherwise(cleaned(F.col("content")))
    return F.when(F.col("type") == "user", text).otherwise(F.lit(""))


def assistant_text_blocks() -> Column:
    shown = F.filter(
        F.col("blocks"),
        lambda block: (block.getField("type") == "text") & (cleaned(block.getField("text")) != ""),
    )
    return F.when((F.col("type") == "assistant") & F.col("blocks").isNotNull(), F.size(shown)).otherwise(0)


def harness_flag(text: Column) -> Column:
    """Was a user turn injected by the harness rather than typed by a person?"""
    marks = F.from_json("line", _MARKERS)
    origin = F.from_json(marks.getField("origin"), "kind STRING, _corrupt_record STRING")
    injected = (
        F.coalesce(marks.getField("isMeta"), F.lit(False))
        | F.coalesce(marks.getField("isCompactSummary"), F.lit(False))
        | (text_or_empty(marks.getField("promptSource")) == "system")
    )
    known_origin = marks.getField("origin").isNotNull() & origin.getField("_corrupt_record").isNull()
    flagged = injected | (known_origin & (text_or_empty(origin.getField("kind")) != "human"))
    for prefix in HARNESS_PREFIXES:
        flagged = flagged | F.startswith(text, F.lit(prefix))
    return F.coalesce(flagged, F.lit(False))


def claude_lines(records: DataFrame) -> DataFrame:
    """Narrow per-line table for accounting and summaries: no line text, no content blocks."""
    shown = records.withColumns({"prompt": user_text(), "replies": assistant_text_blocks()})
    return shown.drop("line", "content", "blocks", "notice", "compact")


def claude_summaries(lines: DataFrame) -> DataFrame:
    """Own-file summary of every transcript: identity, times, title, message count, error flag."""
    described = F.col("type").isin("user", "assistant", "ai-title")
    at = F.col("byte_offset")
    identity = F.when(described, non_empty(F.when(F.col("agent_id") != "", F.col("agent_id")).otherwise(F.col("session_id"))))
    rows = lines.withColumn("prompt_title", F.when(F.col("prompt") != "", non_empty(T.clean_title(F.col("prompt")))))
    grouped = rows.groupBy("agent", "path").agg(
        first_known(F.col("ts"), at).alias("started_at"),
        first_known(F.struct("ts_raw"), at, F.col("ts").isNotNull()).getField("ts_raw").alias("started_raw"),
        F.max("ts").alias("updated_at"),
        F.max_by("ts_raw", F.struct("ts", -at)).alias("updated_raw"),
        first_known(identity, at).alias("session_id"),
        first_known(F.when(described, non_empty(F.col("cwd"))), at).alias("cwd"),
        first_known(F.when(described, non_empty(F.col("git_branch"))), at).alias("git_branch"),
        F.max_by(
            T.clean_title(F.col("ai_title")),
            F.when((F.col("type") == "ai-title") & (T.clean_title(F.col("ai_title")) != ""), at),
        ).alias("ai_title"),
        first_known(F.struct("prompt_title", "prompt"), at, F.col("prompt_title").isNotNull()).alias("first_prompt"),
        F.sum(F.when(F.col("prompt") != "", 1).otherwise(0) + F.col("replies")).alias("messages"),
        F.bool_or("is_error").alias("has_error"),
        first_known(non_empty(F.col("session_id")), at).alias("file_session_id"),
    )
    prompt = F.col("first_prompt.prompt")
    newlines = F.char_length(prompt) - F.char_length(F.replace(prompt, F.lit("\n"), F.lit("")))
    retained = (F.octet_length(prompt) <= TITLE_PROMPT_BYTES) & (newlines < TITLE_PROMPT_LINES)
    return grouped.select(
        "agent",
        "path",
        text_or_empty(F.col("session_id")).alias("session_id"),
        text_or_empty(F.col("cwd")).alias("cwd"),
        F.when(F.col("cwd").isNull(), F.lit("")).otherwise(T.basename(F.col("cwd"))).alias("project"),
        text_or_empty(F.coalesce("ai_title", "first_prompt.prompt_title")).alias("title"),
        F.when(F.col("ai_title").isNull() & retained, prompt).otherwise(F.lit("")).alias("title_prompt"),
        text_or_empty(F.col("git_branch")).alias("git_branch"),
        "started_at",
        "started_raw",
        "updated_at",
        "updated_raw",
        F.col("messages").cast("bigint").alias("messages"),
        F.coalesce("has_error", F.lit(False)).alias("has_error"),
        text_or_empty(F.col("file_session_id")).alias("file_session_id"),
        F.lit("").alias("agent_path"),
        F.lit("").alias("parent_id"),
    )


def workflow_names(records: DataFrame) -> DataFrame:
    """Title of each workflow run a transcript reports; the last report wins."""
    run, name = F.col("tool_result_of.runId"), F.col("tool_result_of.workflowName")
    return (
        records.where(F.col("type").isin("user", "assistant", "ai-title") & (run != "") & (name != ""))
        .groupBy("agent", "path", run.alias("run_id"))
        .agg(F.max_by(T.clean_title(name), "byte_offset").alias("run_title"))
    )
