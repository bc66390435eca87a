"""Record projection of the second transcript format: typed lines with one polymorphic payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.functions.tokens import sat_sum
from sessionlake.plans.running import Running, running
from sessionlake.plans.staging import stage
from sessionlake.sources.records import (
    REQUEST_COLUMNS,
    distinct_models,
    first_known,
    non_empty,
    number_or_zero,
    parse_lines,
    text_or_empty,
    timestamp_of,
)
from sessionlake.sources.scan import offset_block

# Fixed values.
TOKEN_FIELDS = [
    "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens",
]
SECOND_CHARS = 19
AGENT_PATH_BYTES, AGENT_DEPTH, AGENT_COMPONENT = 4096, 64, 255

_TOKENS = "STRUCT<" + ", ".join(f"{name} BIGINT" for name in TOKEN_FIELDS) + ">"
_ENVELOPE = (
    "timestamp STRING, type STRING, payload STRUCT<type STRING, role STRING, model STRING, message STRING, id STRING, "
    "session_id STRING, cwd STRING, agent_path STRING, agent_thread_id STRING, parent_thread_id STRING, "
    "forked_from_id STRING, kind STRING, thread_source STRING, call_id STRING, name STRING, arguments STRING, "
    "input STRING, output VARIANT, content STRING, summary STRING, git STRUCT<branch STRING>, "
    f"info STRUCT<total_token_usage {_TOKENS}, last_token_usage {_TOKENS}>>, _corrupt_record STRING"
)


def codex_records(raw: DataFrame) -> DataFrame:
    """Typed columns of every readable line; unknown fields are ignored."""
    parsed = parse_lines(raw, _ENVELOPE)
    p = "r.payload"

    def tokens(name: str) -> Column:
        value = F.col(f"{p}.info.{name}")
        filled = F.struct(*[number_or_zero(value.getField(field)).alias(field) for field in TOKEN_FIELDS])
        return F.when(value.isNotNull(), filled)

    texts = ["role", "model", "message", "cwd", "agent_path", "agent_thread_id", "parent_thread_id", "forked_from_id",
             "kind", "thread_source", "call_id", "name", "arguments", "input"]
    return parsed.select(
        "agent",
        "path",
        "byte_offset",
        "byte_length",
        "line",
        text_or_empty(F.col("r.timestamp")).alias("ts_raw"),
        timestamp_of(F.col("r.timestamp")).alias("ts"),
        F.when(F.octet_length("r.timestamp") >= SECOND_CHARS, F.substring("r.timestamp", 1, SECOND_CHARS)).alias("second"),
        text_or_empty(F.col("r.type")).alias("type"),
        text_or_empty(F.col(f"{p}.type")).alias("item"),
        *[text_or_empty(F.col(f"{p}.{name}")).alias(name) for name in texts],
        text_or_empty(F.coalesce(non_empty(F.col(f"{p}.id")), F.col(f"{p}.session_id"))).alias("session_id"),
        text_or_empty(F.col(f"{p}.git.branch")).alias("git_branch"),
        F.col(f"{p}.output").alias("output"),
        F.col(f"{p}.content").alias("content"),
        F.col(f"{p}.summary").alias("summary"),
        tokens("total_token_usage").alias("total"),
        tokens("last_token_usage").alias("delta"),
    )


def is_token_count() -> Column:
    return (F.col("type") == "event_msg") & (F.col("item") == "token_count")


def is_valid_tokens(tokens: Column) -> Column:
    ok = tokens.isNotNull() & (tokens.getField("cached_input_tokens") <= tokens.getField("input_tokens"))
    for field in TOKEN_FIELDS:
        ok = ok & (tokens.getField(field) >= 0)
    return F.coalesce(ok, F.lit(False))


def file_meta(records: DataFrame) -> DataFrame:
    """Identity of each file, taken from its first session_meta line only."""
    fields = ["session_id", "cwd", "git_branch", "agent_path", "parent_thread_id", "forked_from_id", "thread_source"]
    return (
        records.where("type = 'session_meta'")
        .groupBy("agent", "path")
        .agg(F.min_by(F.struct(*fields), "byte_offset").alias("meta"))
        .select("agent", "path", "meta.*")
    )


def replay_prefix(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    """Replayed second, end and cumulative baseline of every forked file that starts with a replay.

    The first two valid deltas of a fork that share a timestamp second mark it as replayed; the
    prefix ends at the first token record of a later second. Files without a replay have no row.
    """
    forked = meta.where("thread_source = 'subagent' OR forked_from_id <> ''").select("agent", "path")
    by = ["agent", "path"]
    counted = tokens.join(forked, by, "left_semi")
    candidates = counted.where(is_valid_tokens(F.col("delta"))).select(*by, "byte_offset", "second")
    first = candidates.groupBy(*by).agg(F.min(F.struct("byte_offset", "second")).alias("one"))
    second = (
        candidates.join(first, by)
        .where(F.col("byte_offset") > F.col("one.byte_offset"))
        .groupBy(*by, F.col("one.second").alias("replay_second"))
        .agg(F.min_by("second", "byte_offset").alias("next_second"))
        .where("replay_second = next_second")
        .select(*by, "replay_second")
    )
    inside = counted.join(second, by)
    ended = inside.groupBy(*by, "replay_second").agg(
        F.min(F.when(F.col("second") > F.col("replay_second"), F.col("byte_offset"))).alias("replay_end")
    )
    in_prefix = (F.col("second") == F.col("replay_second")) & (
        F.col("replay_end").isNull() | (F.col("byte_offset") < F.col("replay_end"))
    )
    valid = in_prefix & is_valid_tokens(F.col("total"))
    return (
        inside.join(ended, [*by, "replay_second"])
        .groupBy(*by, "replay_second", "replay_end")
        .agg(
            F.max_by("total", F.when(valid, F.col("byte_offset"))).alias("baseline"),
            F.max(F.when(valid, F.col("byte_offset"))).alias("baseline_at"),
        )
    )


def replay_flag() -> Column:
    """Is the line part of the replay prefix? Needs the columns of ``replay_prefix``."""
    return F.coalesce(
        (F.col("second") == F.col("replay_second"))
        & (F.col("replay_end").isNull() | (F.col("byte_offset") < F.col("replay_end"))),
        F.lit(False),
    )


def line_state(records: DataFrame, meta: DataFrame, block: Column | None = None) -> DataFrame:
    """Per-line state that depends on earlier lines, as one staged narrow table.

    ``model`` is the last non-empty model in force (accounting), ``line_model`` the latest one even
    if empty (timeline), ``seen_until`` the running latest timestamp, ``advances`` tells whether a
    cumulative total exceeds every earlier one on some counter.
    """
    by = ["agent", "path"]
    tokens = records.where(is_token_count()).select(*by, "byte_offset", "second", "total", "delta")
    replays = replay_prefix(tokens, meta)
    rows = (
        records.select(*by, "byte_offset", "ts", "second", "type", "item", "kind", "agent_path", "agent_thread_id",
                       F.col("model").alias("named_model"), "total", "delta")
        .join(replays, by, "left")
        .withColumn("in_replay", replay_flag())
    )
    counts = is_token_count()
    valid_total = counts & is_valid_tokens(F.col("total"))
    # The replay baseline replaces whatever maximum was known before it.
    raises = valid_total & ~F.col("in_replay") & (F.col("baseline_at").isNull() | (F.col("byte_offset") > F.col("baseline_at")))
    context = F.col("type") == "turn_context"
    specs = {
        "model": Running("last", F.when(context, non_empty(F.col("named_model")))),
        "line_model": Running("last", F.when(context, F.col("named_model"))),
        "seen_until": Running("max", F.col("ts")),
    }
    for field in TOKEN_FIELDS:
        specs[f"max_{field}"] = Running("max", F.when(raises, F.col(f"total.{field}")), inclusive=False)
    stated = running(rows, by, [F.col("byte_offset")], offset_block() if block is None else block, specs)
    advances = F.lit(False)
    for field in TOKEN_FIELDS:
        floor = F.greatest(F.coalesce(f"max_{field}", F.lit(0)), F.coalesce(F.col(f"baseline.{field}"), F.lit(0)))
        advances = advances | (F.col(f"total.{field}") > floor)
    out = stated.select(
        *by, "byte_offset", "ts", "second", "type", "item", "kind", "agent_path", "agent_thread_id", "in_replay",
        text_or_empty(F.col("model")).alias("model"), text_or_empty(F.col("line_model")).alias("line_model"), "seen_until",
        "total", "delta", "baseline", valid_total.alias("valid_total"), F.coalesce(advances, F.lit(False)).alias("advances"),
    )
    return stage(out, "line-state")


def accepted_deltas(state: DataFrame) -> DataFrame:
    """Per-request deltas outside the replay prefix whose cumulative total advances, if they have one."""
    return state.where(
        is_token_count()
        & ~F.col("in_replay")
        & is_valid_tokens(F.col("delta"))
        & (~F.col("valid_total") | F.col("advances"))
    )


def codex_ledger(state: DataFrame) -> DataFrame:
    """Billed requests of every file.

    Deltas count as requests only if their sum equals the final cumulative total minus the replay
    baseline on all five counters. Otherwise the remaining cumulative total is one aggregate, or,
    without a usable total, every model's delta sum is one.
    """
    by = ["agent", "path"]
    deltas = accepted_deltas(state)
    sums = deltas.groupBy(*by).agg(
        F.struct(*[sat_sum(F.col(f"delta.{field}")).alias(field) for field in TOKEN_FIELDS]).alias("summed")
    )
    last = state.where("valid_total").groupBy(*by).agg(
        F.max_by(F.struct("total", "model"), "byte_offset").alias("last"),
        F.max("baseline").alias("baseline"),
    )
    zero = F.lit(0).cast("bigint")
    usable = F.lit(True)
    rest = []
    for field in TOKEN_FIELDS:
        base = F.coalesce(F.col(f"baseline.{field}"), zero)
        usable = usable & (base <= F.col(f"last.total.{field}"))
        rest.append((F.col(f"last.total.{field}") - base).alias(field))
    files = state.select(*by).distinct().join(sums, by, "left").join(last, by, "left")
    files = files.withColumn("own", F.when(F.col("last").isNotNull() & usable, F.struct(*rest)))
    clean = F.col("own").isNotNull() & F.col("summed").isNotNull()
    for field in TOKEN_FIELDS:
        clean = clean & (F.col(f"own.{field}") == F.col(f"summed.{field}"))
    verdict = files.select(
        *by, "own", F.col("last.model").alias("last_model"), F.coalesce(clean, F.lit(False)).alias("clean")
    )
    judged = deltas.join(verdict, by)
    single = judged.where("clean").select(
        *by, "model", "byte_offset", F.lit(0).alias("ordinal"), F.lit(False).alias("is_aggregate"), F.col("delta").alias("t")
    )
    lumped = verdict.where("own IS NOT NULL AND NOT clean").select(
        *by, F.col("last_model").alias("model"), F.lit(-1).cast("bigint").alias("byte_offset"), F.lit(0).alias("ordinal"),
        F.lit(True).alias("is_aggregate"), F.col("own").alias("t"),
    )
    per_model = (
        judged.where("own IS NULL")
        .groupBy(*by, "model")
        .agg(
            F.min("byte_offset").alias("first_at"),
            F.struct(*[sat_sum(F.col(f"delta.{field}")).alias(field) for field in TOKEN_FIELDS]).alias("t"),
        )
        .select(
            *by, "model", (-1 - F.col("first_at")).alias("byte_offset"), F.lit(0).alias("ordinal"),
            F.lit(True).alias("is_aggregate"), "t",
        )
    )
    rows = single.unionByName(lumped).unionByName(per_model)
    return rows.select(
        "agent",
        F.col("path").alias("node_id"),
        F.lit("").alias("message_id"),
        F.lit("").alias("request_id"),
        "byte_offset",
        "ordinal",
        F.lit(False).alias("is_sidechain"),
        "is_aggregate",
        "model",
        F.col("t.input_tokens").alias("input"),
        F.col("t.output_tokens").alias("output"),
        F.lit(0).cast("bigint").alias("write_5m"),
        F.lit(0).cast("bigint").alias("write_1h"),
        F.col("t.cached_input_tokens").alias("cache_read"),
        F.lit(True).alias("includes_cache_read"),
        F.lit("").alias("speed"),
        F.lit(None).cast("double").alias("cost_usd"),
    ).select(*REQUEST_COLUMNS).withColumn("ledger_at", F.struct("byte_offset", "ordinal"))


def codex_models(records: DataFrame) -> DataFrame:
    """Models of each file in the order its turns first name them."""
    named = records.where("type = 'turn_context' AND model <> ''").select(
        "agent", F.col("path").alias("node_id"), "model", "byte_offset"
    )
    return distinct_models(named, ["agent", "node_id"], F.col("byte_offset"))


def codex_summaries(records: DataFrame, state: DataFrame, meta: DataFrame) -> DataFrame:
    """Own-file summary of every transcript."""
    by = ["agent", "path"]
    at = F.col("byte_offset")
    turns = (F.col("type") == "event_msg") & F.col("item").isin("user_message", "agent_message") & ~F.col("in_replay")
    flags = state.select(*by, "byte_offset", "in_replay")
    prompt = F.when(turns & (F.col("item") == "user_message"), non_empty(T.task_title(F.col("message"))))
    grouped = records.select(*by, "byte_offset", "ts", "ts_raw", "type", "item", "message").join(flags, [*by, "byte_offset"]).groupBy(*by).agg(
        first_known(F.col("ts"), at).alias("started_at"),
        first_known(F.struct("ts_raw"), at, F.col("ts").isNotNull()).getField("ts_raw").alias("started_raw"),
        F.max("ts").alias("updated_at"),
        F.max_by("ts_raw", F.struct("ts", -at)).alias("updated_raw"),
        first_known(prompt, at).alias("prompt_title"),
        F.count_if(turns).alias("messages"),
    )
    named = grouped.join(meta, by, "left")
    own_title = F.when(text_or_empty(F.col("agent_path")) != "", T.clean_title(T.basename(F.col("agent_path"))))
    return named.select(
        *by,
        text_or_empty(F.col("session_id")).alias("session_id"),
        text_or_empty(F.col("cwd")).alias("cwd"),
        F.when(F.col("cwd").isNull(), F.lit("")).otherwise(T.basename(F.col("cwd"))).alias("project"),
        text_or_empty(F.coalesce(own_title, "prompt_title")).alias("title"),
        F.lit("").alias("title_prompt"),
        text_or_empty(F.col("git_branch")).alias("git_branch"),
        "started_at",
        "started_raw",
        "updated_at",
        "updated_raw",
        "messages",
        F.lit(False).alias("has_error"),
        F.lit("").alias("file_session_id"),
        text_or_empty(F.col("agent_path")).alias("agent_path"),
        text_or_empty(F.col("parent_thread_id")).alias("parent_id"),
    )


def agent_path_parts(path: Column) -> Column:
    """Components of an agent path below ``root``; null when the path is unusable."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    parts = F.when(parts[0] == "root", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    bad = F.exists(parts, lambda part: (part == "") | (F.octet_length(part) > AGENT_COMPONENT))
    ok = (F.octet_length(path) <= AGENT_PATH_BYTES) & (F.size(parts) > 0) & (F.size(parts) <= AGENT_DEPTH) & ~bad
    return F.when(ok, parts)
