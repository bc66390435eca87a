"""Adapters from relational tables to the canonical tables, so every operator runs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.sources.pricing import PRICING_SCHEMA
from sessionlake.sources.scan import CLAUDE

# Invented rates for the event types of the tables; ``error`` has none.
EVENT_PRICES = [
    # model, in, out, write, read, 200k tiers (4), 272k tiers (4), fast
    ("view", 3e-6, 15e-6, None, None, 6e-6, 2.25e-5, 7.5e-6, 6e-7, None, None, None, None, 0.0),
    ("click", 2e-6, 8e-6, None, None, None, None, None, None, 4e-6, 16e-6, None, None, 0.0),
    ("purchase", 5e-6, 25e-6, 6.5e-6, 5e-7, None, None, None, None, None, None, None, None, 0.0),
    ("anthropic/signup", 1e-6, 4e-6, None, None, None, None, None, None, None, None, None, None, 2.0),
    ("signup-fast", 1.5e-6, 6e-6, None, None, None, None, None, None, None, None, None, None, 3.0),
]


def event_pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_PRICES, PRICING_SCHEMA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for row-by-row text work when a small table is a single split.

    Large tables have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def event_number() -> Column:
    """The small integer inside ``events.props``."""
    return F.get_json_object("props", "$.k").cast("bigint")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as top-level sessions that start with their first event."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").cast("string").alias("node_id"))
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count("*").alias("messages"))
        .select(F.lit(CLAUDE).alias("agent"), "node_id", F.col("node_id").alias("session_id"), "started_at", "updated_at", "messages")
    )


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request reports: key ``(k, event_type)``, input tokens from ``value``."""
    k = event_number()
    return table(spark, sf_dir, "events").select(
        F.lit(CLAUDE).alias("agent"),
        F.col("user_id").cast("string").alias("node_id"),
        k.cast("string").alias("message_id"),
        F.col("event_type").alias("request_id"),
        F.col("event_id").alias("byte_offset"),
        F.lit(0).alias("ordinal"),
        (k % 7 == 0).alias("is_sidechain"),
        F.lit(False).alias("is_aggregate"),
        F.col("event_type").alias("model"),
        F.round(F.col("value") * 1000).cast("bigint").alias("input"),
        (k * 10).alias("output"),
        (k * 100).alias("write_5m"),
        (k % 5).alias("write_1h"),
        (k * 1000).alias("cache_read"),
        F.lit(False).alias("includes_cache_read"),
        F.when(k % 3 == 0, F.lit("fast")).otherwise(F.lit("")).alias("speed"),
        F.lit(None).cast("double").alias("cost_usd"),
    )


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as addressable root nodes."""
    ids = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"))
    node = F.col("conv_id").cast("string")
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("conv_id") % 13) * 3600)
    return ids.select(
        F.lit(CLAUDE).alias("agent"), node.alias("node_id"), node.alias("root_id"), node.alias("session_id"),
        F.concat(F.lit(f"{CLAUDE}:"), node).alias("ref"), node.alias("path"),
        F.concat(F.lit("project-"), (F.col("conv_id") % 5).cast("string")).alias("project"),
        F.concat(F.lit("/work/project-"), (F.col("conv_id") % 5).cast("string")).alias("cwd"),
        F.concat(F.lit("Conversation "), node).alias("title"),
        stamp.alias("updated_at"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_raw"), "messages",
    )


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as timeline events: users and assistants speak, system turns are tool calls."""
    role = F.col("role")
    kind = F.when(role == "user", "user").when(role == "assistant", "assistant-text").otherwise("tool-call")
    is_tool = role == "system"
    none = F.lit("")
    return table(spark, sf_dir, "conversations").select(
        F.lit(CLAUDE).alias("agent"), F.col("conv_id").cast("string").alias("node_id"), F.col("turn").alias("seq"),
        F.col("turn").alias("event_index"), none.alias("ts_raw"), kind.alias("kind"),
        F.when(is_tool, none).otherwise(F.col("text")).alias("text"),
        F.when(is_tool, "Note").otherwise(none).alias("tool_name"),
        F.when(is_tool, F.col("text")).otherwise(none).alias("tool_input"),
        F.when(is_tool, F.col("text")).otherwise(none).alias("detail_input"),
        none.alias("detail_diff"), none.alias("detail_output"), none.alias("summary"),
    )


# Byte offsets of derived lines leave room for their blocks.
LINE_STRIDE = 1 << 16
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def event_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table written as transcript lines of the first format, one file per user.

    view: a prompt; click: a tool call; purchase: a tool result; signup: a reply; error: a failed reply.
    """
    k = event_number()
    kind = F.col("event_type")
    key = k.cast("string")
    label = lambda word: F.concat(F.lit(word), key)
    block = F.struct(
        F.when(kind == "click", "tool_use").when(kind == "purchase", "tool_result").otherwise("text").alias("type"),
        F.when(kind == "signup", label("Reply ")).when(kind == "error", label("Failed ")).alias("text"),
        F.when(kind == "click", key).alias("id"),
        F.when(kind == "click", F.when(k % 2 == 0, "Bash").otherwise("Probe")).alias("name"),
        F.when(kind == "click", F.struct(label("run ").alias("command"))).alias("input"),
        F.when(kind == "purchase", key).alias("tool_use_id"),
        F.when(kind == "purchase", F.when(k % 3 == 0, label("Exit code ")).otherwise(label("fine  "))).alias("content"),
    )
    speaks = kind.isin("click", "signup", "error")
    usage = F.struct(
        F.round(F.col("value") * 1000).cast("bigint").alias("input_tokens"), (k * 10).alias("output_tokens"),
        (k * 1000).alias("cache_read_input_tokens"),
        F.struct((k * 100).alias("ephemeral_5m_input_tokens"), (k % 5).alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
    )
    spoken = F.struct(key.alias("id"), kind.alias("model"), F.array(block).alias("content"), usage.alias("usage"))
    common = [
        F.date_format("ts", _STAMP).alias("timestamp"), F.col("user_id").cast("string").alias("sessionId"),
        F.concat(F.lit("/work/u"), F.col("user_id").cast("string")).alias("cwd"), kind.alias("requestId"),
    ]
    said = F.to_json(F.struct(
        F.lit("assistant").alias("type"), *common, (k % 7 == 0).alias("isSidechain"), F.when(k % 3 == 0, "fast").alias("speed"),
        F.when(kind == "error", "overloaded").alias("error"), spoken.alias("message"),
    ))
    asked = F.to_json(F.struct(F.lit("user").alias("type"), *common, F.struct(label("Prompt ").alias("content")).alias("message")))
    answered = F.to_json(F.struct(F.lit("user").alias("type"), *common, F.struct(F.array(block).alias("content")).alias("message")))
    line = F.when(speaks, said).when(kind == "view", asked).otherwise(answered)
    return spread(table(spark, sf_dir, "events")).select(
        F.lit(CLAUDE).alias("agent"),
        F.concat(F.lit("/lake/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("path"),
        (F.col("event_id") * LINE_STRIDE).alias("byte_offset"),
        F.octet_length(line).alias("byte_length"),
        line.alias("line"),
    )


def event_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table written as transcript lines of the second format, one file per user.

    view: a turn context; purchase: a prompt; signup: a reply; error: a tool call; click: a token record.
    Cumulative totals agree with the deltas for a third of the users, are larger for a third, and
    are missing for the rest.
    """
    from sessionlake.plans.running import Running, running
    from sessionlake.sources.scan import CODEX

    k = event_number()
    tokens = F.round(F.col("value") * 1000).cast("bigint")
    base = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", k.alias("k"), tokens.alias("inp"), F.least(k, tokens).alias("cached"),
    )
    counted = (F.col("event_type") == "click") & (F.col("k") % 5 != 0)
    sums = {
        f"sum_{name}": Running("sum", F.when(counted, F.col(value)).otherwise(0))
        for name, value in {"inp": "inp", "cached": "cached", "out": "k"}.items()
    }
    rows = running(base, ["user_id"], [F.col("event_id")], F.floor(F.col("event_id") / (1 << 16)), sums)
    extra = F.when(F.col("user_id") % 3 == 1, 1000).otherwise(0)
    counters = lambda inp, cached, out: F.struct(
        inp.alias("input_tokens"), cached.alias("cached_input_tokens"), out.alias("output_tokens"),
        F.lit(0).alias("reasoning_output_tokens"), (inp + out).alias("total_tokens"),
    )
    total = F.when(F.col("user_id") % 3 != 2, counters(F.col("sum_inp") + extra, F.col("sum_cached"), F.col("sum_out")))
    info = F.struct(total.alias("total_token_usage"), counters(F.col("inp"), F.col("cached"), F.col("k")).alias("last_token_usage"))
    kind = F.col("event_type")
    number = F.col("event_id").cast("string")
    words = lambda word: F.concat(F.lit(word), number)
    payload = F.struct(
        F.when(kind == "purchase", "user_message").when(kind == "click", "token_count").when(kind == "signup", "message").when(kind == "error", "function_call").alias("type"),
        F.when(kind == "view", F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("model-"), (F.col("k") % 3).cast("string")))).alias("model"),
        F.when(kind == "purchase", words("ask ")).alias("message"),
        F.when(kind == "signup", "assistant").alias("role"),
        F.when(kind == "signup", F.array(F.struct(words("answer ").alias("text")))).alias("content"),
        F.when(kind == "error", number).alias("call_id"),
        F.when(kind == "error", "probe").alias("name"),
        F.when(kind == "error", words("arg ")).alias("arguments"),
        F.when(kind == "click", info).alias("info"),
    )
    line_type = F.when(kind == "view", "turn_context").when(kind.isin("purchase", "click"), "event_msg").otherwise("response_item")
    record = F.struct(F.date_format("ts", _STAMP).alias("timestamp"), line_type.alias("type"), payload.alias("payload"))
    body = rows.select("user_id", ((F.col("event_id") + 1) * LINE_STRIDE).alias("byte_offset"), F.to_json(record).alias("line"))
    metas = base.groupBy("user_id").agg(F.min("ts").alias("ts")).select(
        "user_id",
        F.lit(0).cast("bigint").alias("byte_offset"),
        F.to_json(F.struct(
            F.date_format("ts", _STAMP).alias("timestamp"), F.lit("session_meta").alias("type"),
            F.struct(F.col("user_id").cast("string").alias("id"), F.lit("/work/pond").alias("cwd")).alias("payload"),
        )).alias("line"),
    )
    return body.unionByName(metas).select(
        F.lit(CODEX).alias("agent"),
        F.concat(F.lit("/lake/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("path"),
        "byte_offset",
        F.octet_length("line").alias("byte_length"),
        "line",
    )


def talk_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table written as transcript lines of the first format, one file per conversation.

    Turns take nine forms in turn: a typed prompt, two that the harness injects, calls that edit, edit several times and
    read, the result of the call before as blocks, an advised reply, and a plain reply. Texts stand for themselves as digests.
    """
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9)).alias("form"), F.md5(F.coalesce("text", F.lit(""))).alias("d")
    )
    form, said = F.col("form"), lambda word: F.concat(F.lit(word), F.col("d"))
    call = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    edit = lambda old, new: F.struct(old.alias("old_string"), new.alias("new_string"))
    file = F.concat(F.lit("/w/"), F.col("d"), F.lit(".py"))
    input_ = (
        F.when(form == 3, F.to_json(F.struct(file.alias("file_path"), F.lit("a\nb").alias("old_string"), F.col("d").alias("new_string"))))
        .when(form == 4, F.to_json(F.struct(file.alias("file_path"), F.array(edit(F.lit("x"), F.lit("y\nz")), edit(F.lit("q"), F.col("d"))).alias("edits"))))
        .when(form == 5, F.to_json(F.struct(file.alias("file_path"), F.col("turn").cast("int").alias("offset"), F.lit(5).alias("limit"))))
    )
    quote = lambda column: F.to_json(F.struct(column.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(column.alias("x")))) - 6)
    tool = F.when(form == 3, "Edit").when(form == 4, "MultiEdit").otherwise("Read")
    usage = lambda more: F.concat(F.lit('"usage":{"input_tokens":'), (F.col("turn") + 10).cast("string"), F.lit(',"output_tokens":2'), more, F.lit("}"))
    step = lambda kind, model, n: F.concat(F.lit(f'{{"type":"{kind}","model":"{model}","input_tokens":'), n.cast("string"), F.lit(',"output_tokens":3}'))
    steps = F.concat(F.lit(',"iterations":['), step("advisor_message", "adv-1", F.col("turn") + 1), F.lit(","), step("message", "other", F.col("turn") + 2), F.lit(","),
                     step("advisor_message", "adv-2", F.col("turn") + 3), F.lit("]"))
    advisor = F.concat(F.lit('{"type":"server_tool_use","id":"'), call(0), F.lit('","name":"advisor"}'))
    reply = F.concat(F.lit('{"type":"text","text":'), quote(said("Reply ")), F.lit("}"))
    spoken = lambda blocks, more: F.concat(F.lit('{"type":"assistant","requestId":"r","message":{"id":"'), call(0), F.lit('","model":"oak-1",'), usage(more), F.lit(',"content":['), blocks, F.lit("]}"))
    asked = lambda word, more: F.concat(F.lit('{"type":"user",'), F.lit(more), F.lit('"message":{"content":'), quote(said(word)), F.lit("}"))
    parts = F.concat(F.lit('[{"text":'), quote(said("part ")), F.lit(',"type":"text"},{"type":"image"},{"text":"end","type":"text"}]'))
    answered = F.concat(F.lit('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"'), call(1), F.lit('","content":'), parts, F.lit("}]}"))
    used = F.concat(F.lit('{"type":"tool_use","id":"'), call(0), F.lit('","name":"'), tool, F.lit('","input":'), input_, F.lit("}"))
    none = F.lit("")
    body = (
        F.when(form == 0, asked("Ask ", "")).when(form == 1, asked("Meta ", '"isMeta":true,')).when(form == 2, asked("Hook ", '"origin":{"kind":"hook"},'))
        .when(form.isin(3, 4, 5), spoken(used, none)).when(form == 6, answered).when(form == 7, spoken(F.concat(advisor, F.lit(","), reply), steps)).otherwise(spoken(reply, none))
    )
    line = F.concat(body, F.lit(',"timestamp":"2026-01-01T00:00:00Z","sessionId":"'), F.col("conv_id").cast("string"), F.lit('"}'))
    return rows.select(
        F.lit(CLAUDE).alias("agent"), F.concat(F.lit("/talk/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"),
        (F.col("turn") * LINE_STRIDE).cast("bigint").alias("byte_offset"), F.octet_length(line).alias("byte_length"), line.alias("line"),
    )


def write_lines(lines: DataFrame, folder: str, suffix: str = ".jsonl") -> None:
    """Write a column of lines as files of this suffix, one for each task; a task that runs again writes the same file anew."""

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, inner = (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/part-{TaskContext.get().partitionId():05d}{suffix}") as out:
            for batch in batches:
                for line in batch.column(0):
                    out.write(line.as_buffer().to_pybytes() + b"\n")
                yield batch.slice(0, 0)

    lines.mapInArrow(write, lines.schema).write.format("noop").mode("overwrite").save()


def place_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Region, nation and customer or supplier rows as a three-level tree; nations are containers."""
    region = table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey")).alias("node_id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"), F.lit(False).alias("is_group"),
    )
    nation = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")), "n_name", F.lit(True),
    )
    customer = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("n"), F.col("c_nationkey")), "c_name", F.lit(False),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey")), F.concat(F.lit("n"), F.col("s_nationkey")), "s_name", F.lit(False),
    )
    rows = region.union(nation).union(customer).union(supplier)
    starts = order_starts(spark, sf_dir)
    nodes = rows.join(starts, "node_id", "left").select(
        F.lit(CLAUDE).alias("agent"), "node_id", F.concat(F.lit("/lake/"), F.col("node_id"), F.lit(".jsonl")).alias("path"),
        F.col("node_id").alias("session_id"), "title", "is_group", F.lit("").alias("agent_path"), F.lit("").alias("title_prompt"),
        F.lit("lake").alias("project"), "started_at", "updated_at", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_raw"),
    )
    edges = rows.where("parent IS NOT NULL").select(F.lit(CLAUDE).alias("agent"), "parent", F.col("node_id").alias("child"))
    return nodes, edges


def order_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey")).alias("node_id")).agg(
        F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("updated_at")
    )


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own totals of the customer nodes: order counts as tokens, order values as cost."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf_dir, "orders").groupBy(F.lit(CLAUDE).alias("agent"), F.concat(F.lit("c"), F.col("o_custkey")).alias("node_id")).agg(
        F.sum(cents).alias("uncached_input"), F.count("*").alias("output"), F.lit(0).cast("bigint").alias("cache_write"),
        F.count_if(F.col("o_orderstatus") == "F").alias("cache_read"), (F.sum(cents) + F.count("*")).alias("total"),
        (F.sum(cents) / 100).alias("usd"), (F.sum(cents) / 100).alias("gross_usd"),
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("estimated"),
        F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")))).alias("missing_pricing"),
        F.array().cast("array<struct<model:string,pricing_model:string>>").alias("estimated_rates"),
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
