"""Transcript files: listing, byte-range scan, malformed-line filter and path roles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.plans.joins import parts_for
from sessionlake.plans.staging import stage

# Fixed values.
CLAUDE = "claude"
CODEX = "codex"
MAX_LINE_BYTES = 16 * 1024 * 1024

SPLIT_BYTES = 64 * 1024 * 1024
BUFFER_BYTES = 8 * 1024 * 1024
# Order-preserving block of a file, for the blocked scans.
BLOCK_BYTES = 8 * 1024 * 1024

RAW_SCHEMA = "agent string, path string, byte_offset bigint, byte_length int, line string, oversized boolean"


FILE_SCHEMA = "agent string, path string, size_bytes bigint, modified_at timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def list_files(spark: SparkSession, roots: dict[str, str | list[str]]) -> DataFrame:
    """Every ``*.jsonl`` below the roots: agent, path, size_bytes, modified_at. Reads no content.

    Folders are listed in tasks, one level of the tree per job, hidden ones too. A root that does not exist
    lists nothing.
    """
    asked = [
        (agent, re.sub("^file:/+", "/", path).rstrip("/") or "/")
        for agent, paths in roots.items()
        for path in ({paths} if isinstance(paths, str) else set(paths))
        if _exists(spark, path)
    ]
    level = spark.createDataFrame(asked, "agent string, path string")
    found = spark.createDataFrame([], FILE_SCHEMA)
    while not level.isEmpty():
        seen = stage(level.repartition("agent", "path").mapInArrow(_entries, f"{FILE_SCHEMA}, folder boolean"), "listing")
        found = found.unionByName(seen.where("NOT folder AND endswith(path, '.jsonl')").drop("folder"))
        level = seen.where("folder").select("agent", "path")
    return found.dropDuplicates(["agent", "path"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands in each folder, whatever its name begins with; a path that is a file stands for itself."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            path = row["path"]
            system, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
            own = system.get_file_info(inner)
            if own.type == fs.FileType.File:
                out.append((row["agent"], path, own.size, own.mtime, False))
            elif own.type == fs.FileType.Directory:
                for entry in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                    out.append((row["agent"], f"{path.rstrip('/')}/{entry.base_name}", entry.size, entry.mtime, entry.type == fs.FileType.Directory))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
        columns = list(zip(*out)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(column), kind) for column, kind in zip(columns, kinds)], ["agent", "path", "size_bytes", "modified_at", "folder"]
        )


def _batches(lines: list[tuple], agent: str, path: str) -> pa.RecordBatch:
    offsets, lengths, texts, oversized = zip(*lines)
    return pa.record_batch(
        [
            pa.array([agent] * len(lines), pa.string()),
            pa.array([path] * len(lines), pa.string()),
            pa.array(offsets, pa.int64()),
            pa.array(lengths, pa.int32()),
            pa.array(texts, pa.string()),
            pa.array(oversized, pa.bool_()),
        ],
        names=["agent", "path", "byte_offset", "byte_length", "line", "oversized"],
    )


def _read_range(stream, agent: str, path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Lines whose first byte lies in ``[start, end)``; the last one may run past ``end``."""
    position = start
    if start > 0:
        # The byte before decides whether a line starts exactly here.
        stream.seek(start - 1)
        position = start - 1
        inside = True
    else:
        stream.seek(0)
        inside = False
    held, held_start, held_size = [], position, 0
    lines: list[tuple] = []

    def close(last: bytes, size: int) -> None:
        if size > MAX_LINE_BYTES:
            lines.append((held_start, 0, None, True))
            return
        text = b"".join([*held, last])
        text = text[:-1] if text.endswith(b"\n") else text
        text = text[:-1] if text.endswith(b"\r") else text
        if text:
            lines.append((held_start, len(text), text.decode("utf-8", "replace"), False))

    while True:
        chunk = stream.read(BUFFER_BYTES)
        if not chunk:
            if held_size and not inside and held_start < end:
                close(b"", held_size)
            break
        ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10) + 1
        cursor = 0
        done = False
        for stop in ends.tolist():
            size = held_size + stop - cursor
            if not inside:
                close(chunk[cursor:stop], size)
            inside = False
            held, held_size, held_start, cursor = [], 0, position + stop, stop
            if held_start >= end:
                done = True
                break
        if done:
            break
        rest = chunk[cursor:]
        held_size += len(rest)
        # An oversized line is only measured, never kept.
        held = [] if inside or held_size > MAX_LINE_BYTES else [*held, rest]
        position += len(chunk)
        if lines:
            yield _batches(lines, agent, path)
            lines = []
    if lines:
        yield _batches(lines, agent, path)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            path = row["path"]
            system, inner = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
            try:
                stream = system.open_input_file(inner)
            except (FileNotFoundError, PermissionError):
                # Every range that is lost is reported; other failures fail the task and are retried.
                yield _batches([(row["start"], 0, None, False)], row["agent"], path)
                continue
            with stream:
                yield from _read_range(stream, row["agent"], path, row["start"], row["end"])


def scan_files(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every non-blank line of the listed files with its exact byte offset and length.

    Files are cut into byte ranges before reading, so one huge file is read by many tasks and no
    row ever holds a whole file. Line order inside a file is the order of ``byte_offset``.
    """
    ranges = files.select(
        "agent",
        "path",
        F.explode(F.sequence(F.lit(0), F.greatest(F.col("size_bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"),
        "size_bytes",
    ).select("agent", "path", "start", F.least(F.col("start") + split_bytes, F.col("size_bytes")).alias("end"))
    total, pieces = files.agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)), F.sum(F.ceil((F.col("size_bytes") + 1) / split_bytes))
    ).first()
    spark = files.sparkSession
    by_size = int(total // split_bytes) + 1
    tasks = min(int(pieces or 1), max(by_size, spark.sparkContext.defaultParallelism))
    return ranges.repartition(tasks, "path", "start").mapInArrow(_scan, RAW_SCHEMA)


def scan_jsonl(spark: SparkSession, roots: dict[str, str | list[str]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``raw_records`` of all transcripts below the roots of each agent."""
    return scan_files(list_files(spark, roots), split_bytes)


def offset_block(column: str = "byte_offset", block_bytes: int = BLOCK_BYTES) -> Column:
    """Order-preserving block of a line inside its file."""
    return F.floor(F.col(column) / F.lit(block_bytes)).cast("bigint")


def skip_malformed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``raw_records`` into readable lines and diagnostics about the others.

    Codes: oversized_line, malformed_line, and unreadable_session for a file that could not be opened.
    """
    oversized = F.coalesce(F.col("oversized"), F.lit(False)) if "oversized" in raw.columns else F.lit(False)
    too_long = oversized | (F.octet_length("line") > MAX_LINE_BYTES)
    checked = raw.withColumn(
        "__code",
        F.when(too_long, F.lit("oversized_line"))
        .when(F.col("line").isNull(), F.lit("unreadable_session"))
        .when(F.try_parse_json("line").isNull(), F.lit("malformed_line")),
    )
    good = checked.where("__code IS NULL").drop("__code", "oversized")
    bad = checked.where("__code IS NOT NULL").select(
        "agent",
        "path",
        "byte_offset",
        F.col("__code").alias("code"),
        F.when(F.col("__code") == "unreadable_session", F.lit("could not open the file")).otherwise(F.lit("line skipped")).alias("message"),
    )
    return good, bad


def directory(column: Column) -> Column:
    return F.regexp_replace(column, r"/[^/]*$", "")


def classify_path(files: DataFrame) -> DataFrame:
    """Role of every file in its session graph.

    ``role`` is root, child, member (of a group directory), legacy or ignored. ``parent_path`` is the
    transcript that owns the file, null for legacy files whose owner is found by session id.
    """
    parts = parts_for(files)  # and no broadcasts: sizes are guessed from what the files' table takes on disk
    files = files.repartition(parts, "path")
    path = F.col("path")
    name = F.substring_index(path, "/", -1)
    owner = F.regexp_extract("path", r"^(.*)/subagents/.*$", 1)
    below = F.regexp_extract("path", r"^.*/subagents/(.*)$", 1)
    nested = owner != ""
    direct = nested & ~F.contains(below, F.lit("/"))
    is_agent = F.startswith(name, F.lit("agent-"))
    claude = F.col("agent") == CLAUDE
    role = (
        F.when(~claude, F.lit("root"))
        .when(direct, F.lit("child"))
        .when(nested & is_agent, F.lit("member"))
        .when(nested, F.lit("ignored"))
        .when(is_agent, F.lit("legacy"))
        .otherwise(F.lit("root"))
    )
    out = files.withColumn("role", role).withColumn(
        "parent_path", F.when(F.col("role").isin("child", "member"), F.concat(owner, F.lit(".jsonl")))
    )
    out = out.withColumn("group_dir", F.when(F.col("role") == "member", directory(path)))
    # A directory that is the companion of another transcript belongs to that transcript.
    folders = (
        out.where("role = 'member'")
        .select(
            "agent",
            "path",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size(F.split(below, "/")) - 1),
                    lambda depth: F.concat(
                        owner,
                        F.lit("/subagents/"),
                        F.array_join(F.slice(F.split(below, "/"), F.lit(1), depth), "/"),
                        F.lit(".jsonl"),
                    ),
                )
            ).alias("companion"),
        )
        .repartition(parts, "companion")
        .join(files.select("agent", F.col("path").alias("companion")).repartition(parts, "companion").hint("merge"), ["agent", "companion"], "left_semi")
        .select("agent", "path")
        .repartition(parts, "path")
        .distinct()
        .withColumn("owned", F.lit(True))
    )
    out = out.join(folders.hint("merge"), ["agent", "path"], "left")
    role = F.when(F.col("owned"), F.lit("ignored")).otherwise(F.col("role"))
    return out.withColumn("role", role).drop("owned")
