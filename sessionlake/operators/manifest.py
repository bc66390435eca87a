"""File manifests and the difference between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_manifest(files: DataFrame, version: str) -> DataFrame:
    """Fingerprint of every file: path, size, modification time, and the parser and price version."""
    stamp = F.unix_micros("modified_at").cast("string")
    return files.select(
        "agent", "path", "size_bytes", "modified_at",
        F.sha2(F.concat_ws("\0", F.lit(version), "path", F.col("size_bytes").cast("string"), stamp), 256).alias("fingerprint"),
    )


def diff_manifest(new: DataFrame, old: DataFrame) -> DataFrame:
    """Files that differ, with ``change`` created, changed or removed."""
    key = ["agent", "path"]
    left = new.select(*key, F.col("fingerprint").alias("new_print"))
    right = old.select(*key, F.col("fingerprint").alias("old_print"))
    change = F.when(F.col("old_print").isNull(), "created").when(F.col("new_print").isNull(), "removed").when(
        F.col("old_print") != F.col("new_print"), "changed"
    )
    return left.join(right, key, "full").select(*key, change.alias("change")).where("change IS NOT NULL")


def removed_sessions(old: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """Identities of the previous state that the current state lacks."""
    return old.select(*identity).join(new.select(*identity), identity, "left_anti")


def affected_roots(changed: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Top-level transcript that each changed file belongs to.

    A file below a companion directory belongs to the outermost transcript; a legacy file to the
    transcript of its directory with the same session id, for which ``summaries`` (agent, path,
    file_session_id) is needed; any other file is its own root.
    """
    outer = F.when(F.contains("path", F.lit("/subagents/")), F.concat(F.substring_index("path", "/subagents/", 1), F.lit(".jsonl")))
    mapped = changed.select("agent", "path", F.coalesce(outer, "path").alias("root_path"))
    if summaries is None:
        return mapped
    named = F.startswith(F.substring_index("path", "/", -1), F.lit("agent-")) & ~F.contains("path", F.lit("/subagents/"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    known = summaries.select("agent", "path", "file_session_id", folder.alias("folder"), named.alias("legacy")).where("file_session_id <> ''")
    owners = known.where("NOT legacy").groupBy("agent", "folder", "file_session_id").agg(F.min("path").alias("owner"))
    legacy = known.where("legacy").join(owners, ["agent", "folder", "file_session_id"]).select("agent", "path", "owner")
    return mapped.join(legacy, ["agent", "path"], "left").select("agent", "path", F.coalesce("owner", "root_path").alias("root_path"))
