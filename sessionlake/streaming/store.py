"""Per-file tables that are refreshed incrementally, and the corpus read from them.

Everything a file contributes depends on that file alone, so a changed file is parsed again, its new rows are written
as one more part of each table, and its old rows are listed as dead; nothing else is touched. A state names the parts
of all tables and is put in force by one rename, so a reader sees one version of everything while a refresh runs. When
parts pile up they are written together without the dead rows. What crosses files (links, prices, ownership, rollups) is recomputed
from these compact tables, so a late session that started earlier takes its requests back by itself.
"""

from __future__ import annotations

import json
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.corpus import Corpus
from sessionlake.operators.manifest import affected_roots, diff_manifest, file_manifest
from sessionlake.operators.search import gram_index
from sessionlake.plans.joins import BROADCAST_ROWS
from sessionlake.plans.staging import stage
from sessionlake.sources import scan
from sessionlake.streaming.versions import Versions

PARSER_VERSION = "2"
COMPACT_AFTER = 16

# Table name -> the column that names its file.
FILE_TABLES = {
    "claude_summaries": "path",
    "runs": "path",
    "codex_summaries": "path",
    "codex_activities": "path",
    "codex_models": "node_id",
    "ledger": "node_id",
    "file_events": "path",
}
KEYS = FILE_TABLES | {"event_grams": "path", "diagnostics": "path", "manifest": "path"}


class Store:
    """Tables below one folder, each a few Parquet parts whose rows name their file and the version that wrote them."""

    def __init__(self, spark: SparkSession, folder: str, roots: dict[str, str | list[str]], compact_after: int = COMPACT_AFTER):
        self.spark, self.folder, self.roots, self.compact_after = spark, folder.rstrip("/"), roots, compact_after
        self.versions = Versions(spark, self.folder)

    def table(self, name: str, state: dict | None = None) -> DataFrame | None:
        """The live rows of a table in a state (the one in force by default), or None before the first refresh."""
        state = self.versions.latest()[1] if state is None else state
        if not state:
            return None
        rows = self._parts(state, name)
        if not state["dead"]:
            return rows
        dead = self._parts(state, "dead")
        dead = F.broadcast(dead) if state["dead"] <= BROADCAST_ROWS else dead
        return rows.join(dead.select(F.col("path").alias(KEYS[name]), "generation"), [KEYS[name], "generation"], "left_anti").select(*rows.columns)

    def _parts(self, state: dict, name: str) -> DataFrame:
        held = state["tables"][name]
        return self.spark.read.schema(T.StructType.fromJson(held["schema"])).parquet(*held["parts"])

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.folder}/data/{name}/{uuid.uuid4().hex}"
        key = KEYS.get(name)
        (rows.sortWithinPartitions(key) if key else rows).write.parquet(path)
        return path

    def _extended(self, state: dict, name: str, rows: DataFrame) -> dict:
        before = state.get("tables", {}).get(name, {"parts": []})
        return {"schema": json.loads(rows.schema.json()), "parts": [*before["parts"], self._write(rows, name)]}

    def refresh(self, prices: DataFrame) -> int:
        """Parse created and changed files, forget removed ones; returns the number of differing files.

        An interrupted refresh leaves unnamed parts behind and is simply repeated; ``vacuum`` removes them.
        """
        number, state = self.versions.latest()
        generation = number + 1
        files = stage(scan.list_files(self.spark, self.roots), "files")
        new = file_manifest(files, PARSER_VERSION)
        known = self.table("manifest", state) if state else new.limit(0).withColumn("generation", F.lit(0).cast("bigint"))
        was = known.select("agent", "path", F.col("generation").alias("was"))
        changes = stage(diff_manifest(new, known).join(was, ["agent", "path"], "left"), "changes")
        count = changes.count()
        if count == 0:
            return 0
        dirty = files.join(changes.where("change <> 'removed'"), ["agent", "path"], "left_semi")
        raw = stage(scan.scan_files(dirty).sortWithinPartitions("agent", "path", "byte_offset"), "raw")
        corpus = Corpus(self.spark, dirty, raw, prices)
        bad = stage(scan.skip_malformed(raw)[1], "bad")
        # A file that could not be read has no fingerprint, so that the next refresh tries it again.
        lost = bad.where("code = 'unreadable_session'").select("agent", "path").distinct().withColumn("lost", F.lit(True))
        seen = new.join(changes.where("change <> 'removed'").select("agent", "path"), ["agent", "path"], "left_semi").join(lost, ["agent", "path"], "left")
        manifest = seen.withColumn("fingerprint", F.when(F.col("lost"), "").otherwise(F.col("fingerprint"))).drop("lost")
        fresh = {name: getattr(corpus, name) for name in FILE_TABLES} | {"event_grams": gram_index(corpus.file_events), "diagnostics": bad, "manifest": manifest}
        dead = changes.where("was IS NOT NULL").select("path", F.col("was").alias("generation"))
        tables = {name: self._extended(state, name, rows.withColumn("generation", F.lit(generation).cast("bigint"))) for name, rows in fresh.items()}
        tables["dead"] = self._extended(state, "dead", dead)
        changed = self._write(changes.select("agent", "path", "change"), "changes")
        after = {"tables": tables, "dead": state.get("dead", 0) + dead.count(), "changes": changed}
        self.versions.commit(generation, after)
        if len(tables["manifest"]["parts"]) > self.compact_after:
            self.compact()
        return count

    def affected(self) -> DataFrame:
        """``agent, root_path``: the top-level transcripts that the files of the last refresh belong to."""
        state = self.versions.latest()[1]
        changed = self.spark.read.parquet(state["changes"])
        known = self.table("claude_summaries", state).select("agent", "path", "file_session_id")
        return affected_roots(changed, known).select("agent", "root_path").distinct()

    def compact(self) -> None:
        """Write the live rows of every table as one part, as a version of its own."""
        number, state = self.versions.latest()
        tables = {name: {"schema": state["tables"][name]["schema"], "parts": [self._write(self.table(name, state), name)]} for name in KEYS}
        tables["dead"] = {"schema": state["tables"]["dead"]["schema"], "parts": [self._write(self._parts(state, "dead").limit(0), "dead")]}
        self.versions.commit(number + 1, {"tables": tables, "dead": 0, "changes": state["changes"]})

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` versions and the parts that none of these names; returns how many parts went.

        A reader of an older version loses its files, and so does a refresh that is under way; run it when there is neither.
        """
        numbers = self.versions.numbers()
        states = [self.versions.read(number) for number in numbers[-keep:]]
        named = {path for state in states for held in state["tables"].values() for path in held["parts"]} | {state["changes"] for state in states}
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        found = hadoop(f"{self.folder}/data/*/*")
        listed = found.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(found) or []
        gone = 0
        for status in listed:
            path = status.getPath()
            if f"{self.folder}/data/{path.getParent().getName()}/{path.getName()}" not in named:
                self.versions.forget(path.toString())
                gone += 1
        for number in numbers[:-keep]:
            self.versions.drop(number)
        return gone

    def corpus(self, prices: DataFrame, default_model: str | None = None) -> Corpus:
        """Canonical tables over one version of the stored per-file tables; no transcript is read."""
        state = self.versions.latest()[1]
        files = self.table("manifest", state).select("agent", "path", "size_bytes", "modified_at")
        return StoredCorpus(self.spark, files, None, prices, default_model, self, state)


class StoredCorpus(Corpus):
    """A corpus whose per-file tables come from one version of a store."""

    def __init__(self, spark, files, raw, prices, default_model, store: Store, state: dict):
        super().__init__(spark, files, raw, prices, default_model)
        self.store, self.state = store, state

    @cached_property
    def diagnostics(self) -> DataFrame:
        """What the refreshes could not read or parse, and the trees without a clear address."""
        stored = self.store.table("diagnostics", self.state)
        return stored.select(*self._addressed[1].columns).unionByName(self._addressed[1])

    @cached_property
    def events(self) -> DataFrame:
        """Read through to the stored timelines, so a query touches only the rows it needs."""
        return self.linked_events()

    @cached_property
    def event_grams(self) -> DataFrame:
        """Filters over the grams of every file's searchable texts, for ``search_hits``."""
        return self.store.table("event_grams", self.state).select("path", "bits")


def _stored(name: str):
    prop = cached_property(lambda self: self.store.table(name, self.state).drop("generation"))
    prop.__set_name__(StoredCorpus, name)
    return prop


for _name in FILE_TABLES:
    setattr(StoredCorpus, _name, _stored(_name))


def follow(spark: SparkSession, store: Store, prices: DataFrame, every: str = "2 seconds", after=None):
    """Keep a store fresh: whatever is appended, created or removed within a trigger becomes one refresh.

    Files are listed in tasks and only those that differ are parsed. ``after(store)`` runs behind every refresh that changed
    something; ``store.affected()`` then names the sessions to look at.
    """

    def apply(_: DataFrame, __: int) -> None:
        if store.refresh(prices) and after is not None:
            after(store)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(apply).trigger(processingTime=every).start()
