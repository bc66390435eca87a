"""A streaming source that tails growing transcript files.

The built-in file source takes every file once and never looks at it again. Here a poll lists the roots in Spark tasks,
finds the last complete line of every file that grew in tasks too, writes the byte ranges that are new as a table, and
puts that in force as the next version. The offset of the stream is the number of a version: neither it nor the
driver ever holds a list of files, and a version that is read again gives the same lines.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sessionlake.plans.staging import stage
from sessionlake.sources.scan import RAW_SCHEMA, SPLIT_BYTES, _read_range, list_files
from sessionlake.streaming.versions import Versions

FORMAT = "transcript_tail"
COMPACT_AFTER = 16
_TAIL_BYTES = 64 * 1024


def _system(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def line_end(path: str, size: int, least: int = 0) -> int:
    """Position after the last line feed of the first ``size`` bytes, ``least`` if there is none behind it."""
    system, inner = _system(path)
    with system.open_input_file(inner) as stream:
        stop = min(size, stream.size())
        while stop > least:
            start = max(least, stop - _TAIL_BYTES)
            at = stream.read_at(stop - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return least


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stops = []
        for path, size, begin in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            try:
                stops.append(line_end(path, size, begin))
            except FileNotFoundError:
                stops.append(begin)  # gone since it was listed
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stops, pa.int64())], ["agent", "path", "size_bytes", "begin", "stop"])


class Tail:
    """Versions of the roots' files below a shared folder: where each file's complete lines end, and what came new."""

    def __init__(self, spark: SparkSession, roots: dict[str, str | list[str]], folder: str):
        self.spark, self.roots, self.folder = spark, roots, folder.rstrip("/")
        self.versions = Versions(spark, self.folder)

    def _positions(self, state: dict) -> DataFrame:
        empty = self.spark.createDataFrame([], "agent string, path string, size_bytes long, stop long, version long")
        if not state:
            return empty.drop("version")
        rows = self.spark.read.schema(empty.schema).parquet(*state["positions"])
        last = rows.groupBy("agent", "path").agg(F.max_by(F.struct("size_bytes", "stop"), "version").alias("last"))
        return last.select("agent", "path", "last.size_bytes", "last.stop")

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def poll(self) -> int:
        """Look at the roots once; returns the number of the version in force, a new one if a file has new lines.

        A file that became shorter is read again from its beginning.
        """
        number, state = self.versions.latest()
        known = self._positions(state).select("agent", "path", F.col("size_bytes").alias("was"), "stop")
        listed = list_files(self.spark, self.roots).join(known, ["agent", "path"], "left")
        grown = listed.where("was IS NULL OR was <> size_bytes")
        begin = F.when(F.col("size_bytes") >= F.col("stop"), F.col("stop")).otherwise(0)
        asked = grown.select("agent", "path", "size_bytes", F.coalesce(begin, F.lit(0)).cast("bigint").alias("begin"))
        found = stage(asked.repartition("agent", "path").mapInArrow(_ends, "agent string, path string, size_bytes long, begin long, stop long"), "tail-ends")
        if found.isEmpty():
            return number
        total = found.agg(F.sum(F.col("stop") - F.col("begin"))).first()[0] or 0
        cuts = found.where("stop > begin").withColumn("at", F.explode(F.sequence("begin", F.col("stop") - 1, F.lit(SPLIT_BYTES))))
        ranges = cuts.select("agent", "path", F.col("at").alias("start"), F.least(F.col("at") + SPLIT_BYTES, F.col("stop")).alias("stop"))
        tasks = max(int(total // SPLIT_BYTES) + 1, self.spark.sparkContext.defaultParallelism)
        positions = found.select("agent", "path", "size_bytes", "stop", F.lit(number + 1).cast("bigint").alias("version"))
        held = state.get("positions", [])
        if len(held) >= COMPACT_AFTER:
            held = [self._write(self._positions(state).withColumn("version", F.lit(number).cast("bigint")), "positions")]
        after = {"ranges": self._write(ranges.repartition(tasks, "path", "start"), "ranges"), "positions": [*held, self._write(positions, "positions")]}
        self.versions.commit(number + 1, after)
        return number + 1

    def stream(self) -> DataFrame:
        """Streaming ``raw_records`` of complete lines, version by version."""
        self.spark.dataSource.register(TranscriptTail)
        return self.spark.readStream.format(FORMAT).option("folder", self.folder).load()

    def keep_polling(self, seconds: float = 2.0) -> threading.Event:
        """Poll in the background until the returned event is set."""
        done = threading.Event()

        def work() -> None:
            while not done.wait(seconds):
                self.poll()

        threading.Thread(target=work, daemon=True).start()
        return done


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TranscriptTail(DataSource):
    """``spark.readStream.format("transcript_tail").option("folder", folder)`` over the versions of a ``Tail``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RAW_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["folder"])


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, inner = _system(f"{self.folder}/versions")
        names = [info.base_name[:-5] for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if info.base_name.endswith(".json")]
        return {"version": max((int(name) for name in names if name.isdigit()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """One for each file of the tables of ranges: as many as the tasks that wrote them."""
        from pyarrow import fs

        out = []
        for number in range(start["version"] + 1, end["version"] + 1):
            system, inner = _system(f"{self.folder}/versions/{number}.json")
            with system.open_input_file(inner) as stream:
                table = json.loads(stream.read())["ranges"]
            system, inner = _system(table)
            out += [Part(f"{table}/{info.base_name}") for info in system.get_file_info(fs.FileSelector(inner)) if info.base_name.endswith(".parquet")]
        return sorted(out, key=lambda part: part.path) or [Part("")]

    def read(self, partition: Part):
        import pyarrow.parquet as pq

        if not partition.path:
            return
        system, inner = _system(partition.path)
        for agent, path, start, stop in zip(*pq.read_table(inner, filesystem=system).select(["agent", "path", "start", "stop"]).to_pydict().values()):
            where, name = _system(path)
            with where.open_input_file(name) as stream:
                yield from _read_range(stream, agent, path, start, stop)

    def commit(self, end: dict) -> None:
        pass
