"""Numbered states of a folder of tables; a state is seen whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError


class Conflict(RuntimeError):
    """Another writer took the version first; the work can be repeated from its state."""


class Versions:
    """JSON states ``<folder>/versions/<number>.json`` in any file system that Spark can reach.

    A state is written aside and renamed without overwriting, so readers never see half of it and of two
    writers of one number one fails. The highest number is the state in force.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/versions"
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        system, folder = self._system(), self._fs.Path(self.folder)
        if not system.exists(folder):
            return []
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._system().open(self._path(f"{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """Number and state in force; 0 and nothing before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, state: dict) -> None:
        aside = self._path(f".{uuid.uuid4().hex}")
        stream = self._system().create(aside, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        never = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            self._fs.FileContext.getFileContext(self._system().getUri(), self._conf).rename(self._system().makeQualified(aside), self._system().makeQualified(self._path(f"{number}.json")), never)
        except Py4JJavaError as error:
            self._system().delete(aside, False)
            raise Conflict(f"version {number} was taken") from error

    def forget(self, path: str) -> None:
        self._system().delete(self._fs.Path(path), True)

    def drop(self, number: int) -> None:
        self._system().delete(self._path(f"{number}.json"), False)
