"""Ownership of replayed requests, kept up to date over a stream of requests.

The state of a request key is the session that owns it: the one of smallest start, then id, then path. It stays of one
size however many sessions replay the request, and requests of any age are accepted, so no watermark drops a late
session: if it started earlier it takes the request back, and the owner before is told.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEY = ["agent", "message_id", "request_id"]
OWNER = "started_us bigint, session_id string, path string"
OUTPUT = f"agent string, message_id string, request_id string, {OWNER}, is_duplicate boolean, owner_path string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NO_START = -(1 << 62)  # a missing start is the earliest


class SmallestStart(StatefulProcessor):
    """Emits every request that came, and the one whose owner changed, with what it is now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", OWNER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.owner.get()) if self.owner.exists() else None
        best = before
        came = set()
        for frame in rows:
            mine = list(zip(frame["started_us"].tolist(), frame["session_id"].tolist(), frame["path"].tolist()))
            came.update(mine)
            least = min(mine)
            best = least if best is None or least < best else best
        if best != before:
            self.owner.update(best)
            if before is not None:
                came.add(before)
        out = [(*key, *each, each != best, best[2]) for each in sorted(came)]
        yield pd.DataFrame(out, columns=[*KEY, "started_us", "session_id", "path", "is_duplicate", "owner_path"])

    def close(self) -> None:
        pass


def reattribute(requests: DataFrame) -> DataFrame:
    """Changes of ownership of a stream of requests (``agent, message_id, request_id, session_id, path, started_at``).

    For one key and session the last row holds. A request without a message id is always its own session's, and passes
    without a state.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    started = F.coalesce(F.unix_micros("started_at"), F.lit(_NO_START)).alias("started_us")
    flat = requests.select(text("agent"), text("message_id"), text("request_id"), started, text("session_id"), text("path"))
    alone = flat.where("message_id = ''").withColumns({"is_duplicate": F.lit(False), "owner_path": F.col("path")})
    kept = flat.where("message_id <> ''").groupBy(*KEY).transformWithStateInPandas(SmallestStart(), outputStructType=OUTPUT, outputMode="update", timeMode="none")
    return kept.unionByName(alone)
