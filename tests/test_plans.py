"""Blocked scans and folds equal their sequential meaning, whatever the blocks."""

from __future__ import annotations

import random

import pytest
from helpers import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlake.operators.ledger import dedup_requests
from sessionlake.operators.timeline import mirror_dedup
from sessionlake.plans.running import Running, following, running
from sessionlake.sources.records import REQUEST_COLUMNS


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab") if at % 3 else "hot", at, rng.choice([None, rng.randrange(50)])) for at in range(400)]
    return spark.createDataFrame(data, "g string, at long, v long").cache()


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_equals_one_window(numbers, width):
    whole = W.partitionBy("g").orderBy("at")
    upto, before = whole.rowsBetween(W.unboundedPreceding, 0), whole.rowsBetween(W.unboundedPreceding, -1)
    specs = {
        "s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), inclusive=False), "l": Running("last", F.col("v")),
        "f": Running("first", F.col("v"), inclusive=False), "n": Running("min", F.col("v")),
    }
    got = running(numbers, ["g"], [F.col("at")], F.floor(F.col("at") / width), specs)
    want = numbers.select(
        "g", "at", F.sum("v").over(upto).alias("s"), F.max("v").over(before).alias("m"), F.last("v", True).over(upto).alias("l"),
        F.first("v", True).over(before).alias("f"), F.min("v").over(upto).alias("n"),
    )
    columns = ["g", "at", "s", "m", "l", "f", "n"]
    assert rows(got, *columns, order=["g", "at"]) == rows(want, *columns, order=["g", "at"])


def test_following(numbers):
    got = following(numbers, ["g"], [F.col("at")], F.floor(F.col("at") / 5), "x", F.col("v"))
    after = W.partitionBy("g").orderBy("at").rowsBetween(1, W.unboundedFollowing)
    want = numbers.select("g", "at", F.first("v", True).over(after).alias("x"))
    assert rows(got, "g", "at", "x", order=["g", "at"]) == rows(want, "g", "at", "x", order=["g", "at"])


def fold_by_hand(data):
    """The mirror rule, row after row."""
    kept, candidate, slots = [], False, []
    for seq, role, key, billed in data:
        slot = seq
        if role == "token":
            if billed and not candidate:
                kept.append(("", seq))
            candidate = False
        else:
            match = [old for text, old in kept[-16:] if key and text == key]
            if match:
                slot = match[-1]
            else:
                kept.append((key, seq))
                candidate = candidate or role == "target"
        slots.append((seq, slot))
    return slots


@pytest.mark.parametrize("per_block", [8192, 25])
def test_mirror_dedup_blocks(spark, per_block):
    rng = random.Random(11)
    data = [(seq, rng.choice(["target", "other", "token"]), rng.choice(["", "x", "y", "z", f"u{seq}"]), rng.random() < 0.5) for seq in range(300)]
    frame = spark.createDataFrame([("n", *row) for row in data], "node string, seq long, role string, key string, billed boolean")
    got = mirror_dedup(frame, ["node"], F.floor(F.col("seq") / 40), per_block)
    assert rows(got, "seq", "slot", order="seq") == fold_by_hand(data)


def request(at, message, request_id, total, sidechain=False, speed=""):
    return ("claude", "file", message, request_id, at * 100, 0, sidechain, False, "oak-1", total, 0, 0, 0, 0, False, speed, None)


@pytest.mark.parametrize(
    "reports, want",
    [
        ([("m", "r", 5), ("m", "r", 9), ("m", "r", 9)], [("r", 9, 1)]),
        ([("m", "r", 50, True), ("m", "r", 1)], [("r", 1, 1)]),
        ([("m", "r", 5), ("m", "r", 5, False, "fast")], [("r", 5, 1)]),
        ([("m", "", 5), ("m", "r", 7), ("m", "s", 3)], [("r", 7, 1), ("s", 3, 2)]),
        ([("m", "r", 7), ("m", "", 3), ("m", "s", 4)], [("r", 7, 0), ("s", 4, 2)]),
        ([("m", "", 9), ("m", "r", 7), ("m", "s", 3)], [("", 9, 0)]),
        ([("", "r", 1), ("", "r", 1)], [("r", 1, 0), ("r", 1, 1)]),
    ],
)
def test_dedup_cases(spark, reports, want):
    data = [request(at, *report) for at, report in enumerate(reports)]
    types = dict(zip(REQUEST_COLUMNS, ["string"] * 4 + ["long", "int", "boolean", "boolean", "string"] + ["long"] * 5 + ["boolean", "string", "double"]))
    frame = spark.createDataFrame(data, ", ".join(f"{name} {kind}" for name, kind in types.items()))
    got = dedup_requests(frame)
    found = sorted(rows(got, "request_id", "input", (F.col("byte_offset") / 100).cast("int")))
    assert found == sorted(want)


def test_small_groups_are_folded_many_in_a_call(spark):
    import pandas as pd

    from sessionlake.plans.blockfold import fold_blocks

    def step(rows, state):
        total = rows["value"].cumsum() + int(state or 0)
        return pd.DataFrame({"total": total}), str(total.iloc[-1])

    rows = [(None if g == 7 else f"g{g}", at, g + at) for g in range(60) for at in range(40 if g == 5 else 3)]
    frame = spark.createDataFrame(rows, "g string, at long, value long").repartition(5)
    for limit in (8192, 10):  # all groups whole; one cut into blocks
        found = fold_blocks(frame, ["g"], "at", F.floor(F.col("at") / 16), step, "total long", limit)
        want = {}
        for g, at, value in rows:
            want[g, at] = want.get((g, at - 1), 0) + value
        assert {(r.g, r.at): r.total for r in found.collect()} == want
        assert "__bin" in found._jdf.queryExecution().analyzed().toString()
