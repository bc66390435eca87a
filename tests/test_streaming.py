"""Tailing, incremental refresh and re-attribution."""

from __future__ import annotations

import json
import time

import pytest
from fixtures import assistant, text, tokens, user, write
from helpers import rows

from sessionlake.streaming.store import Store
from sessionlake.streaming.tail import Tail


def session(sid, at, *requests):
    records = [{**user(f"Start {sid}", at), "sessionId": sid}]
    for nth, mid in enumerate(requests):
        records.append({**assistant([text(f"{sid} {mid}")], tokens(10, 1), at + nth + 1, mid=mid, rid=mid), "sessionId": sid})
    return records


def owned(store, prices):
    return {row.session_id: row.total_uncached_input for row in store.corpus(prices).roots.collect()}


def test_refresh_and_reattribution(spark, prices, tmp_path):
    root, folder = tmp_path / "in", tmp_path / "tables"
    write(root / "p" / "b.jsonl", *session("b", 20, "m1", "m2"))
    store = Store(spark, str(folder), {"claude": str(root)}, compact_after=3)
    assert store.refresh(prices) == 1
    assert store.refresh(prices) == 0
    assert owned(store, prices) == {"b": 20}
    # A late session that started earlier takes the shared request over.
    write(root / "p" / "a.jsonl", *session("a", 5, "m1"))
    assert store.refresh(prices) == 1
    assert owned(store, prices) == {"a": 10, "b": 10}
    with open(root / "p" / "b.jsonl", "a") as file:
        import json

        file.write(json.dumps({**assistant([text("more")], tokens(7, 1), 40, mid="m9", rid="m9"), "sessionId": "b"}) + "\n")
    assert store.refresh(prices) == 1
    assert owned(store, prices) == {"a": 10, "b": 17}
    (root / "p" / "a.jsonl").unlink()
    assert store.refresh(prices) == 1
    assert owned(store, prices) == {"b": 27}


def test_tail_reads_complete_lines_once(spark, tmp_path):
    root = tmp_path / "in"
    path = write(root / "x.jsonl", '{"n": 1}', '{"n": 2}', '{"n": 3', end="")
    tail = Tail(spark, {"claude": f"file://{root}"}, str(tmp_path / "tail"))
    stream, out = tail.stream(), tmp_path / "out"

    def drain():
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    drain()  # before the first poll there is no version and nothing to read
    assert tail.poll() == 1 and tail.poll() == 1
    drain()
    assert rows(spark.read.parquet(str(out)), "line", order="byte_offset") == [('{"n": 1}',), ('{"n": 2}',)]
    with open(path, "a") as file:
        file.write('}\n{"n": 4}\n')
    write(root / "deep" / "y.jsonl", "first")
    assert tail.poll() == 2
    with open(path, "a") as file:
        file.write("no end of line yet")
    assert tail.poll() == 3  # a longer file without a new line moves its size alone
    drain()
    found = rows(spark.read.parquet(str(out)), "byte_offset", "line", order=["line", "byte_offset"])
    assert found == [(0, "first"), (0, '{"n": 1}'), (9, '{"n": 2}'), (18, '{"n": 3}'), (27, '{"n": 4}')]
    write(path, "anew")
    assert tail.poll() == 4
    drain()
    assert (0, "anew") in rows(spark.read.parquet(str(out)), "byte_offset", "line")
    # The offset is a number, however many files there are.
    offsets = sorted((tmp_path / "cp" / "offsets").glob("[0-9]*"))
    assert json.loads(offsets[-1].read_text().splitlines()[-1]) == {"version": 4}


def test_line_ends_behind_a_uri(tmp_path):
    from sessionlake.streaming.tail import line_end

    path = tmp_path / "z.jsonl"
    path.write_bytes(b"one\n" + b"x" * 200_000)
    assert line_end(f"file://{path}", 200_004) == 4
    assert line_end(str(path), 200_004, least=4) == 4
    assert line_end(str(path), 2) == 0


def test_many_files_in_one_poll(spark, tmp_path):
    root = tmp_path / "in"
    for n in range(2_000):
        folder = root / str(n % 40)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{n}.jsonl").write_text(f"line {n}\n")
    tail = Tail(spark, {"claude": str(root)}, str(tmp_path / "tail"))
    assert tail.poll() == 1
    read = tail.stream().writeStream.format("memory").queryName("many_files").trigger(availableNow=True).start()
    read.awaitTermination(120)
    assert spark.table("many_files").agg({"line": "count"}).first()[0] == 2_000


def test_readers_keep_their_version(spark, prices, tmp_path):
    from sessionlake.streaming.versions import Conflict

    root = tmp_path / "in"
    write(root / "p" / "b.jsonl", *session("b", 20, "m1", "m2"))
    write(root / "p" / "c.jsonl", *session("c", 30, "m3"))
    store = Store(spark, str(tmp_path / "tables"), {"claude": str(root)}, compact_after=2)
    store.refresh(prices)
    before = store.corpus(prices)
    held = before.file_events
    write(root / "p" / "b.jsonl", *session("b", 20, "m1", "m2", "m4"))
    assert store.refresh(prices) == 1
    # One changed file adds its own rows and nothing else.
    number, state = store.versions.latest()
    part = spark.read.parquet(state["tables"]["ledger"]["parts"][-1])
    assert {row.node_id.rsplit("/", 1)[-1] for row in part.collect()} == {"b.jsonl"}
    assert rows(store.affected().selectExpr("substring_index(root_path, '/', -1)")) == [("b.jsonl",)]
    # A reader of the version before goes on with it, over a compaction as well.
    write(root / "p" / "d.jsonl", *session("d", 40, "m5"))
    assert store.refresh(prices) == 1
    after = store.versions.latest()[1]
    assert len(after["tables"]["ledger"]["parts"]) == 1 and after["dead"] == 0
    assert held.where("kind = 'assistant-text'").count() == 3 and before.ledger.count() == 3
    assert store.corpus(prices).ledger.count() == 5
    assert store.corpus(prices).file_events.where("kind = 'assistant-text'").count() == 5
    with pytest.raises(Conflict):
        store.versions.commit(number, {})
    assert store.vacuum(keep=1) > 0
    assert store.corpus(prices).ledger.count() == 5 and store.refresh(prices) == 0


def test_search_skips_files_by_their_grams(spark, prices, tmp_path):
    from sessionlake.operators import search

    root = tmp_path / "in"
    for sid in ("s1", "s2", "s3"):
        write(root / "p" / f"{sid}.jsonl", *session(sid, 20, *[f"Long-enough-{sid}-{n}" for n in range(5)]))
    store = Store(spark, str(tmp_path / "tables"), {"claude": str(root)})
    store.refresh(prices)
    corpus = store.corpus(prices)

    def hits(pattern, **options):
        plain, skipping = (rows(search.search_hits(corpus.nodes, corpus.events, corpus.pairs, pattern, index=index, **options), "ref", "event_index", "range_start", "matches") for index in (None, corpus.event_grams))
        assert sorted(plain) == sorted(skipping)
        return len(plain)

    assert hits("long-ENOUGH-s2") == 5 and hits("long-ENOUGH-s2", case_sensitive=True) == 0
    assert hits("Long-enough", case_sensitive=True) == 15 and hits("s3") > 0 and hits("nowhere-at-all") == 0 and hits("e.ough", regex=True) == 15
    kept = search._only_promising(corpus.file_events, corpus.event_grams, "nowhere-at-all", False)
    assert "LocalTableScan" in kept._jdf.queryExecution().executedPlan().toString() or kept.count() == 0
    one = search._only_promising(corpus.file_events, corpus.event_grams, "long-enough-s2-3", False)
    assert {row.path.rsplit("/", 1)[-1] for row in one.select("path").collect()} == {"s2.jsonl"}


def test_follow_refreshes_the_store(spark, prices, tmp_path):
    from sessionlake.streaming.store import follow

    root = tmp_path / "in"
    write(root / "p" / "b.jsonl", *session("b", 20, "m1", "m2"))
    store = Store(spark, str(tmp_path / "tables"), {"claude": str(root)})
    seen = []
    query = follow(spark, store, prices, "1 second", after=lambda fresh: seen.append(fresh.table("manifest").count()))
    deadline = time.time() + 240
    try:
        while not seen and query.isActive and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen == [1]
    assert owned(store, prices) == {"b": 20}


def test_late_sessions_take_requests_back(spark, tmp_path):
    from datetime import datetime

    from sessionlake.streaming.ownership import STATE_STORE, reattribute

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = "agent string, message_id string, request_id string, session_id string, path string, started_at timestamp"
    at = lambda hour: datetime(2026, 1, 1, hour)
    batches = [
        [("x", "m1", "r", "b", "/b", at(9)), ("x", "m1", "r", "c", "/c", at(10)), ("x", "m2", "r", "c", "/c", at(10)), ("x", "", "r", "c", "/c", at(10))],
        [("x", "m1", "r", "d", "/d", at(11)), ("x", "m3", None, "d", "/d", at(11)), ("x", "", "r", "b", "/b", at(9))],
        [("x", "m1", "r", "a", "/a", at(1)), ("x", "m2", "r", "z", "/z", None)],  # late, and one without a start
    ]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    changes = []

    def note(batch, _):
        changes.append(sorted((row.message_id, row.session_id, row.is_duplicate, row.owner_path) for row in batch.collect()))

    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = reattribute(stream).writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    changes = [batch for batch in changes if batch]
    assert changes == [
        [("", "c", False, "/c"), ("m1", "b", False, "/b"), ("m1", "c", True, "/b"), ("m2", "c", False, "/c")],
        [("", "b", False, "/b"), ("m1", "d", True, "/b"), ("m3", "d", False, "/d")],
        # Only the late session and the owners before it are named again.
        [("m1", "a", False, "/a"), ("m1", "b", True, "/a"), ("m2", "c", True, "/z"), ("m2", "z", False, "/z")],
    ]
