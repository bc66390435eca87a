"""Scan, prices, ownership, selectors, paging and the sink on small inputs."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from helpers import rows
from fixtures import write
from pyspark.sql import functions as F

from sessionlake.operators import ledger, search, sessions, tree
from sessionlake.operators.manifest import diff_manifest, file_manifest
from sessionlake.sources import scan
from sessionlake.sources.pricing import PricingError, load_pricing, overlay_pricing


def test_scan_offsets_for_any_split(spark, tmp_path):
    path = tmp_path / "in" / "a.jsonl"
    path.parent.mkdir()
    body = '{"a": 1}\r\n\n{"é": "😀"}\n\r\n' + '{"long": "' + "x" * 300 + '"}\n{"end": 1}'
    path.write_bytes(body.encode())
    raw = body.encode()
    want, at = [], 0
    for line in raw.split(b"\n"):
        bare = line[:-1] if line.endswith(b"\r") else line
        if bare:
            want.append((at, len(bare), bare.decode()))
        at += len(line) + 1
    for split in (1, 7, 64, 1 << 20):
        got = scan.scan_jsonl(spark, {"claude": str(path.parent)}, split)
        assert rows(got, "byte_offset", "byte_length", "line", order="byte_offset") == want


def test_oversized_and_malformed(spark, tmp_path):
    big = '{"x": "' + "y" * scan.MAX_LINE_BYTES + '"}'
    write(tmp_path / "in" / "b.jsonl", '{"a": 1}', big, '{"a": 2}', "{oops", end="")
    raw = scan.scan_jsonl(spark, {"codex": str(tmp_path / "in")}).cache()
    good, bad = scan.skip_malformed(raw)
    assert rows(good, "line", order="byte_offset") == [('{"a": 1}',), ('{"a": 2}',)]
    assert rows(bad, "code", order="byte_offset") == [("oversized_line",), ("malformed_line",)]


def test_unreadable_file_is_reported(spark):
    files = spark.createDataFrame([("claude", "/nowhere/x.jsonl", 10)], "agent string, path string, size_bytes long")
    good, bad = scan.skip_malformed(scan.scan_files(files))
    assert good.count() == 0
    assert rows(bad, "path", "code") == [("/nowhere/x.jsonl", "unreadable_session")]
    nodes = spark.createDataFrame([("claude", "n", "n", "/nowhere.jsonl")], "agent string, node_id string, start_id string, path string")
    with pytest.raises(search.UnreadableScope):
        search.require_readable(nodes, bad.withColumn("path", F.lit("/nowhere/subagents/x.jsonl")))
    search.require_readable(nodes, bad.withColumn("path", F.lit("/elsewhere/x.jsonl")))


def test_path_roles(spark):
    paths = [
        "/r/p/s.jsonl", "/r/p/s/subagents/c.jsonl", "/r/p/s/subagents/w/g/agent-a.jsonl", "/r/p/s/subagents/w/g/journal.jsonl",
        "/r/p/agent-old.jsonl", "/r/p/s/subagents/c/agent-x.jsonl", "/r/p/s/subagents/c/subagents/d.jsonl",
    ]
    files = spark.createDataFrame([("claude", path) for path in paths], "agent string, path string")
    found = {row.path: (row.role, row.parent_path, row.group_dir) for row in scan.classify_path(files).collect()}
    assert found["/r/p/s.jsonl"] == ("root", None, None)
    assert found["/r/p/s/subagents/c.jsonl"][:2] == ("child", "/r/p/s.jsonl")
    assert found["/r/p/s/subagents/w/g/agent-a.jsonl"] == ("member", "/r/p/s.jsonl", "/r/p/s/subagents/w/g")
    assert found["/r/p/s/subagents/w/g/journal.jsonl"][0] == "ignored"
    assert found["/r/p/agent-old.jsonl"][0] == "legacy"
    # The directory belongs to the transcript c.jsonl, which does not list it as a child.
    assert found["/r/p/s/subagents/c/agent-x.jsonl"][0] == "ignored"
    assert found["/r/p/s/subagents/c/subagents/d.jsonl"][:2] == ("child", "/r/p/s/subagents/c.jsonl")


def test_graph_tasks_hold_a_bounded_number_of_paths(spark):
    from sessionlake.operators import graph

    number = F.col("id").cast("string")
    path = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/r/s"), number, F.lit(".jsonl"))).otherwise(
        F.concat(F.lit("/r/s"), (F.col("id") - 1).cast("string"), F.lit("/subagents/c"), number, F.lit(".jsonl")))
    files = spark.range(300_000).select(F.lit("claude").alias("agent"), path.alias("path"))
    roles = scan.classify_path(files)
    sizes = lambda df: [row["count"] for row in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes(roles)) == 300_000 and max(sizes(roles)) < 60_000  # adaptive execution made 4 parts or fewer
    text = {name: F.lit("") for name in ["session_id", "file_session_id", "cwd", "project", "title", "title_prompt", "git_branch", "started_raw", "updated_raw", "agent_path", "parent_id"]}
    times = {name: F.lit(None).cast("timestamp") for name in ["started_at", "updated_at"]}
    summaries = files.withColumns({**text, **times, "messages": F.lit(0).cast("bigint"), "has_error": F.lit(False)})
    runs = spark.createDataFrame([], "agent string, path string, run_id string, run_title string")
    _, edges = graph.claude_graph(summaries, roles, runs)
    assert sum(sizes(edges)) == 150_000 and max(sizes(edges)) < 30_000
    few = spark.createDataFrame([("claude", "/r/s.jsonl"), ("claude", "/r/s/subagents/c.jsonl")], "agent string, path string")
    for frame in (scan.classify_path(few), edges):  # all paths are never sent to each task, however small their table is taken to be
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()


def test_price_files(spark, price_file, prices, tmp_path):
    assert sorted(row.model for row in prices.collect()) == ["anthropic/elm-2", "elm-2-fast", "oak-1", "openai/gpt-5"]
    assert prices.where("model = 'elm-2-fast'").first().fast == 2.0
    with pytest.raises(PricingError):
        load_pricing(spark, price_file, strict=True)
    empty = tmp_path / "p.json"
    empty.write_text(json.dumps({"sample_spec": {"input_cost_per_token": 1}}))
    with pytest.raises(PricingError):
        load_pricing(spark, str(empty), strict=True)
    newer = prices.where("model = 'oak-1'").withColumn("input", F.lit(9.0))
    merged = overlay_pricing(prices, newer)
    assert merged.count() == 4 and merged.where("model = 'oak-1'").first().input == 9.0


def attributed(spark, sessions_of, requests):
    starts = spark.createDataFrame([("claude", sid, sid, start) for sid, start in sessions_of], "agent string, node_id string, session_id string, started_at string")
    starts = starts.withColumn("started_at", F.col("started_at").cast("timestamp"))
    frame = spark.createDataFrame(
        [("claude", sid, mid, rid, usd) for sid, mid, rid, usd in requests],
        "agent string, node_id string, message_id string, request_id string, usd double",
    )
    return ledger.attribute_ownership(frame, starts)


def test_ownership(spark):
    times = [("b", "2026-01-02"), ("a", "2026-01-02"), ("c", "2026-01-03"), ("zero", None)]
    reqs = [("a", "m", "r", 1.0), ("b", "m", "r", 2.0), ("c", "m", "r", 4.0), ("b", "n", "r", 8.0), ("zero", "n", "r", 3.0), ("a", "", "", 5.0), ("b", "", "", 5.0)]
    out = attributed(spark, times, reqs)
    owners = {(row.node_id, row.message_id): row.owner_id for row in out.collect()}
    assert owners == {("a", "m"): "a", ("b", "m"): "a", ("c", "m"): "a", ("b", "n"): "zero", ("zero", "n"): "zero", ("a", ""): "a", ("b", ""): "b"}
    assert sorted(rows(ledger.replay_report(out), "node_id", "owner_id", "usd", "requests")) == [("b", "a", 2.0, 1), ("b", "zero", 8.0, 1), ("c", "a", 4.0, 1)]


def test_ownership_does_not_depend_on_partitioning(spark):
    reqs = [(sid, f"m{at % 5}", "r", float(at)) for at, sid in enumerate("abcab" * 6)]
    results = []
    for partitions in ("1", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(sorted(rows(attributed(spark, [("a", "2026-01-03"), ("b", "2026-01-01"), ("c", "2026-01-02")], reqs), "node_id", "message_id", "usd", "owner_id")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_closure_of_deep_and_cyclic_graphs(spark):
    chain = [("x", f"n{at}", f"n{at + 1}") for at in range(100)]
    edges = spark.createDataFrame(chain + [("x", "p", "q"), ("x", "q", "p")], "agent string, parent string, child string")
    pairs = tree.closure(edges)
    assert pairs.where("ancestor = 'n0'").count() == 100
    assert pairs.where("ancestor = 'n0' AND descendant = 'n100'").first().depth == 100
    assert pairs.where("ancestor = 'p'").count() == 1


def test_selectors(spark):
    nodes = spark.createDataFrame(
        [("x:alpha-1", "x", "alpha-1", "/t/a.jsonl", ""), ("x:alpha-2", "x", "alpha-2", "/t/b.jsonl", ""), ("x:alpha-1#k", "x", "k", "/t/a.jsonl#k", "k")],
        "ref string, agent string, session_id string, path string, ref_path string",
    ).withColumns({"project": F.lit("p"), "title": F.lit("t"), "is_group": F.lit(False)})
    asked = spark.createDataFrame([(one,) for one in ["x:alpha-1#k", "/t/b.jsonl", "alpha-1", "alpha-", "alp", "missing-id"]], "selector string")
    found = sorted(rows(tree.resolve_selector(asked, nodes), "selector", "status", "ref"), key=str)
    assert found == sorted([
        ("x:alpha-1#k", "ok", "x:alpha-1#k"), ("/t/b.jsonl", "ok", "x:alpha-2"), ("alpha-1", "ok", "x:alpha-1"),
        ("alpha-", "ambiguous_ref", "x:alpha-1"), ("alpha-", "ambiguous_ref", "x:alpha-2"), ("alp", "usage", None), ("missing-id", "not_found", None),
    ], key=str)


def test_times_and_arguments(spark):
    now = datetime(2026, 3, 1, tzinfo=timezone.utc)
    assert sessions.parse_time("7d", now) == now - timedelta(days=7)
    assert sessions.parse_time("1h30m", now) == now - timedelta(minutes=90)
    assert sessions.parse_time("2026-02-01") == datetime(2026, 2, 1, tzinfo=timezone.utc)
    assert sessions.parse_time("2026-02-01T00:00:00+01:00") == datetime(2026, 1, 31, 23, tzinfo=timezone.utc)
    for bad in ["", "soon", "-3h", "0d", "5"]:
        with pytest.raises(sessions.UsageError):
            sessions.parse_time(bad)
    for call in (lambda: sessions.parse_kinds(["nope"]), lambda: sessions.sort_sessions(None, "size"), lambda: sessions.page(None, [], 0)):
        with pytest.raises(sessions.UsageError):
            call()


def test_budget_and_sink(spark, tmp_path):
    frame = spark.createDataFrame([(at, "x" * 10, None if at else ["a"]) for at in range(9)], "id int, t string, tags array<string>")
    kept = sessions.byte_budget_page(frame, [F.col("id")], budget=35, size=F.octet_length("t"))
    assert rows(kept, "id", order="id") == [(0,), (1,), (2,)]
    assert sessions.byte_budget_page(frame, [F.col("id")], budget=1, size=F.octet_length("t")).count() == 1
    tiny = spark.range(30_000)
    assert sessions.byte_budget_page(tiny, [F.col("id")], budget=1, size=F.lit(0)).count() == 30_000
    assert sessions.page(tiny, [F.col("id").desc()], None, 29_990).count() == 10
    state = sessions.paging_state(tiny, tiny.limit(7), 5).first()
    assert tuple(state) == (30_000, 7, True, 12, False)
    sessions.sink_json(frame.where("id = 1"), str(tmp_path / "out"), "list")
    line = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert line == {"schema_version": 1, "command": "list", "id": 1, "t": "x" * 10, "tags": []}


def test_token_scan(spark):
    names = spark.createDataFrame([("arn:aws:iam::123456789012:role/secret-role",), ("minikube",), ("abc",), ("Green-House",)], "name string")
    tokens = search.scan_tokens(names)
    assert sorted(rows(tokens, "token")) == [("123456789012",), ("Green-House",), ("secret-role",)]
    texts = spark.createDataFrame([(1, "the GREEN-HOUSE of 1234567890123"), (2, "none"), (3, "secret-roles")], "text_id int, text string")
    want = [(1, "123456789012"), (1, "Green-House"), (3, "secret-role")]
    assert sorted(rows(search.token_scan(texts, tokens))) == want
    assert search.token_scan(texts, tokens.where("false")).count() == 0


def test_token_scan_of_long_pieces_and_awkward_tokens(spark):
    import time

    body = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(10_000_000))
    texts = [("long", body), ("long", body[:500]), ("null", None), ("empty", ""), ("edge", "ab"), ("next", "cdé\u0130X"), ("tie", "ab cd"), ("tie", "ab cd")]
    names = [body[9_999_000:9_999_040].upper(), body[5_000_003:5_000_009], "abcd", "b", "É\u0130", "b c", "\u0130x", "", "ab cd", "qqqqqqqqq"]
    frame = spark.createDataFrame(texts, "text_id string, text string").repartition(3)
    tokens = spark.createDataFrame([(name,) for name in names], "token string")
    lowered = {name: spark.range(1).select(F.lower(F.lit(name))).first()[0] for name in names}
    started = time.time()
    found = sorted(set(rows(search.token_scan(frame, tokens))))
    assert time.time() - started < 10
    lower = [(key, spark.range(1).select(F.lower(F.lit(text))).first()[0]) for key, text in texts if text]
    assert found == sorted({(key, name) for key, text in lower for name in names if name and lowered[name] in text})
    assert ("edge", "abcd") not in found  # grams do not cross rows


def test_manifest(spark):
    files = lambda *items: spark.createDataFrame([("x", path, size, datetime(2026, 1, 1)) for path, size in items], "agent string, path string, size_bytes long, modified_at timestamp")
    old, new = file_manifest(files(("a", 1), ("b", 1)), "v1"), file_manifest(files(("b", 2), ("c", 1)), "v1")
    assert sorted(rows(diff_manifest(new, old), "path", "change")) == [("a", "removed"), ("b", "changed"), ("c", "created")]
    assert diff_manifest(file_manifest(files(("a", 1)), "v2"), file_manifest(files(("a", 1)), "v1")).first().change == "changed"


def test_fuzzy_reads_a_title_once(spark):
    import time

    from sessionlake.functions.matching import fuzzy_pattern

    frame = spark.createDataFrame([("a" * 100_000,), ("xaxxaxab.",), ("ab",)], "title string")
    started = time.time()
    assert [row.hit for row in frame.select(F.rlike("title", F.lit(fuzzy_pattern("aaAb"))).alias("hit")).collect()] == [False, True, False]
    assert time.time() - started < 10
    assert frame.where(F.rlike("title", F.lit(fuzzy_pattern("ab.")))).count() == 1


def test_listing_names_hidden_folders(spark, tmp_path):
    from sessionlake.sources.scan import list_files

    for name in ("_x/s.jsonl", ".y/z/t.jsonl", "plain.jsonl", "other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    found = rows(list_files(spark, {"x": [str(tmp_path), str(tmp_path / "none")]}), "path", "size_bytes", order="path")
    assert found == sorted((str(tmp_path / name), 3) for name in ("_x/s.jsonl", ".y/z/t.jsonl", "plain.jsonl"))


def test_counters_saturate(spark):
    from sessionlake.functions.tokens import MAX_COUNTER

    edges = spark.createDataFrame([("x", "p", "q")], "agent string, parent string, child string")
    nodes = spark.createDataFrame([("x", "p"), ("x", "q")], "agent string, node_id string").withColumns(
        {"is_group": F.lit(False), "updated_at": F.lit(None).cast("timestamp"), "updated_raw": F.lit("")})
    usage = spark.createDataFrame([("x", n, 1, 1, MAX_COUNTER, MAX_COUNTER, 1, False, 0.0, False, False, "m", "m") for n in "pq"],
                                  "agent string, node_id string, input long, output long, write_5m long, write_1h long, cache_read long, "
                                  "includes_cache_read boolean, usd double, estimated boolean, missing boolean, model string, pricing_model string")
    rolled = tree.rollup(nodes, tree.node_totals(usage), edges)
    assert rows(rolled, "node_id", "total_cache_write", "total_total", order="node_id") == [("p", MAX_COUNTER, MAX_COUNTER), ("q", MAX_COUNTER, MAX_COUNTER)]


def test_spawn_calls_are_served_in_order(spark):
    from sessionlake.operators.graph import link_spawn

    child = lambda node, name, title="", group=False: ("x", node, f"{node}/{name}", name, title, group, name)
    children = spark.createDataFrame(
        [child("probe", "B"), child("probe", "C", "a")]
        + [child("late", name) for name in ("k1", "k2", "k3")] + [child("late", "g", "named", True)]
        + [child("short", "only"), child("idle", "nobody-asks")],
        "agent string, node_id string, child string, session_id string, title string, is_group boolean, at string")
    calls = spark.createDataFrame(
        [("x", "probe", 1, ["zzz"]), ("x", "probe", 2, ["b"])]
        # The result of call 10 moves it to k3 and sets k1 free, which call 30 takes; call 40 takes the group by its title.
        + [("x", "late", 10, []), ("x", "late", 20, ["K2"]), ("x", "late", 30, []), ("x", "late", 40, ["NAMED", ""]), ("x", "late", 50, None)]
        + [("x", "short", 1, []), ("x", "short", 2, [])],
        "agent string, node_id string, seq long, names array<string>")
    results = spark.createDataFrame(
        [("x", "late", 25, 10, "k3", False), ("x", "late", 26, 10, "unknown", False), ("x", "late", 60, 50, "k1", True), ("x", "late", 61, 50, "g", True)],
        "agent string, node_id string, seq long, call long, name string, of_group boolean")
    found = sorted(rows(link_spawn(calls, results, children), "node_id", "seq", "child"))
    assert found == [
        ("late", 10, "late/k3"), ("late", 20, "late/k2"), ("late", 30, "late/k1"), ("late", 40, "late/g"), ("late", 50, "late/g"),
        ("probe", 1, "probe/B"), ("probe", 2, "probe/C"), ("short", 1, "short/only"),
    ]
    assert link_spawn(calls.where("false"), results.where("false"), children).count() == 0


def test_read_record_reads_ranges(spark, tmp_path):
    import hashlib

    first, second = '{"é": 1}', "x" * 3_000
    path = write(tmp_path / "in" / "r.jsonl", first, second)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    size = len(first.encode())
    events = spark.createDataFrame(
        [("x", "n", 0, str(path), 0, size, digest(first)), ("x", "n", 1, str(path), size + 1, 3_000, digest(second)), ("x", "n", 2, str(path), size + 1, 3_000, digest(first)),
         ("x", "n", 3, str(path), size + 1, 9_000, digest(second)), ("x", "n", 4, f"{path}.gone", 0, size, digest(first)), ("x", "n", 5, str(path), 0, 0, None),
         ("x", "n", 6, None, None, None, None), ("x", "n", 7, f"file://{path}", 0, size, digest(first)), ("x", "n", 8, str(tmp_path), 0, size, digest(first))],
        "agent string, node_id string, event_index long, path string, byte_offset long, byte_length int, digest string")
    found = rows(sessions.read_record(events), "event_index", "status", "raw_json", order="event_index")
    assert found == [
        (0, "ok", first), (1, "ok", second), (2, "record_changed", None), (3, "record_changed", None), (4, "record_changed", None),
        (5, "record_unavailable", None), (6, "record_unavailable", None), (7, "ok", first), (8, "record_changed", None),
    ]
    assert rows(sessions.read_record(events, index=1), "raw_json") == [(second,)]


def test_single_event_is_cut_to_the_largest_limit_that_fits(spark):
    def wire(text, output, truncated=()):
        tool = {"name": "t", "call_id": "", "summary": "", "input": "i" * 40, "diff": "", "output": output, "duration_ms": 0}
        return (0, text, tool if output is not None else None, list(truncated))

    schema = ("index long, text string, tool struct<name string, call_id string, summary string, input string, diff string, output string, duration_ms long>, "
              "truncated array<string>")
    size = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    for case in (wire("a" * 5_000, "é\"\n" * 3_000), wire("b" * 9_000, None), wire("c" * 9_000, "d" * 10, ["text"]), wire("small", "e")):
        frame = spark.createDataFrame([case], schema)
        got = sessions.fit_single_event(frame, 4_000)
        row, taken = got.first(), got.select(size).first()[0]
        assert taken <= 4_000
        if case[1] == "small":
            assert row.text == "small" and row.truncated == []
            continue
        limit = len(row.text)
        more = [value if value is None or len(value) <= limit + 1 else value[:limit // 2] + "…" + value[-(limit + 1 - 1 - limit // 2):] for value in (case[1], case[2] and case[2]["output"])]
        tool = case[2] and dict(case[2], output=more[1])
        assert spark.createDataFrame([(0, more[0], tool, list(row.truncated))], schema).select(size).first()[0] > 4_000
        assert "text" in row.truncated and row.text.startswith(case[1][:limit // 2 - 1])


def test_unreadable_files_below_a_scope(spark):
    starts = spark.createDataFrame([("x", f"/r/{name}.jsonl") for name in ("a", "b", "a/subagents/deep")], "agent string, path string").selectExpr("*", "path AS node_id", "path AS start_id")
    lost = spark.createDataFrame([("x", path, "unreadable_session") for path in ("/r/a/subagents/c.jsonl", "/r/a/subagents/deep/subagents/d.jsonl", "/r/ab.jsonl", "/r/b.jsonl", "bare")]
                                 + [("y", "/r/b/c.jsonl", "unreadable_session"), ("x", "/r/b/c.jsonl", "malformed_line")], "agent string, path string, code string")
    assert sorted(rows(search.unreadable_below(starts, lost), "path", "failed")) == [
        ("/r/a.jsonl", "/r/a/subagents/c.jsonl"), ("/r/a.jsonl", "/r/a/subagents/deep/subagents/d.jsonl"),
        ("/r/a/subagents/deep.jsonl", "/r/a/subagents/deep/subagents/d.jsonl"),
    ]


def test_subtree_sums_of_a_long_chain(spark):
    n = 20_000
    own = spark.range(n).selectExpr("'x' AS agent", "CAST(id AS string) AS node_id", "1L AS count", "id AS low")
    edges = spark.range(1, n).selectExpr("'x' AS agent", "CAST(id - 1 AS string) AS parent", "CAST(id AS string) AS child")
    added = tree.subtree(own, edges, {"count": F.sum, "low": F.min})
    assert added.count() == n and added.where(f"count <> {n} - CAST(node_id AS long) OR low <> CAST(node_id AS long)").count() == 0


def test_subtree_sums_of_bushes_and_cycles(spark):
    own = spark.createDataFrame([("x", name, value) for name, value in zip("abcdef", range(1, 7))], "agent string, node_id string, n long")
    edges = spark.createDataFrame([("x", *pair) for pair in ("ab", "ac", "bd", "be")] + [("x", "f", "f")], "agent string, parent string, child string")
    assert rows(tree.subtree(own, edges, {"n": F.sum}), "node_id", "n", order="node_id") == [("a", 15), ("b", 11), ("c", 3), ("d", 4), ("e", 5), ("f", 6)]
    assert rows(tree._below(own, edges, {"n": F.sum}), "node_id", "n", order="node_id") == [("a", 14), ("b", 9)]
    assert sorted(rows(tree.subtree(own.drop("n").withColumn("tag", F.expr("node_id IN ('c', 'd', 'e')")), edges, {}), "node_id", "tag"))[:2] == [("a", False), ("a", True)]
    with pytest.raises(tree.CyclicTree):
        tree.subtree(own, edges.union(edges.selectExpr("agent", "'e'", "'a'")), {"n": F.sum})
