"""Record projections: advisor steps, tool details, harness turns, wrapped tools."""

from __future__ import annotations

import json

import pytest
from helpers import rows
from fixtures import assistant, item, result, text, tokens, tool, user
from pyspark.sql import functions as F

from sessionlake.operators import timeline
from sessionlake.operators.ledger import dedup_requests
from sessionlake.plans.staging import stage
from sessionlake.sources import claude, codex, scan

CIPHER = "gAAAA" + "q" * 80


def raw(spark, agent, *records):
    data, at = [], 0
    for record in records:
        line = record if isinstance(record, str) else json.dumps(record)
        data.append((agent, "/t/x.jsonl", at, len(line.encode()), line))
        at += len(line.encode()) + 1
    return spark.createDataFrame(data, "agent string, path string, byte_offset long, byte_length int, line string")


@pytest.fixture(scope="module")
def first(spark):
    advisor = lambda n: {"type": "advisor_message", "model": "elm-2", "input_tokens": n, "output_tokens": 1}
    consult = {"type": "server_tool_use", "id": "a1", "name": "advisor"}
    lines = raw(
        spark, "claude",
        user("<command-name>x</command-name>", 0),
        {**user("typed", 1), "origin": {"kind": "human"}},
        {**user("sent", 2), "origin": {"kind": "task"}},
        {**user("meta", 3), "isMeta": True},
        user([text("part one"), text("  warmup "), text("part two")], 4),
        assistant([consult], tokens(10, 1, iterations=[advisor(5), {"type": "other", "model": "elm-2", "input_tokens": 9}]), 5, mid="m1"),
        assistant([text("advice"), consult], tokens(10, 2, iterations=[advisor(5), advisor(0), {**advisor(7), "output_tokens": 3}]), 6, mid="m1"),
        assistant([{"type": "thinking", "thinking": f"hmm {CIPHER}"}], None, 7, mid="m2"),
        assistant([tool("e", "Edit", file_path="/a.py", old_string="x\ny", new_string="z")], tokens(1, 1), 8, mid="m3"),
        assistant([tool("f", "MultiEdit", edits=[{"old_string": "a", "new_string": "b"}, {"old_string": "", "new_string": "c"}])], None, 9, mid="m4"),
        assistant([tool("g", "Read", file_path="/b.py", offset=3, limit=9), tool("h", "Probe", z=1, a="two words")], None, 10, mid="m5"),
        user([result("g", [text("l1"), {"type": "image"}, text("l2")]), result("none", "lost\n one")], 11),
        user([result("g", "later")], 9),
        '{"type": "assistant", "message": {"id": "bad", "model": "oak-1", "usage": {"input_tokens": "12"}}}',
        assistant([text("minus")], tokens(-5, 1), 12, mid="m6"),
        {**assistant([text("oops")], None, 13, mid="m7"), "isApiErrorMessage": True},
    )
    return claude.claude_records(stage(lines, "test-lines"))


def test_advisor_requests(first):
    found = rows(dedup_requests(claude.claude_requests(first)), "message_id", "model", "input", "output", order=["byte_offset", "ordinal"])
    assert sorted(found) == sorted([
        ("m1", "oak-1", 10, 2), ("m1\0advisor\x000", "elm-2", 5, 1), ("m1\0advisor\x001", "elm-2", 0, 1), ("m1\0advisor\x002", "elm-2", 7, 3), ("m3", "oak-1", 1, 1),
    ])


def test_first_timeline(first):
    lines = stage(claude.claude_lines(first), "test-narrow")
    events = timeline.event_index(timeline.claude_events(first, lines)).orderBy("event_index")
    found = rows(events, "kind", "text", "harness", "tool_input", "detail_input", "detail_diff", "detail_output", "summary", "usage.input", order="event_index")
    plain = lambda kind, words, harness=False, used=None: (kind, words, harness, "", "", "", "", "", used)
    assert found == [
        plain("user", "<command-name>x</command-name>", True),
        plain("user", "typed"),
        plain("user", "sent", True),
        plain("user", "meta", True),
        plain("user", "part one\npart two"),
        # The advisor row heads the request, and its own step replaces the executor usage.
        ("advisor", "", False, "", "", "", "", "", 5),
        plain("assistant-text", "advice"),
        plain("thinking", "hmm <encrypted 85 chars>"),
        ("tool-call", "", False, "/a.py · +1 −2", "", "-x\n-y\n+z", "", "", 1),
        ("tool-call", "", False, '{"edits":[{"old_string":"a","new_string":"b"},{"old_string":"","new_string":"c"}]}', "", "-a\n+b\n\n+c", "", "", None),
        ("tool-call", "", False, "/b.py", "/b.py · offset 3 · limit 9", "", "later", "later", None),
        ("tool-call", "", False, '{"z":1,"a":"two words"}', '{"z":1,"a":"two words"}', "", "", "", None),
        ("tool-result", rows(events.where("call_id = 'g' AND kind = 'tool-result'"), "text")[0][0], False, "", "", "", "", "", None),
        plain("tool-result", "lost one"),
        plain("tool-result", "later"),
        plain("assistant-text", "minus"),
        plain("assistant-text", "oops"),
    ]
    # The first result took one second; the later one is dated before its call and leaves the duration.
    assert rows(events.where("tool_input = '/b.py'"), "duration_ms") == [(1000,)]


def test_first_summary(first):
    row = claude.claude_summaries(claude.claude_lines(first)).first()
    # The malformed usage drops its whole record; prompts and shown replies count.
    assert (row.messages, row.has_error, row.title) == (8, True, "x")


def test_second_tools(spark):
    patch = "*** Begin Patch\n*** Update File: src/a.py\n+one\n-two\n*** Add File: b/c.py\n+x\n*** End Patch"
    call = lambda name, cid, body, at: item("response_item", at, type="custom_tool_call", call_id=cid, name=name, input=body)
    out = lambda cid, body, at: item("response_item", at, type="custom_tool_call_output", call_id=cid, output=body)
    lines = raw(
        spark, "codex",
        item("session_meta", 0, id="s", cwd="/w"),
        item("turn_context", 0, model="gpt-5"),
        call("apply_patch", "p", patch, 1), out("p", "Process exited with code 0\nWall time 0.2 seconds\nOutput:\nDone", 2),
        call("exec_command", "c", json.dumps({"cmd": "make all"}), 3), out("c", "Process exited with code 3\nOutput:\nfail", 4),
        call("exec", "x", "await tools.view_image({p: 'tools.no('})", 5), out("x", [{"type": "text", "text": "Script completed\nWall time 1 seconds\nOutput:\nseen"}], 6),
        item("response_item", 7, type="reasoning", summary=[{"text": f"thought {CIPHER}"}]),
        item("event_msg", 8, type="agent_message", message=""),
        item("response_item", 9, type="message", role="developer", content=[{"text": "hidden"}]),
        item("response_item", 10, type="message", role="user", content=[{"text": "Message Type: x\nPayload:\nnot for roots"}]),
    )
    records = codex.codex_records(stage(lines, "test-lines"))
    meta = codex.file_meta(records)
    state = codex.line_state(records, meta)
    summaries = codex.codex_summaries(records, state, meta)
    requests = codex.codex_ledger(state).select("agent", "node_id", "byte_offset", "is_aggregate", F.lit(None).cast(timeline.USAGE_TYPE).alias("usage_struct"))
    events = timeline.event_index(timeline.codex_events(records, state, meta, requests, summaries))
    found = rows(events, "kind", "text", "tool_name", "tool_input", "detail_diff", "summary", "detail_output", order="event_index")
    assert found == [
        ("tool-call", "", "apply_patch", "+2 −1", patch, "a.py, c.py", "Process exited with code 0\nWall time 0.2 seconds\nOutput:\nDone"),
        ("tool-result", "a.py, c.py", "", "", "", "", ""),
        ("tool-call", "", "exec_command", "make all", "", "exit 3", "Process exited with code 3\nOutput:\nfail"),
        ("tool-result", "exit 3", "", "", "", "", ""),
        ("tool-call", "", "view_image", "", "", "seen", "seen"),
        ("tool-result", "seen", "", "", "", "", ""),
        ("thinking", "thought <encrypted 85 chars>", "", "", "", "", ""),
    ]


def test_missing_root_lists_nothing(spark):
    assert scan.list_files(spark, {"claude": "/no/such/folder"}).count() == 0
