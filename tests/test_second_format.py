"""End to end over transcripts of the second format."""

from __future__ import annotations

import pytest
from helpers import rows
from fixtures import counter, item, stamp, token_count, write

from sessionlake.corpus import open_corpus
from sessionlake.operators import sessions


def meta(sid, at=0, **extra):
    return item("session_meta", at, id=sid, cwd="/work/pond", git={"branch": "dev"}, **extra)


def said(role, words, at):
    return item("response_item", at, type="message", role=role, content=[{"type": "text", "text": words}])


def posted(kind, words, at):
    return item("event_msg", at, type=kind, message=words)


@pytest.fixture(scope="module")
def corpus(spark, prices, tmp_path_factory):
    root = tmp_path_factory.mktemp("second") / "2026" / "03"
    write(
        root / "rollout-clean.jsonl",
        meta("clean-0001"),
        item("turn_context", 0, model="gpt-5-sol", summary="auto"),
        posted("user_message", "# Task\n\n## Brief: Dig the pond\nmore", 1),
        said("user", "# Task\n\n## Brief: Dig the pond\nmore", 1),
        said("assistant", "Digging", 2),
        posted("agent_message", "Digging", 2),
        token_count(3, counter(100, 10, 40), counter(100, 10, 40)),
        item("response_item", 4, type="function_call", call_id="k1", name="exec", arguments="await tools.apply_patch({p})"),
        item("response_item", 5, type="function_call_output", call_id="k1", output="Script completed\nWall time 1 seconds\nOutput:\nall good"),
        "{broken",
        token_count(6, counter(100, 10, 40), counter(100, 10, 40)),
        token_count(7, counter(300_000, 5), counter(300_100, 15, 40)),
        item("event_msg", 8, type="sub_agent_activity", agent_path="/root/scout/deep", agent_thread_id="", kind="started"),
        item("event_msg", 9, type="sub_agent_activity", agent_path="/root/helper", agent_thread_id="help-0007", kind="started"),
        item("event_msg", 10, type="context_compacted"),
        token_count(11, None, counter(300_100, 15, 40)),
    )
    write(root / "rollout-help-0007.jsonl", meta("help-0007", 20, parent_thread_id="clean-0001", agent_path="/root/helper"),
          item("turn_context", 20, model="gpt-5"), said("assistant", "helping", 21), token_count(22, counter(10, 1), counter(10, 1)))
    write(root / "rollout-lumped.jsonl", meta("lumped-002", 30), item("turn_context", 30, model="gpt-5"),
          token_count(31, counter(10, 1), counter(10, 1)), token_count(32, counter(10, 1), counter(50, 9)))
    write(root / "rollout-bare.jsonl", meta("bare-00003", 30), item("turn_context", 30, model="gpt-5"), token_count(31, counter(10, 1)),
          item("turn_context", 31, model="mystery"), token_count(32, counter(20, 2)), token_count(33, counter(1, 2, 5)))
    write(
        root / "rollout-fork.jsonl",
        meta("fork-00004", 40, forked_from_id="clean-0001"), item("turn_context", 40, model="gpt-5"),
        posted("user_message", "replayed words", 41),
        token_count(41.1, counter(100, 10), counter(100, 10)), token_count(41.2, counter(50, 5), counter(150, 15)),
        posted("user_message", "new words", 43), said("assistant", "reply", 44),
        token_count(45, counter(7, 3), counter(157, 18)),
    )
    write(
        root / "rollout-bridge.jsonl",
        meta("brdg-00005", 50, thread_source="subagent", agent_path="/root/other"), item("turn_context", 50, model="gpt-5"),
        said("assistant", "parent talk", 51), token_count(52, counter(5, 5), counter(5, 5)),
        item("inter_agent_communication_metadata", 53),
        said("user", "Message Type: task\nPayload:\nReal task", 54), said("assistant", "mine", 55),
        token_count(56, counter(6, 6), counter(11, 11)),
    )
    return open_corpus(spark, {"codex": str(root.parent.parent)}, prices, "gpt-5")


def test_ledger(corpus):
    found = rows(corpus.requests, "node_id", "is_aggregate", "model", "input", "output", "cache_read", "pricing_model", "estimated", "missing")
    short = sorted((row[0].rsplit("rollout-", 1)[1][:-6], *row[1:]) for row in found)
    assert short == [
        ("bare", True, "gpt-5", 10, 1, 0, "openai/gpt-5", False, False),
        ("bare", True, "mystery", 20, 2, 0, "openai/gpt-5", True, False),
        ("bridge", False, "gpt-5", 5, 5, 0, "openai/gpt-5", False, False),
        ("bridge", False, "gpt-5", 6, 6, 0, "openai/gpt-5", False, False),
        ("clean", False, "gpt-5-sol", 100, 10, 40, "openai/gpt-5", True, False),
        ("clean", False, "gpt-5-sol", 300_000, 5, 0, "openai/gpt-5", True, False),
        ("fork", False, "gpt-5", 7, 3, 0, "openai/gpt-5", False, False),
        ("help-0007", False, "gpt-5", 10, 1, 0, "openai/gpt-5", False, False),
        ("lumped", True, "gpt-5", 50, 9, 0, "openai/gpt-5", False, False),
    ]


def test_graph(corpus):
    found = rows(corpus.nodes, "ref", "title", "messages", "subagents", "project", order="ref")
    assert found == [
        ("codex:bare-00003", "", 0, 0, "pond"),
        ("codex:brdg-00005", "other", 0, 0, "pond"),
        ("codex:clean-0001", "Dig the pond", 2, 3, "pond"),
        ("codex:clean-0001#helper", "helper", 0, 0, "pond"),
        ("codex:clean-0001#scout", "scout", 0, 1, "pond"),
        ("codex:clean-0001#scout/deep", "deep", 0, 0, "pond"),
        ("codex:fork-00004", "new words", 1, 0, "pond"),
        ("codex:lumped-002", "", 0, 0, "pond"),
    ]
    clean = corpus.nodes.where("ref = 'codex:clean-0001'").first()
    assert clean.updated_raw == stamp(22)
    assert clean.total_total == 110 + 300_005 + 11


def events_of(corpus, name):
    found = corpus.events.where(f"node_id LIKE '%rollout-{name}.jsonl'")
    return rows(found, "event_index", "kind", "text", "tool_name", "usage.input", "harness", "event_estimated", order="event_index")


def test_timeline_clean(corpus):
    assert events_of(corpus, "clean") == [
        (0, "user", "# Task\n\n## Brief: Dig the pond\nmore", "", None, False, False),
        (1, "assistant-text", "Digging", "", 100, False, True),
        (2, "tool-call", "", "apply_patch", None, False, False),
        (3, "tool-result", "all good", "", None, False, False),
        (4, "usage", "unattributed usage", "", 300_000, False, True),
        (5, "subagent", "", "", None, False, False),
        (6, "compact", "context compacted", "", None, False, False),
    ]


def test_timeline_other(corpus):
    assert [row[1:5] for row in events_of(corpus, "lumped")] == [("usage", "session usage", "", 50)]
    assert [row[1:5] for row in events_of(corpus, "bare")] == [("usage", "session usage", "", 10), ("usage", "session usage", "", 20)]
    assert [row[1:6] for row in events_of(corpus, "bridge")] == [
        ("usage", "unattributed usage", "", 5, False),
        ("user", "Real task", "", None, True),
        ("assistant-text", "mine", "", 6, False),
    ]
    assert [row[1:5] for row in events_of(corpus, "fork")] == [
        ("user", "replayed words", "", None), ("user", "new words", "", None), ("assistant-text", "reply", "", 7),
    ]


def test_wire_rows(corpus):
    shown = sessions.show_session(corpus.nodes, corpus.events, "codex:clean-0001", kinds=["assistant-text"]).first()
    assert shown["usage"].asDict() == {"uncached_input": 60, "output": 10, "cache_write": 0, "cache_read": 40, "flow": 70, "context": 100}
    assert shown["cost"]["usd"] == pytest.approx(60 * 2e-6 + 10 * 8e-6 + 40 * 2e-7)
    states = rows(sessions.read_record(corpus.events), "status")
    assert {state for (state,) in states} == {"ok", "record_unavailable"}


def test_rollout_queries_parse_every_line_once(spark):
    """Records are read by a dozen passes; none of them parses the lines again."""
    from sessionlake import registry

    records, meta, state = registry._rollouts(spark, "/root/testdata/sf0.001")
    for frame in (records, meta, state):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "jsontostructs" not in plan.lower()
    assert records.count() > 0 and "variant" in dict(records.dtypes)["output"]
