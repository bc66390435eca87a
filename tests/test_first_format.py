"""End to end over transcripts of the first format."""

from __future__ import annotations

import pytest
from helpers import rows
from fixtures import assistant, result, stamp, text, tokens, tool, user, write

from sessionlake.corpus import open_corpus
from sessionlake.operators import sessions


@pytest.fixture(scope="module")
def corpus(spark, prices, tmp_path_factory):
    root = tmp_path_factory.mktemp("first")
    project = root / "garden"
    write(
        project / "s-main.jsonl",
        user("# Plant the beds\nwith care", 0),
        assistant([text("Working on it")], tokens(100, 10), 1),
        assistant([text("Working on it"), tool("c1", "Bash", command="ls\npwd")], tokens(100, 50), 2, isSidechain=False),
        assistant([text("copy")], tokens(900, 900), 3, isSidechain=True),
        '{"type": "assistant", "broken',
        user([result("c1", "Exit code 2\nno such file", True)], 5),
        assistant(
            [text("done <system-reminder>x</system-reminder>")],
            tokens(1000, 20, cache_creation_input_tokens=999, cache_read_input_tokens=7,
                   cache_creation={"ephemeral_1h_input_tokens": 3, "ephemeral_5m_input_tokens": 4}),
            6, mid="m2", rid="r2", model="elm-2",
        ),
        assistant([text("nothing")], tokens(5, 5), 7, mid="m3", rid="r3", model="<synthetic>"),
        assistant([tool("c2", "Task", name="scout", description="Look around")], tokens(10, 1), 8, mid="m4", rid="r4", model="unknown-9"),
        {"type": "ai-title", "aiTitle": "Garden plan", "sessionId": "s-main"},
        {"type": "system", "subtype": "compact_boundary", "content": "cut", "timestamp": stamp(9), "compactMetadata": {"trigger": "auto", "postTokens": 42}},
    )
    write(
        project / "s-main" / "subagents" / "agent-scout.jsonl",
        {**user("Look around\nfirst bed", 20), "agentId": "scout"},
        {**assistant([text("seen")], tokens(10, 2), 21, mid="k1", rid="q1"), "agentId": "scout"},
    )
    for at, name in enumerate(["one", "two"]):
        write(
            project / "s-main" / "subagents" / "workflows" / "wf-7" / f"agent-{name}.jsonl",
            {**user(f"Shared head\nonly {name}", 30 + at), "agentId": name},
            {**assistant([text("ok")], tokens(1, 1), 40 + at, mid=f"w{at}", rid=f"w{at}"), "agentId": name},
        )
    write(project / "s-main" / "subagents" / "workflows" / "wf-7" / "journal.jsonl", user("ignored"))
    write(project / "agent-old.jsonl", {**user("legacy work", 50), "agentId": "old"}, {**assistant([text("x")], tokens(2, 2), 51, mid="l1", rid="l1"), "agentId": "old"})
    # A fork that replays one request of the main session and starts later.
    write(
        project / "s-fork.jsonl",
        {**user("Fork of it", 55), "sessionId": "s-fork"},
        {**assistant([text("Working on it")], tokens(100, 50), 56), "sessionId": "s-fork"},
        {**assistant([text("fresh")], tokens(7, 7), 57, mid="m9", rid="r9"), "sessionId": "s-fork"},
    )
    return open_corpus(spark, {"claude": str(root)}, prices)


def test_graph_and_references(corpus):
    found = rows(corpus.nodes, "ref", "title", "is_group", "subagents", order="ref")
    assert found == [
        ("claude:s-fork", "Fork of it", False, 0),
        ("claude:s-main", "Garden plan", False, 4),
        ("claude:s-main#old", "legacy work", False, 0),
        ("claude:s-main#scout", "Look around", False, 0),
        ("claude:s-main#wf-7", "wf-7", True, 2),
        ("claude:s-main#wf-7/one", "only one", False, 0),
        ("claude:s-main#wf-7/two", "only two", False, 0),
    ]


def test_ledger_dedup_and_prices(corpus):
    found = rows(
        corpus.requests.where("node_id LIKE '%s-main.jsonl'"), "message_id", "input", "output", "write_5m", "write_1h", "usd", "missing",
        order="message_id",
    )
    assert [row[:5] for row in found] == [("m1", 100, 50, 0, 0), ("m2", 1000, 20, 4, 3), ("m4", 10, 1, 0, 0)]
    assert found[0][5] == pytest.approx(100 * 3e-6 + 50 * 1.5e-5)
    assert found[1][5] == pytest.approx(1000e-6 + 20 * 5e-6 + 4 * 1.25e-6 + 7e-7 + 3 * 2e-6)
    assert found[2][5:] == (0.0, True)


def test_owned_totals(corpus):
    fork = corpus.roots.where("session_id = 's-fork'").first()
    assert fork.total_uncached_input == 7
    assert fork.total_usd == pytest.approx(7 * 3e-6 + 7 * 1.5e-5)
    assert fork.self_gross_usd == pytest.approx(107 * 3e-6 + 57 * 1.5e-5)
    main = corpus.roots.where("session_id = 's-main'").first()
    assert main.total_total == 150 + 1034 + 11 + 12 + 2 + 2 + 4
    assert main.self_total + main.desc_total == main.total_total
    assert main.total_missing == ["unknown-9"]


def test_list(corpus):
    listed = sessions.list_sessions(corpus.roots, sort="cost")
    found = rows(listed, "ref", "messages", "has_error", "models", "updated_at", "project")
    assert found[0] == ("claude:s-main", 6, False, ["elm-2", "oak-1", "unknown-9"], stamp(51), "garden")
    assert found[1][0] == "claude:s-fork"
    assert rows(sessions.list_sessions(corpus.roots, query="grdnpln"), "ref") == [("claude:s-main",)]
    assert rows(sessions.list_sessions(corpus.roots, cwd="/work", project="garden", limit=1, offset=1), "ref") == [("claude:s-main",)]
    assert rows(sessions.page_info(corpus.roots, 1, 0)) == [(0, 1, 1, 2, True, 1)]


def test_timeline(corpus):
    main = corpus.events.where("node_id LIKE '%s-main.jsonl'")
    found = rows(main, "event_index", "kind", "text", "tool_input", "summary", "duration_ms", "harness", order="event_index")
    assert found == [
        (0, "user", "# Plant the beds\nwith care", "", "", 0, False),
        (1, "assistant-text", "Working on it", "", "", 0, False),
        (2, "assistant-text", "Working on it", "", "", 0, False),
        (3, "tool-call", "", "ls\npwd", "exit 2", 3000, False),
        (4, "assistant-text", "copy", "", "", 0, False),
        (5, "tool-result", "exit 2", "", "", 0, False),
        (6, "assistant-text", "done", "", "", 0, False),
        (7, "assistant-text", "nothing", "", "", 0, False),
        (8, "subagent", "", "Look around", "", 0, False),
        (9, "compact", "cut", "", "", 0, False),
    ]
    usage = rows(main.where("usage IS NOT NULL"), "event_index", "usage.input", "usage.output", "event_priced", order="event_index")
    # The sidechain copy repeats the request key with more tokens: the head keeps the largest report.
    assert usage == [(1, 900, 900, True), (6, 1000, 20, True), (8, 10, 1, False)]
    shown = sessions.show_session(corpus.nodes, corpus.events, "claude:s-main", kinds=["tool-call"])
    row = shown.first()
    assert row["text"] == "Bash(ls\npwd)" and row["tool"]["output"] == "Exit code 2\nno such file"
    assert sessions.show_session(corpus.nodes, corpus.events, "claude:s-main", offset=8, limit=1).first()["kind"] == "subagent"


def test_spawn_links_and_search(corpus):
    from sessionlake.operators import search

    linked = rows(corpus.events.where("subagent_ref IS NOT NULL"), "event_index", "subagent_ref")
    assert linked == [(8, "claude:s-main#scout")]
    hits = search.search_events(corpus.nodes, corpus.events, corpus.pairs, "WORKING", around=3)
    found = rows(hits, "ref", "event_index", "field", "range_start", "range_end", "snippet", "matches")
    assert found == [
        ("claude:s-fork", 1, "text", 0, 7, "Working on…", 1),
        ("claude:s-main", 1, "text", 0, 7, "Working on…", 1),
        ("claude:s-main", 2, "text", 0, 7, "Working on…", 1),
    ]
    scoped = search.search_events(corpus.nodes, corpus.events, corpus.pairs, "o[kn]", regex=True, session="claude:s-main#wf-7")
    assert rows(scoped, "ref", "event_index", "field") == [
        ("claude:s-main#wf-7/one", 0, "text"), ("claude:s-main#wf-7/one", 1, "text"),
        ("claude:s-main#wf-7/two", 0, "text"), ("claude:s-main#wf-7/two", 1, "text"),
    ]
    assert sorted(rows(corpus.diagnostics, "code")) == [("malformed_line",)]
