"""Build the session graph: nodes and parent-child edges of both transcript formats."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.plans.joins import parts_for
from sessionlake.plans.staging import stage
from sessionlake.sources.codex import AGENT_COMPONENT, agent_path_parts
from sessionlake.sources.scan import directory

NODE_COLUMNS = [
    "agent", "node_id", "path", "session_id", "cwd", "project", "title", "title_prompt", "git_branch", "started_at",
    "started_raw", "updated_at", "updated_raw", "messages", "has_error", "agent_path", "parent_id", "is_group",
]


def _file_nodes(summaries: DataFrame) -> DataFrame:
    return summaries.withColumns({"node_id": F.col("path"), "is_group": F.lit(False)})


def claude_graph(summaries: DataFrame, roles: DataFrame, run_titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from the directory layout, legacy session ids and workflow groups."""
    parts = parts_for(summaries)
    roles = roles.select("agent", "path", "role", "parent_path", "group_dir").repartition(parts, "path")
    placed = summaries.repartition(parts, "path").join(roles.hint("merge"), ["agent", "path"])
    placed = stage(placed.where("role <> 'ignored'"), "placed")  # read for every kind of edge
    direct = placed.where("role = 'child'").select("agent", F.col("parent_path").alias("parent"), F.col("path").alias("child"))
    folder = directory(F.col("path"))
    by = ["agent", "folder", "file_session_id"]
    owners = placed.where("role = 'root' AND session_id <> ''").select(
        "agent", folder.alias("folder"), F.col("session_id").alias("file_session_id"), F.col("path").alias("parent")
    )
    legacy = (
        placed.where("role = 'legacy'")
        .select("agent", "path", folder.alias("folder"), "file_session_id")
        .repartition(parts, *by[1:])
        .join(owners.repartition(parts, *by[1:]).hint("merge"), by)
        .select("agent", F.col("path").alias("child"), "parent")
        .repartition(parts, "child")
        .groupBy("agent", "child")
        .agg(F.min("parent").alias("parent"))
        .select("agent", "parent", "child")
    )
    members = placed.where("role = 'member'")
    run = F.substring_index("group_dir", "/", -1)
    # A group has no file of its own: it spans the earliest start and latest update of its members.
    groups = (
        members.select("agent", "group_dir", "parent_path", "started_at", "started_raw", "updated_at", "updated_raw")
        .repartition(parts, "group_dir", "parent_path")
        .groupBy("agent", "group_dir", "parent_path")
        .agg(
            F.min(F.struct("started_at", "started_raw")).alias("none_first"),
            F.min_by(F.struct("started_at", "started_raw"), F.when(F.col("started_at").isNotNull(), F.struct("started_at", "started_raw"))).alias("start"),
            F.max(F.struct("updated_at", "updated_raw")).alias("latest"),
        )
        .withColumn("run_id", run)
        .join(run_titles.withColumnRenamed("path", "parent_path"), ["agent", "parent_path", "run_id"], "left")
        .select(
            "agent",
            F.col("group_dir").alias("node_id"),
            F.concat("parent_path", F.lit("#"), "run_id").alias("path"),
            F.col("run_id").alias("session_id"),
            F.lit("").alias("cwd"),
            F.lit("").alias("project"),
            F.coalesce(F.when(F.col("run_title") != "", F.col("run_title")), "run_id").alias("title"),
            F.lit("").alias("title_prompt"),
            F.lit("").alias("git_branch"),
            F.col("start.started_at").alias("started_at"),
            F.col("start.started_raw").alias("started_raw"),
            F.col("latest.updated_at").alias("updated_at"),
            F.col("latest.updated_raw").alias("updated_raw"),
            F.lit(0).cast("bigint").alias("messages"),
            F.lit(False).alias("has_error"),
            F.lit("").alias("agent_path"),
            F.lit("").alias("parent_id"),
            F.lit(True).alias("is_group"),
        )
    )
    grouped = members.select("agent", F.col("group_dir").alias("parent"), F.col("path").alias("child"))
    hung = members.select("agent", F.col("parent_path").alias("parent"), F.col("group_dir").alias("child"))
    hung = hung.repartition(parts, "parent", "child").distinct()
    edges = direct.unionByName(legacy).unionByName(grouped).unionByName(hung)
    files = _file_nodes(placed)
    # A companion file without its transcript, and a legacy file without its session, hang nowhere.
    known = files.select("agent", F.col("path").alias("parent")).unionByName(groups.select("agent", F.col("node_id").alias("parent")))
    edges = edges.repartition(parts, "parent").join(known.repartition(parts, "parent").hint("merge"), ["agent", "parent"], "left_semi")
    attached = files.where("role = 'root'").select(*NODE_COLUMNS).unionByName(
        files.where("role <> 'root'")
        .join(edges.select("agent", F.col("child").alias("node_id")).hint("merge"), ["agent", "node_id"], "left_semi")
        .select(*NODE_COLUMNS)
    )
    nodes = attached.unionByName(groups.select(*NODE_COLUMNS))
    return nodes, edges


def codex_graph(summaries: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from activity records, sibling files and parent ids.

    Every started agent path gives one placeholder node per path component; a placeholder becomes
    the real transcript when a file of the same directory or a session with the same parent and id
    exists.
    """
    files = _file_nodes(summaries)
    base = F.coalesce(F.when(F.col("own_path") != "", agent_path_parts(F.col("own_path"))), F.array().cast("array<string>"))
    parts = agent_path_parts(F.col("agent_path"))
    started = (
        state.where("type = 'event_msg' AND item = 'sub_agent_activity' AND kind = 'started' AND NOT in_replay")
        .select("agent", "path", "byte_offset", "agent_path", "agent_thread_id", "seen_until")
        .join(summaries.select("agent", "path", F.col("agent_path").alias("own_path")), ["agent", "path"])
        .withColumn("base", base)
        .withColumn("full", parts)
        .where("full IS NOT NULL AND size(full) > size(base) AND slice(full, 1, size(base)) = base")
        .withColumn("parts", F.expr("slice(full, size(base) + 1, size(full))"))
    )
    steps = started.select(
        "agent", "path", "byte_offset", "base", "parts", "agent_thread_id", "seen_until",
        F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("level"),
    )
    route = F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/")
    final = (F.col("level") == F.size("parts")) & (F.col("agent_thread_id") != "")
    seats = (
        steps.withColumn("route", route)
        .groupBy("agent", "path", "route")
        .agg(
            F.min_by(F.struct("parts", "base", "level", "seen_until"), "byte_offset").alias("first"),
            F.max_by("agent_thread_id", F.when(final, F.col("byte_offset"))).alias("thread_id"),
        )
        .select(
            "agent",
            "path",
            "route",
            F.concat("path", F.lit("#"), "route").alias("seat"),
            F.when(F.col("first.level") > 1, F.concat("path", F.lit("#"), F.regexp_replace("route", "/[^/]*$", ""))).alias("above"),
            F.concat(F.lit("/root/"), F.array_join(F.concat("first.base", F.expr("slice(first.parts, 1, first.level)")), "/")).alias("seat_path"),
            F.substring_index("route", "/", -1).alias("name"),
            F.col("first.seen_until").alias("seen"),
            "thread_id",
        )
    )
    usable = (F.octet_length("thread_id") <= AGENT_COMPONENT) & ~F.rlike("thread_id", F.lit(r"[/\\]"))
    # The first file name of the directory that ends in the thread id.
    trailing = F.regexp_extract("path", r"([0-9A-Za-z_]+(?:-[0-9A-Za-z_]+)*)\.jsonl$", 1)
    tails = files.select(
        "agent", directory(F.col("path")).alias("folder"), F.col("path").alias("sibling"), F.split(trailing, "-").alias("bits")
    ).select(
        "agent", "folder", "sibling",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("bits")), lambda at: F.array_join(F.slice("bits", at, F.size("bits")), "-"))).alias("thread_id"),
    )
    siblings = (
        seats.where(usable & (F.col("thread_id") != ""))
        .withColumn("folder", directory(F.col("path")))
        .join(tails, ["agent", "folder", "thread_id"])
        .groupBy("agent", "seat")
        .agg(F.min("sibling").alias("sibling"))
    )
    # link_children: a transcript that names this file's session as parent and the seat's id as its own.
    child_id = F.coalesce("thread_id", "name")
    hosts = files.select("agent", "path", F.col("session_id").alias("host_id"), "cwd", "project")
    seats = seats.join(hosts, ["agent", "path"]).withColumn("child_id", child_id)
    above = seats.select("agent", F.col("seat").alias("above"), F.col("child_id").alias("above_id"))
    seats = seats.join(above, ["agent", "above"], "left").withColumn("parent_id", F.coalesce("above_id", "host_id"))
    actual = (
        files.where("parent_id <> '' AND session_id <> ''")
        .groupBy("agent", "parent_id", F.col("session_id").alias("child_id"))
        .agg(F.max("path").alias("actual"))
    )
    linked = (
        seats.join(actual, ["agent", "parent_id", "child_id"], "left")
        .join(siblings, ["agent", "seat"], "left")
        .withColumn("actual", F.when(F.col("actual") != F.col("path"), F.col("actual")))
    )
    # A node is the linked transcript, else the sibling file, else the seat itself.
    linked = linked.withColumn("target", F.coalesce("actual", F.when(F.col("sibling") != F.col("path"), F.col("sibling")), "seat"))
    placed = linked.select("agent", F.col("seat").alias("above"), F.col("target").alias("above_target"))
    edges = (
        linked.join(placed, ["agent", "above"], "left")
        .select("agent", F.coalesce("above_target", "path").alias("parent"), F.col("target").alias("child"))
        .where("parent <> child")
        .groupBy("agent", "child")
        .agg(F.min("parent").alias("parent"))
        .select("agent", "parent", "child")
    )
    seats_left = linked.where("target = seat").select(
        "agent",
        F.col("seat").alias("node_id"),
        F.col("seat").alias("path"),
        F.col("child_id").alias("session_id"),
        "cwd",
        "project",
        F.col("name").alias("title"),
        F.lit("").alias("title_prompt"),
        F.lit("").alias("git_branch"),
        F.col("seen").alias("started_at"),
        F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("started_raw"),
        F.col("seen").alias("updated_at"),
        F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("updated_raw"),
        F.lit(0).cast("bigint").alias("messages"),
        F.lit(False).alias("has_error"),
        F.col("seat_path").alias("agent_path"),
        F.lit("").alias("parent_id"),
        F.lit(False).alias("is_group"),
    )
    nodes = files.select(*NODE_COLUMNS).unionByName(seats_left.select(*NODE_COLUMNS))
    return nodes, edges


def group_models(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Models per node; a group node takes the union of its members' models."""
    groups = nodes.where("is_group").select("agent", F.col("node_id").alias("parent"))
    pooled = (
        edges.join(groups, ["agent", "parent"], "left_semi")
        .join(models.select("agent", F.col("node_id").alias("child"), F.explode("models").alias("model")), ["agent", "child"])
        .groupBy("agent", F.col("parent").alias("node_id"))
        .agg(F.array_sort(F.collect_set("model")).alias("models"))
    )
    return models.select("agent", "node_id", "models").unionByName(pooled)


def link_spawn(calls: DataFrame, results: DataFrame, children: DataFrame) -> DataFrame:
    """Match spawn calls to child nodes in the order of the timeline, each free child used once.

    ``calls``: agent, node_id, seq, names (array; null for a call that only its result links). ``results``: agent,
    node_id, seq, call (seq of the call that it answers), name (what it names), of_group. ``children``: agent, node_id,
    child, session_id, title, is_group, at.

    A call takes, at its place, the first free child whose id or title equals one of its names, ignoring case, else the
    first free child that is no group. A result that names a child takes it for its call, free or not, and sets free the
    child that the call held, which the calls behind it can take. Returns agent, node_id, seq, child.

    Every choice depends on the ones before, so one family is one sequence; it streams through its task in order and
    leaves there only its children's keys and its calls' choices, never its rows.
    """
    by = ["agent", "node_id"]
    low = F.lower
    kids = children.select(
        *by, F.lit(0).alias("role"), F.col("at").cast("string").alias("at"), F.lit(0).cast("bigint").alias("seq"), "child",
        F.col("session_id").alias("name"), "is_group", F.array(low("session_id"), low("title")).alias("names"), F.lit(None).cast("bigint").alias("call"),
    )
    asked = calls.select(
        *by, F.lit(1).alias("role"), F.lit("").alias("at"), "seq", F.lit("").alias("child"), F.lit("").alias("name"), F.lit(False).alias("is_group"),
        F.transform("names", low).alias("names"), F.col("seq").alias("call"),
    )
    told = results.select(
        *by, F.lit(2).alias("role"), F.lit("").alias("at"), "seq", F.lit("").alias("child"), "name", F.col("of_group").alias("is_group"),
        F.lit(None).cast("array<string>").alias("names"), "call",
    )
    moves = asked.unionByName(told)
    rows = kids.join(moves.select(*by).distinct(), by, "left_semi").unionByName(moves)
    # Children come first: at their place in the family, then calls and results by theirs in the file.
    ordered = rows.repartition(*by).sortWithinPartitions(*by, F.least("role", F.lit(1)), "at", "seq", "role", "child")
    return ordered.mapInArrow(_assign_children, "agent string, node_id string, seq bigint, child string")


class _Family:
    """Children of one node that are free, by key and over all, and what each call holds."""

    def __init__(self):
        self.children: list[tuple[str, bool, list]] = []
        self.by_id: dict[tuple[str, bool], int] = {}
        self.free: dict[str, list[int]] = {}
        self.plain: list[int] = []
        self.linked: set[int] = set()
        self.held: dict[int, int] = {}

    def add(self, child: str, session_id: str, is_group: bool, keys: list) -> None:
        at = len(self.children)
        self.children.append((child, is_group, keys))
        self.by_id.setdefault((session_id, False), at)
        if is_group:
            self.by_id.setdefault((session_id, True), at)
        self._offer(at)

    def _offer(self, at: int) -> None:
        _, is_group, keys = self.children[at]
        for key in set(keys):
            heapq.heappush(self.free.setdefault(key, []), at)
        if not is_group:
            heapq.heappush(self.plain, at)

    def _first(self, heap: list[int] | None) -> int | None:
        while heap and heap[0] in self.linked:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def call(self, seq: int, names: list) -> None:
        firsts = [at for at in (self._first(self.free.get(name)) for name in names) if at is not None]
        chosen = min(firsts) if firsts else self._first(self.plain)
        if chosen is not None:
            self.held[seq] = chosen
            self.linked.add(chosen)

    def result(self, call: int, name: str, of_group: bool) -> None:
        named = self.by_id.get((name, of_group))
        if named is None:
            return
        before = self.held.get(call)
        if before in self.linked:
            self.linked.discard(before)
            self._offer(before)
        self.held[call] = named
        self.linked.add(named)


def _assign_children(batches):
    family, key = _Family(), None

    def done():
        picked = sorted(family.held.items())
        return pa.RecordBatch.from_arrays(
            [pa.array([side] * len(picked), pa.string()) for side in key]
            + [pa.array([seq for seq, _ in picked], pa.int64()), pa.array([family.children[at][0] for _, at in picked], pa.string())],
            ["agent", "node_id", "seq", "child"],
        )

    for batch in batches:
        for agent, node, role, _, seq, child, name, is_group, names, call in zip(*(column.to_pylist() for column in batch.columns)):
            if (agent, node) != key:
                if key is not None:
                    yield done()
                family, key = _Family(), (agent, node)
            if role == 0:
                family.add(child, name, is_group, [each for each in names if each is not None])
            elif role == 2:
                family.result(call, name, is_group)
            elif names is not None:
                family.call(seq, [each for each in names if each is not None])
    if key is not None:
        yield done()


def spawn_links(events: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Child node of every spawn event: ``(agent, node_id, seq, child)``.

    Calls of the first format link as in ``link_spawn``; a workflow call only to the group of the run that its result
    names. An activity of the second format links by agent path or id.
    """
    spawns = events.where("kind = 'subagent'")
    kids = edges.select("agent", F.col("parent").alias("node_id"), F.col("child")).join(
        nodes.select("agent", F.col("node_id").alias("child"), "session_id", "title", "is_group", "agent_path"), ["agent", "child"]
    )
    calls = spawns.where("spawn_names IS NOT NULL").select(
        "agent", "node_id", "seq", F.when(F.col("tool_name") != "Workflow", F.col("spawn_names")).alias("names")
    )
    of_group = F.col("__tool") == "Workflow"
    answers = events.where("spawn_call IS NOT NULL AND (spawn_result <> '' OR spawn_run <> '')")
    tools = spawns.select("agent", "node_id", F.col("seq").alias("spawn_call"), F.col("tool_name").alias("__tool"))
    results = answers.drop("tool_name").join(tools, ["agent", "node_id", "spawn_call"]).select(
        "agent", "node_id", "seq", F.col("spawn_call").alias("call"), F.when(of_group, F.col("spawn_run")).otherwise(F.col("spawn_result")).alias("name"), of_group.alias("of_group")
    ).where("name <> ''")
    matched = link_spawn(calls, results, kids.withColumn("at", F.col("child")))
    starts = (
        spawns.where("spawn_names IS NULL AND agent_id <> ''")
        .select("agent", "node_id", "seq", F.col("agent_id").alias("session_id"))
        .join(kids, ["agent", "node_id", "session_id"])
        .groupBy("agent", "node_id", "seq")
        .agg(F.min("child").alias("child"))
    )
    return matched.unionByName(starts)

