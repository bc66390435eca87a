"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors with cosine c lie at squared distance 2 - 2c. After one fixed rotation the coordinates are split
into blocks of ``BLOCK_DIMS``; if the whole squared distance is within its budget, at least one block's is within
the share of the budget that its coordinates have. Each block is joined by range: cells twice the block's
radius wide over its first ``GRID_DIMS`` coordinates; every vector stands in its own cell and asks the cells
its ball reaches, each pair of cells in one direction. The union of all blocks' candidates is verified by the cosine in
double precision.

Equal vectors of one label are joined as one with a multiplicity, so a vector that a third of all rows hold is
one row. Candidates come from equi-joins on (label, block, cell), which adaptive execution splits if hot.

Defined cases: a null label, and a vector that is null, empty, zero, or holds a null or non-finite component,
links with nothing; vectors of different lengths link with nothing; rows that repeat a vec_id are vectors of
their own and link like others; a null vec_id is reachable but never the smallest; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.components import components
from sessionlake.plans.staging import stage

BLOCK_DIMS = 8
GRID_DIMS = 4
_SLACK = 1e-5


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and the lengths of its rows."""
    lengths = np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _cells(coordinates: np.ndarray) -> np.ndarray:
    out = np.full(len(coordinates), 0x51ED270B, np.int64)
    for k in range(coordinates.shape[1]):
        out = (out * np.int64(6364136223846793005) + coordinates[:, k].astype(np.int64) * 2 + 1) ^ (out >> np.int64(29))
    return out


def _asked(scaled: np.ndarray, radius: float, width: float):
    """(cells, which vectors, own) for each way the ball of a vector leaves its cell upwards in order, and for none."""
    home = np.floor(scaled)
    part = scaled - home
    side = np.where(part < 0.5, -1, 1)
    away = (np.where(part < 0.5, part, 1 - part) * width) ** 2
    for move in itertools.product((0, 1), repeat=scaled.shape[1]):
        if not any(move):
            yield home, np.arange(len(home)), True
            continue
        first = side[:, move.index(1)]
        yield home + side * np.array(move), np.flatnonzero((away @ np.array(move) <= radius * radius) & (first > 0)), False


def _spread(budget: float, asking: bool):
    """Rows of the vectors' blocks: in their home cells, or (``asking``) in all the cells they ask."""

    def run(batches):
        for batch in batches:
            node, label = batch.column(0).to_numpy(), batch.column(1)
            values, lengths = _matrix(batch.column(2))
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                rows = _unit(values[starts[at][:, None] + np.arange(dims)]) @ rotation(int(dims))
                for block, low in enumerate(range(0, int(dims), BLOCK_DIMS)):
                    place = rows[:, low:low + BLOCK_DIMS]
                    share = place.shape[1] / dims
                    radius = math.sqrt(budget * share) * (1 + _SLACK)
                    scaled = place[:, :GRID_DIMS] / (2 * radius)
                    padded = np.zeros((len(at), BLOCK_DIMS), np.float32)
                    padded[:, :place.shape[1]] = place
                    ways = _asked(scaled, radius, 2 * radius) if asking else [(np.floor(scaled), np.arange(len(at)), True)]
                    for cell, pick, own in ways:
                        n = len(pick)
                        if n:
                            keys = _cells(np.concatenate([cell[pick], np.full((n, 1), dims)], axis=1))
                            yield pa.RecordBatch.from_arrays([
                                label.take(pa.array(at[pick])), pa.array(np.full(n, block, np.int32)), pa.array(keys), pa.array(np.full(n, own)),
                                pa.array(node[at[pick]]), pa.array(np.full(n, share)), *[pa.array(padded[pick, k]) for k in range(BLOCK_DIMS)]],
                                ["label", "block", "cell", "own", "node", "share", *[f"x{k}" for k in range(BLOCK_DIMS)]])

    return run


def candidates(vectors: DataFrame, budget: float) -> DataFrame:
    """Pairs (a < b) of nodes that are near in at least one block. ``vectors``: node, label, vector."""
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"label {label}, block int, cell long, own boolean, node long, share double, " + ", ".join(f"x{k} float" for k in range(BLOCK_DIMS))
    vectors = vectors.select("node", "label", "vector")
    h, p = vectors.mapInArrow(_spread(budget, False), schema).alias("h"), vectors.mapInArrow(_spread(budget, True), schema).alias("p")
    near = " + ".join(f"(h.x{k} - p.x{k}) * (h.x{k} - p.x{k})" for k in range(BLOCK_DIMS))
    return h.join(p, F.expr(
        "h.label = p.label AND h.block = p.block AND h.cell = p.cell AND h.node <> p.node AND (NOT p.own OR h.node < p.node) "
        f"AND {near} <= h.share * {budget * (1 + 4 * _SLACK)!r}")).select(F.least("h.node", "p.node").alias("a"), F.greatest("h.node", "p.node").alias("b")).distinct()


def verified(pairs: DataFrame, vectors: DataFrame, min_cosine: float) -> DataFrame:
    """The pairs whose cosine in double precision is at least ``min_cosine``."""
    left = vectors.select(F.col("node").alias("a"), F.col("vector").alias("va"))
    right = vectors.select(F.col("node").alias("b"), F.col("vector").alias("vb"))

    def run(batches):
        for batch in batches:
            (x, lx), (y, ly) = _matrix(batch.column(2)), _matrix(batch.column(3))
            out = np.zeros(batch.num_rows, bool)
            sx, sy = np.cumsum(lx) - lx, np.cumsum(ly) - ly
            for dims in np.unique(lx):
                at = np.flatnonzero((lx == dims) & (ly == dims))
                span = np.arange(dims)
                out[at] = np.einsum("ij,ij->i", _unit(x[sx[at][:, None] + span]), _unit(y[sy[at][:, None] + span])) >= min_cosine
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(out))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def near_vectors(embeddings: DataFrame, min_cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component`` (smallest id reachable) and ``kept``."""
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine lies above 0 and is 1 at most")
    vector = F.col(f"`{vector_col}`")
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = stage(embeddings.select(
        F.monotonically_increasing_id().alias("row"),  # fixed by being written
        F.col(f"`{id_col}`").alias("id"),
        F.when(F.coalesce(real, F.lit(False)) & F.col(f"`{label_col}`").isNotNull(), F.col(f"`{label_col}`")).alias("label"),
        vector.alias("vector"),
    ), "vectors")
    linkable = rows.where("label IS NOT NULL")
    reps = stage(linkable.groupBy("label", "vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    links = stage(verified(candidates(reps, 2 - 2 * min_cosine), reps, min_cosine), "vector-links")
    both = links.union(links.select("b", "a")).toDF("node", "other")
    copies = reps.select(F.col("node").alias("other"), F.col("copies"))
    others = both.join(copies, "other").groupBy("node").agg(F.sum("copies").alias("others"))
    nodes = reps.join(others, "node", "left").join(components(links), "node", "left").select(
        "label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    placed = stage(rows.join(nodes, ["label", "vector"], "left").select("row", "id", "links", "component"), "vector-places")
    smallest = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("smallest"))
    lowest = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return (
        placed.join(smallest, "component", "left")
        .select("id", F.coalesce("links", F.lit(0)).alias("n_links"), lowest.alias("component"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
    )


def op9_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector, among equal labels, from cosine 0.98."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP9_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
), unit AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM good),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(counted.n, 0) AS n_links, lowest.component_id, e.vec_id = lowest.component_id AS kept
FROM embeddings e JOIN lowest ON lowest.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
"""
