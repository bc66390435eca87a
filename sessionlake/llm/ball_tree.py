"""Ranked lexical search: exact maximum inner products by ball trees over sparse integer vectors.

A document is the vector of its scores for single query terms, ``(10**9 * tf) div (1000 * tf + 8 * m)``, an item the vector of
its terms' weights; the score is their inner product. Vectors hold query terms only, so they are short.

One pass over the texts counts words and occurrences of query terms and is staged; document frequencies and totals
come from it. The vectors are then searched where they lie: a task builds a ball tree over each run of ``BLOCK``
documents (the children of a ball are the halves along the line through two far points), and every item walks the tree
best first. A ball with centre ``c`` and radius ``r`` holds no document above ``q.c + |q| r``, with ``|q|`` over the terms that occur in the
ball; sums and radii are raised by more than their rounding, and a ball is left only if its bound is below the worst score that is still listed, so ties are
kept. Leaves are scored in 64-bit integers. The list of an item goes on from block to block of a task, which prunes more
from block to block. A task returns at most ``top`` rows for each item; Spark keeps the best of them.

Items are taken in blocks of at most ``BLOCK_TERMS`` distinct pairs of item and term (one item alone may have more), so what is broadcast is bounded
whatever the size of the benchmark; each block is one more pass. Terms are found by hash and compared byte by byte.

Defined cases: a null or empty text, and a text without a term, is no document; an item without terms has no rows;
rows of one item id (repeated rows, null ids too) are one item with the terms of all; rows that repeat a document are documents
of their own; equal scores go by ascending id, null ids last; an empty table on either side gives no rows; ids of documents are integers; only id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.batches import Words, chunks, short_batches, text_bytes
from sessionlake.plans.staging import stage

TOP = 10
BLOCK = 8_192
LEAF = 64
BLOCK_TERMS = 50_000
_LAST = np.iinfo(np.int64).max  # stands for a null id
_SLACK = 1e-9  # far above the rounding of sums of some thousand doubles


class TermTable:
    """Distinct terms, found in chunks of words by hash and byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [term.encode() for term in terms]
        self.sizes = np.array([len(term) for term in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
        hashes = Words(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, self.sizes.sum() + max(len(raw) - 1, 0)])).hashes if raw else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.unsure = bool((self.sorted[1:] == self.sorted[:-1]).any())

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of every word that is a term."""
        if not len(self.sorted) or not len(words.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.searchsorted(self.sorted, words.hashes, "left")
        low[low == len(self.sorted)] = 0
        at = np.flatnonzero(self.sorted[low] == words.hashes)
        term = self.order[low[at]]
        if self.unsure:  # terms that share a hash: each is tried
            pairs = [(w, t) for w, p in zip(at.tolist(), low[at].tolist()) for t in self.order[p:np.searchsorted(self.sorted, self.sorted[p], "right")].tolist()]
            at, term = (np.array(side, np.int64) for side in zip(*pairs)) if pairs else (at, term)
        same = words.ends[at] - words.starts[at] == self.sizes[term]
        at, term = at[same], term[same]
        if len(at):
            sizes = self.sizes[term]
            first = np.cumsum(sizes) - sizes
            step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            equal = words.data[np.repeat(words.starts[at], sizes) + step] == self.data[np.repeat(self.starts[term], sizes) + step]
            same = np.logical_and.reduceat(equal, first)
            at, term = at[same], term[same]
        return at, term


def _vectors(table):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for first, part, ends in chunks(data, offsets):
                rows, words = len(ends) - 1, Words(part, ends)
                at, term = table.value.find(words)
                key, tf = np.unique(words.row[at] * (1 << 32) + term, return_counts=True)
                cut = pa.array(np.searchsorted(key >> 32, np.arange(rows + 1)).astype(np.int32))
                terms, tfs = pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(tf.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(words.counts), pa.ListArray.from_arrays(cut, terms), pa.ListArray.from_arrays(cut, tfs)],
                    ["id", "n", "term", "tf"])

    return run


class BallTree:
    """Balls over the rows of a sparse matrix (``cut``, ``term``, ``value``), each with centre and radius."""

    def __init__(self, cut: np.ndarray, term: np.ndarray, value: np.ndarray, width: int, leaf: int = LEAF):
        self.cut, self.term, self.value = cut, term, value
        self.float = value.astype(np.float64)
        self.row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        self.norm2 = np.bincount(self.row, self.float * self.float, len(cut) - 1)
        self.width = width
        self.balls: list[tuple[np.ndarray, int, int]] = []  # rows of a leaf (else none), children
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._build(np.arange(len(cut) - 1), leaf)
        self.centres, self.radii = np.stack(self.centres), np.array(self.radii)

    def _entries(self, rows: np.ndarray):
        sizes = self.cut[rows + 1] - self.cut[rows]
        first = np.cumsum(sizes) - sizes
        return np.arange(int(sizes.sum())) + np.repeat(self.cut[rows] - first, sizes), np.repeat(np.arange(len(rows)), sizes)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        at, row = self._entries(rows)
        term, value = self.term[at], self.float[at]
        centre = np.bincount(term, value, self.width) / len(rows)
        flat = centre @ centre
        far = self.norm2[rows] - 2 * np.bincount(row, value * centre[term], len(rows)) + flat
        own = len(self.balls)
        # The differences above lose at most a few units in the last place of the squares they are made of.
        self.radii.append(math.sqrt(max(float(far.max()), 0) + _SLACK * (float(self.norm2[rows].max()) + flat)))
        self.centres.append(centre)
        self.balls.append((rows, -1, -1))
        if len(rows) > leaf and far.max() > 0:
            one = self._dense(rows[int(far.argmax())])
            away = self.norm2[rows] - 2 * np.bincount(row, value * one[term], len(rows))
            two = self._dense(rows[int(away.argmax())])
            order = np.argsort(np.bincount(row, value * (two - one)[term], len(rows)), kind="stable")
            half = len(rows) // 2
            left = self._build(rows[order[:half]], leaf)
            right = self._build(rows[order[half:]], leaf)
            self.balls[own] = (rows, left, right)
        return own

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.term[self.cut[row]:self.cut[row + 1]]] = self.float[self.cut[row]:self.cut[row + 1]]
        return out

    def bounds(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What no row of each ball exceeds in its product with the query.

        Rows of a ball differ from its centre only in terms that the centre has, so only these count in the query's length.
        """
        query = weight.astype(np.float64)
        centres = self.centres[:, term]
        raised = centres @ query + np.sqrt((centres > 0) @ (query * query)) * self.radii
        return raised * (1 + _SLACK) + 1e-6

    def products(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact products of the rows with a dense integer query."""
        at, row = self._entries(rows)
        sizes = self.cut[rows + 1] - self.cut[rows]
        total = np.concatenate([[0], np.cumsum(self.value[at] * dense[self.term[at]])])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


class Best:
    """The ``top`` highest scores above 0 of one item, equal scores by ascending id."""

    def __init__(self, top: int):
        self.top, self.score, self.id = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """The lowest score that can still be listed."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        new = score >= self.floor()
        if len(self.score) == self.top:
            new &= (score > self.score[-1]) | (ids < self.id[-1])
        if new.any():
            score, ids = np.concatenate([self.score, score[new]]), np.concatenate([self.id, ids[new]])
            order = np.lexsort((ids, -score))[:self.top]
            self.score, self.id = score[order], ids[order]


def search_tree(tree: BallTree, ids: np.ndarray, term: np.ndarray, weight: np.ndarray, dense: np.ndarray, best: Best) -> int:
    """Add the block's documents to the list of one item, best ball first; returns how many rows were scored."""
    bound = tree.bounds(term, weight)
    dense[term] = weight
    scored, heap = 0, [(-bound[0], 0)]
    while heap and -heap[0][0] >= best.floor():
        rows, left, right = tree.balls[heapq.heappop(heap)[1]]
        if left < 0:
            best.add(tree.products(rows, dense), ids[rows])
            scored += len(rows)
        else:
            heapq.heappush(heap, (-bound[left], left))
            heapq.heappush(heap, (-bound[right], right))
    dense[term] = 0
    return scored


def _blocks(batches, size: int):
    """Runs of ``size`` rows, as lists of batches."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == size:
                yield held
                held, rows = [], 0
    if held:
        yield held


def _searcher(items, width: int, texts: int, words: int, top: int, block: int):
    def run(batches):
        listed, dense = [Best(top) for _ in items.value], np.zeros(width, np.int64)
        for held in _blocks(batches, block):
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("id").combine_chunks().fill_null(_LAST).to_numpy()
            n = table.column("n").combine_chunks().to_numpy()
            terms, tfs = (table.column(name).combine_chunks() for name in ("term", "tf"))
            cut = terms.offsets.to_numpy().astype(np.int64)
            term, tf = (side.values.slice(cut[0], cut[-1] - cut[0]).to_numpy().astype(np.int64) for side in (terms, tfs))
            cut = cut - cut[0]
            m = np.repeat(10 + (90 * n * texts) // words, np.diff(cut))
            tree = BallTree(cut, term, (1_000_000_000 * tf) // (1000 * tf + 8 * m), width)
            for best, (_, term, weight) in zip(listed, items.value):
                search_tree(tree, ids, term, weight, dense, best)
        item = np.concatenate([np.full(len(best.id), place) for place, best in enumerate(listed)] or [[]]).astype(np.int32)
        score, ids = (np.concatenate([getattr(best, name) for best in listed] or [[]]).astype(np.int64) for name in ("score", "id"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(ids, mask=ids == _LAST)], ["item", "score", "id"])

    return run


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct ``item``, ``term`` pairs and ``place``, the number of their block."""
    text = F.translate(F.col(f"`{text_col}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select(F.col(f"`{item_col}`").alias("item"), F.explode(words).alias("term")).distinct()


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, block: int = BLOCK, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item``, ``rank``, ``id``, ``score``: the ``top`` documents of each item."""
    spark = docs.sparkSession
    short_batches(spark)
    pairs = stage(item_terms(items, item_col, item_text_col), "item-terms")
    parts = max(1, math.ceil(pairs.count() / block_terms))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = None
    for part in range(parts):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        each = search_block(texts, [(row["item"], sorted(row["terms"])) for row in mine.groupBy("item").agg(F.collect_list("term").alias("terms")).collect()],
                            pairs.schema["item"].dataType, top, block)
        found = each if found is None else found.union(each)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("item", "rank", "id", "score")


def search_block(texts: DataFrame, asked: list[tuple], kind, top: int, block: int) -> DataFrame:
    """Best documents of each task for one block of items: ``item``, ``score``, ``id``."""
    spark = texts.sparkSession
    terms = sorted({term for _, mine in asked for term in mine})
    table = spark.sparkContext.broadcast(TermTable(terms))
    vectors = stage(texts.where("text is not null").mapInArrow(_vectors(table), "id long, n long, term array<int>, tf array<int>").where("n > 0"), "vectors")
    n_texts, n_words = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect())  # one row a query term
    weight = np.array([math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df.get(place, 0) + 1))) for place in range(len(terms))], np.int64)
    number = {term: place for place, term in enumerate(terms)}
    of_items = []
    for item, mine in asked:
        place = np.array([number[term] for term in mine], np.int64)
        of_items.append((item, place, weight[place]))
    items = spark.sparkContext.broadcast(of_items)
    best = vectors.where(F.size("term") > 0).mapInArrow(_searcher(items, len(terms), n_texts, max(n_words, 1), top, block), "item int, score long, id long")
    names = spark.createDataFrame([(place, item) for place, (item, _) in enumerate(asked)], f"item int, name {kind.simpleString()}")
    return best.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "score", "id")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = ranked(docs, items)
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


OP12_SQL = r"""
WITH words AS (
  SELECT r, doc_id, unnest(w) AS term, len(w) AS n
  FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), counts AS (SELECT r, doc_id, term, any_value(n) AS n, count(*) AS tf FROM words GROUP BY r, doc_id, term),
totals AS (SELECT count(DISTINCT r) AS texts, CAST(count(*) AS BIGINT) AS all_words FROM words),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(texts) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term
), scores AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * texts) // all_words)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY item_id, r, doc_id
), places AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= 10
"""
