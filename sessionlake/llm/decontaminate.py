"""Benchmark decontamination: a broadcast set of normalised n-grams, scanned over all texts.

Words and windows follow ``batches.Words``. A window is ``n`` consecutive words of a benchmark item; an item
of fewer words, but not none, is one window. Hash matches are verified word by word before they count.

Defined cases: a null or empty text has no words and no hits; a null item text gives no window; items that
share a window all count; items without an id count as one, last in order, that adds nothing to joined ids; repeated rows are scanned one by one; an empty benchmark leaves every document
clean; extra columns pass through untouched under any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.batches import Words, chunks, free_name, short_batches, text_bytes
from sessionlake.plans.staging import stage

BLOCK_BYTES = 8_000_000
FILTER_BITS = 22


class WindowTable:
    """The windows of one block of items: sorted hashes with the place of each window in the items' bytes."""

    def __init__(self, rows: list[tuple[str | None, str | None]], n: int):
        self.items = [None if item is None else str(item) for item, _ in rows]
        column = pa.array([text for _, text in rows], pa.string())
        data, offsets = text_bytes(column)
        words = Words(data, offsets) if len(data) else None
        self.parts: dict[int, tuple] = {}
        self.data, self.starts, self.ends = (words.data, words.starts, words.ends) if words else (None, None, None)
        for length in sorted({min(n, int(c)) for c in (words.counts if words else ()) if c}):
            first, hashes = words.windows(length)
            row = words.row[first]
            use = (words.counts[row] >= n) if length == n else (words.counts[row] == length)
            first, hashes, row = first[use], hashes[use], row[use]
            order = np.argsort(hashes, kind="stable")
            passes = np.zeros(1 << FILTER_BITS, bool)
            passes[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.parts[length] = (hashes[order], first[order], row[order], passes)

    def __len__(self) -> int:
        return sum(len(part[0]) for part in self.parts.values())

    def text(self, first: int, length: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[first:first + length], self.ends[first:first + length]))

    def hits(self, words: Words):
        """(first word, length, items) of every window of ``words`` that is also a benchmark window."""
        known: dict[tuple[int, int], list[tuple[bytes, set]]] = {}
        for length, (hashes, firsts, rows, passes) in self.parts.items():
            at, seen = words.windows(length)
            likely = np.flatnonzero(passes[seen >> np.uint64(64 - FILTER_BITS)])
            low = np.searchsorted(hashes, seen[likely], "left")
            real = low < len(hashes)
            likely, low = likely[real], low[real]
            real = hashes[low] == seen[likely]
            for w, j in zip(at[likely[real]].tolist(), low[real].tolist()):
                if (length, j) not in known:
                    texts: dict[bytes, set] = {}
                    for k in range(j, int(np.searchsorted(hashes, hashes[j], "right"))):
                        texts.setdefault(self.text(int(firsts[k]), length), set()).add(self.items[rows[k]])
                    known[length, j] = list(texts.items())
                own = words.joined(w, length)
                for text, items in known[length, j]:
                    if text == own:
                        yield w, length, items


def window_tables(benchmark: DataFrame, item_col: str, text_col: str, n: int, block_bytes: int = BLOCK_BYTES):
    """The benchmark as blocks of items, each block's text about ``block_bytes`` at most, one at a time."""
    item, text = F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    items = benchmark.select(item.alias("item"), text.alias("text")).where("text is not null").distinct()  # else one block gets all repeats of a row
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    for block in range(count):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block)
        yield WindowTable([tuple(row) for row in part.collect()], n)


STATE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),  # first word and word after the last, in turn
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scanner(table, text_at: int, state_at: int | None):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_at))
            old = batch.column(state_at).to_pylist() if state_at is not None else None
            states = []
            for first, part, ends in chunks(data, offsets):
                words = Words(part, ends)
                found: dict[int, tuple[list, set]] = {}
                for w, length, items in table.value.hits(words):
                    row = int(words.row[w])
                    spans, names = found.setdefault(row, ([], set()))
                    w -= int(words.first[row])
                    spans.append((w, w + length))
                    names |= items
                for row, count in enumerate(words.counts.tolist()):
                    spans, names = found.get(row, ([], set()))
                    if old:
                        before = old[first + row]
                        spans = spans + list(zip(before["spans"][::2], before["spans"][1::2]))
                        names = names | set(before["items"])
                    states.append({"n_words": count, "spans": _merge(spans), "items": sorted(names, key=lambda name: (name is None, name or ""))})
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
            columns = [c for k, c in enumerate(batch.columns) if k != state_at]
            names = [str(k) for k in range(len(columns) + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(states, kind)], names)

    return run


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", n: int = 10, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (its name is returned): n_words, hit spans in words, items.

    The broadcast is one block of the benchmark, of ``block_bytes`` of text at most. A larger benchmark is
    scanned block after block over the staged result of the block before, so memory stays bounded.
    """
    short_batches(docs.sparkSession)
    state = free_name(docs.columns, "leak")
    schema = T.StructType([*docs.schema.fields, T.StructField(state, STATE)])
    context, frame, at = docs.sparkSession.sparkContext, docs, docs.columns.index(text_col)
    for number, table in enumerate(window_tables(benchmark, item_col, item_text_col, n, block_bytes)):
        if number:
            frame = stage(frame, "decontaminate-block")
        frame = frame.mapInArrow(_scanner(context.broadcast(table), at, len(docs.columns) if number else None), schema)
    return frame, state


def n_hit(state: str):
    """Number of words inside the hit spans."""
    spans = F.col(f"`{state}`.spans")
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)


def _cutter(text_at: int, state_at: int):
    def run(batches):
        for batch in batches:
            column = batch.column(text_at)
            texts, states = column.to_pylist(), batch.column(state_at).to_pylist()
            for row, state in enumerate(states):
                if state["spans"]:
                    raw = texts[row].encode()
                    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    kept, last = [], 0
                    for start, end in zip(state["spans"][::2], state["spans"][1::2]):
                        kept.append(raw[last:words.starts[start]])
                        last = int(words.ends[end - 1])
                    texts[row] = b"".join([*kept, raw[last:]]).decode()
            columns = [c for k, c in enumerate(batch.columns) if k != state_at]
            columns[text_at] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``mode="spans"``) with the hit spans cut out of their texts."""
    frame, state = scan(docs, benchmark, **options)
    if mode == "documents":
        return frame.where(F.size(F.col(f"`{state}`.spans")) == 0).drop(state)
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")
    at = docs.columns.index(options.get("text_col", "text"))
    return frame.mapInArrow(_cutter(at, len(docs.columns)), docs.schema)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and benchmark items, by windows of 10 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    frame, state = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    hit = n_hit(state)
    return frame.select(
        "doc_id",
        F.col(f"{state}.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(f"{state}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(f"{state}.items")).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), lengths AS (SELECT DISTINCT least(len(w), 10) AS k FROM words WHERE side = 'b' AND len(w) > 0),
items AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM words WHERE side = 'b' AND len(w) > 0)
), hits AS (
  SELECT d.r, d.i, d.k, items.item_id
  FROM (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, lengths WHERE side = 'd')) d
  JOIN items ON items.win = d.win AND items.k = d.k
), hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r
)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (r) LEFT JOIN named USING (r) WHERE side = 'd'
"""
