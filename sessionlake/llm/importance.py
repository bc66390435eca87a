"""Importance resampling towards a target by bit-sliced aggregation.

Features are single words hashed to ``buckets``. A bucket's gain is the scaled logarithm of its smoothed share in the
target over its smoothed share in the documents. Sums of gains are not taken word by word: the bucket counts of a
document become bit planes of one bit for each bucket (plane ``i`` holds bit ``i`` of every count), the gains become
planes in two's complement, and the sum is that of ``2 ** (i + j)`` times the bits that plane ``i`` of the counts and plane
``j`` of the gains share, the plane of the sign counting negative. All of it is integer, so weights are exact.

Both passes read the documents where they stand. What leaves a task of the first is one count for each bucket, what the
driver gathers is one row for each bucket, and what the tasks of the second are sent is the gains: all bounded by
``buckets``, whatever the size of the corpus. Ranks are counted from a histogram of the scores (integers within a few
ten thousand) and by a window inside a score and a range of ids, never over all rows.

Defined cases: a null or empty text has no features, weight 0, and is never drawn; a null id has the noise of the empty
id and loses ties; repeated rows are documents of their own and each gets a rank; of rows with equal score and id
those of larger weight, then of more features, go first; an empty target or an empty table gives gains by the
smoothing alone; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.batches import Words, chunks, short_batches, text_bytes
from sessionlake.plans.running import range_blocks
from sessionlake.plans.staging import stage

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SCALE = 1_000
ROWS = 128
_SHORT = 32
_TABLE = np.zeros(256, np.uint32)
for _bit in range(256):
    _value = _bit
    for _ in range(8):
        _value = _value >> 1 ^ 0xEDB88320 * (_value & 1)
    _TABLE[_bit] = _value


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of every slice of bytes: one table step a byte for all slices at once, the long slices one by one."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] <= _SHORT]
    at, state = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-sizes[order], -np.arange(_SHORT + 1), "left")  # how many slices are longer than k
    for k in range(_SHORT):
        n = live[k]
        if not n:
            break
        part = state[:n]
        state[:n] = _TABLE[(part ^ data[at[:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.zeros(len(sizes), np.uint32)
    out[order] = ~state
    for long in np.flatnonzero(sizes > _SHORT).tolist():
        out[long] = zlib.crc32(data[starts[long]:ends[long]])
    return out


def _rows_of_buckets(column, buckets: int):
    """(first row, rows, row of each word, bucket of each word) of runs of at most ``ROWS`` texts."""
    data, offsets = text_bytes(column)
    for first, part, ends in chunks(data, offsets):
        words = Words(part, ends)
        bucket = (crc32s(words.data, words.starts, words.ends) % np.uint32(buckets)).astype(np.int64)
        for low in range(0, len(ends) - 1, ROWS):
            high = min(low + ROWS, len(ends) - 1)
            mine = slice(words.first[low], words.first[high])
            yield first + low, high - low, words.row[mine] - low, bucket[mine]


def count_planes(row: np.ndarray, bucket: np.ndarray, rows: int, buckets: int):
    """(rows, planes) for every bit of the counts: the rows that have it and, for each, a plane of packed bits."""
    key, count = np.unique(row * buckets + bucket, return_counts=True)
    row, bucket = key // buckets, key % buckets
    bit = 0
    while len(count):
        odd = np.flatnonzero(count & 1)
        if len(odd):
            have = np.unique(row[odd])
            plane = np.zeros((len(have), -(-buckets // 64) * 64), bool)
            plane[np.searchsorted(have, row[odd]), bucket[odd]] = True
            yield bit, have, np.packbits(plane, axis=1).view(np.uint64)
        rest = count > 1
        row, bucket, count = row[rest], bucket[rest], count[rest] >> 1
        bit += 1


def gain_planes(gains: np.ndarray) -> np.ndarray:
    """The gains in two's complement, one plane a bit, the sign last."""
    bits = max(int(np.abs(gains).max(initial=0)).bit_length(), 1) + 1
    padded = np.zeros(-(-len(gains) // 64) * 64, np.int64)
    padded[:len(gains)] = gains
    return np.stack([np.packbits((padded >> j & 1).astype(bool)).view(np.uint64) for j in range(bits)])


def gain_sums(row: np.ndarray, bucket: np.ndarray, rows: int, buckets: int, planes: np.ndarray) -> np.ndarray:
    """Exact sum of the gains of every row's words."""
    total = np.zeros(rows, np.int64)
    for bit, have, plane in count_planes(row, bucket, rows, buckets):
        for j, gain in enumerate(planes):
            common = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (bit + j)
            total[have] += -common if j == len(planes) - 1 else common
    return total


def _counter(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket in _rows_of_buckets(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many words of all texts fall in each bucket."""
    counted = texts.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(_counter(buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(target share / source share))`` of each bucket, shares smoothed by one word a bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(SCALE * math.log((int(t) + 1) * (s_all + buckets) / ((int(s) + 1) * (t_all + buckets))))
                     for s, t in zip(source, target)], np.int64)


def _weigher(planes, buckets: int):
    def run(batches):
        for batch in batches:
            many, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, rows, row, bucket in _rows_of_buckets(batch.column(1), buckets):
                n = np.bincount(row, minlength=rows)
                many[first:first + rows] = n
                weight[first:first + rows] = gain_sums(row, bucket, rows, buckets, planes.value) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), pa.array(weight)], ["id", "n_features", "weight"])

    return run


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
            buckets: int = BUCKETS) -> DataFrame:
    """``id``, ``n_features`` and ``weight`` (floored mean gain of its words) of every document."""
    short_batches(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    planes = docs.sparkSession.sparkContext.broadcast(gain_planes(gains))
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(_weigher(planes, buckets), f"id {kind}, n_features long, weight long")


def noisy_scores(weighted: DataFrame, seed: int) -> DataFrame:
    """Add ``score``: the weight plus Gumbel noise drawn from a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, seed: int, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``id, n_features, weight, score, rank``: ``percent`` of the documents of enough words are drawn, highest scores first."""
    scored = stage(noisy_scores(weights(docs, target, **options), seed), "importance")
    fit = scored.where(F.col("n_features") >= min_words)
    levels = fit.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # one row a score
    levels = stage(levels.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))), "score-levels")
    wanted = percent * (levels.agg(F.sum("n")).first()[0] or 0) // 100
    lowest = levels.where(F.col("above") < wanted).agg(F.min("score")).first()[0]
    columns = ["id", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    order = [F.asc_nulls_last("id"), F.desc("weight"), F.desc("n_features")]
    near = fit.where(F.col("score") >= lowest)
    cut = range_blocks(near, [F.desc("score"), *order], "__range")
    parts = cut.groupBy("score", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("score").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(levels.select("score", "above"), "score")
    place = F.row_number().over(Window.partitionBy("score", "__range").orderBy(*order))
    ranked = cut.withColumn("place", place).join(parts, ["score", "__range"]).withColumn("rank", F.col("above") + F.col("before") + F.col("place"))
    drawn = ranked.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    rest = scored.where((F.col("n_features") < min_words) | (F.col("score") < lowest))
    return drawn.union(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards the benchmark, its noisy score, and its rank if it is drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = resample(docs, target, seed=2024)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8),
words AS (
  SELECT 'd' AS side, r, unnest(w) AS word
  FROM (SELECT row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
  UNION ALL
  SELECT 'b', 0, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), spelled AS (
  SELECT word, list_transform(range(1, CAST(octet_length(encode(word)) AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT word FROM words)
), hashed AS (
  SELECT word, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM spelled, crc_table
), placed AS (SELECT side, r, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
totals AS (SELECT sum(n) FILTER (side = 'd') AS s_all, sum(n) FILTER (side = 'b') AS t_all FROM placed),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (coalesce(s_all, 0) + 10000) / ((s + 1) * (coalesce(t_all, 0) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS DOUBLE) AS t
        FROM placed GROUP BY bucket), totals
), sums AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS BIGINT) AS weight,
         CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM (SELECT doc_id, row_number() OVER () AS r FROM documents) LEFT JOIN sums USING (r)
), noisy AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, weight DESC, n_features DESC) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS fit FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM ranked
"""
