"""MinHash near-dedup by ProbMinHash over weighted word shingles.

A text's shingles are its windows of ``SHINGLE`` words (a text of fewer words, but not none, is one shingle),
weighted by how often they occur. Each shingle is a Poisson process whose rate is its weight: its arrivals, at
times and registers that only the shingle decides, compete for the registers of the signature, and a shingle
stops as soon as its next arrival is later than every register's first one. Two texts agree in a register
with the probability Jaccard similarity of their shingles. ``BANDS`` bands of ``ROWS`` registers give the buckets.

With unit weights that similarity is the plain Jaccard similarity of the shingle sets, which decides. So every text
has the buckets of its unit signature, and a text with repeated shingles has those of its weighted one besides.

Texts with equal shingles are one node, however many copies there are. First every member of a bucket is paired with
the bucket's smallest node; a pair that meets in several buckets is one pair. Pairs of fitting size whose unit
signatures do not disagree in far more registers than a similar pair's would (``DEVIATIONS`` standard deviations) are verified by the exact Jaccard
similarity of their shingle sets, and components of the verified links are formed. A bucket within one
component is done. In all others every two members of different components are compared, none left out: those of up to
``SMALL`` members as pairs; larger buckets are dealt to cells, so that any two members meet in one cell of bounded size. A
cell compares signatures and shingle sets by itself and gives only links that join two components, so
the rows stay as many as the members of the cells, whatever the number of pairs. Components of the verified links are the classes. Recall is set by
bands, registers and deviations; the README gives it as measured against all pairs.

Defined cases: a text that is null, empty or without a word is a class of its own; repeated rows are copies of
each other and one of them is kept; a null id counts as the smallest when the kept row is chosen, and is no class
id unless all ids of the class are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.batches import Words, chunks, free_name, mix, short_batches, text_bytes
from sessionlake.llm.components import components
from sessionlake.plans.staging import stage

SHINGLE = 5
BANDS = 25
ROWS = 6
SMALL = 8
CELL_ROWS = 1_024
CELL_BYTES = 4 << 20
DEVIATIONS = 5
CHUNK = (1 << 20) - 1
_ARRIVAL = np.uint64(0x9E3779B97F4A7C15)
_REGISTER = np.uint64(0xC2B2AE3D27D4EB4F)


def _times(constant: np.uint64, turn: int) -> np.uint64:
    return np.uint64(int(constant) * turn % (1 << 64))


def shingles(words: Words, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of the distinct shingles of every row, rows in order."""
    first, codes = words.windows(length)
    row = words.row[first]
    parts = [(row, codes)]
    for short in range(1, length):
        if (words.counts == short).any():
            first, codes = words.windows(short)
            own = words.counts[words.row[first]] == short
            parts.append((words.row[first][own], codes[own]))
    row, codes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((codes, row))
    row, codes = row[order], codes[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])])[:len(row)])
    return row[new], codes[new], np.diff(np.concatenate([new, [len(row)]])).astype(np.float64)


def signatures(row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: int, size: int) -> np.ndarray:
    """The shingle that arrives first in each register of each row (rows without shingles: zeros)."""
    time, owner = np.full(rows * size, np.inf), np.zeros(rows * size, np.uint64)
    now, turn = np.zeros(len(row)), 0
    while len(row):
        turn += 1
        draw = mix(code + _times(_ARRIVAL, turn))
        now = now - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight
        at = row * size + (mix(code ^ _times(_REGISTER, turn)) % np.uint64(size)).astype(np.int64)
        early = np.flatnonzero(now < time[at])
        np.minimum.at(time, at[early], now[early])
        won = early[time[at[early]] == now[early]]
        owner[at[won]] = code[won]
        live = now < time.reshape(rows, size).max(axis=1)[row]
        row, code, weight, now = row[live], code[live], weight[live], now[live]
    return owner.reshape(rows, size)


def _nibbles(sign: np.ndarray) -> np.ndarray:
    """Four bits of every register, sixteen registers to a 64-bit integer."""
    bits = mix(sign) >> np.uint64(60)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16))).reshape(len(bits), -1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _different(registers: int):
    """In how many registers' bits ``code`` and ``hub_code`` differ."""
    total = F.lit(0)
    for at in range(-(-registers // 16)):
        x = F.get("code", F.lit(at)).bitwiseXOR(F.get("hub_code", F.lit(at)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _most_different(registers: int, threshold: float) -> int:
    """What two texts at the threshold exceed with a probability below one in a million (at five deviations)."""
    same = threshold + (1 - threshold) / 16
    return int(registers * (1 - same) + DEVIATIONS * (registers * same * (1 - same)) ** 0.5) + 1


def _band_keys(sign: np.ndarray, bands: int, registers: int) -> np.ndarray:
    """One key for each band of each row."""
    sign = sign.reshape(len(sign), bands, registers)
    key = np.zeros((len(sign), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for k in range(registers):
        key = mix(key * _ARRIVAL + sign[:, :, k])
    return key


def _sketcher(bands: int, registers: int, shingle: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            for first, part, ends in chunks(data, offsets, CHUNK):
                rows = len(ends) - 1
                row, code, weight = shingles(Words(part, ends), shingle)
                sign = signatures(row, code, np.ones(len(row)), rows, bands * registers)
                key = _band_keys(sign, bands, registers)
                again = np.bincount(row, weight > 1, rows) > 0  # rows whose weighted signature is another one
                heavy_rows, own = np.flatnonzero(again), again[row]
                place = np.cumsum(again) - 1
                heavy_key = _band_keys(signatures(place[row[own]], code[own], weight[own], len(heavy_rows), bands * registers), bands, registers)
                new = heavy_key != key[heavy_rows]
                key_row = np.concatenate([np.repeat(np.arange(rows), bands), np.repeat(heavy_rows, bands)[new.reshape(-1)]])
                key = np.concatenate([key.reshape(-1), heavy_key[new]])[np.argsort(key_row, kind="stable")]
                key_ends = np.concatenate([[0], np.cumsum(np.bincount(key_row, minlength=rows))]).astype(np.int32)
                many = np.bincount(row, minlength=rows)
                sums = np.zeros((2, rows), np.uint64)
                heavy = code * (weight.astype(np.uint64) * np.uint64(2) + np.uint64(1))
                np.add.at(sums[0], row, mix(heavy))
                np.add.at(sums[1], row, mix(heavy ^ _REGISTER))
                lists = pa.ListArray.from_arrays(pa.array(key_ends), pa.array(key.view(np.int64)))
                codes = _nibbles(sign)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, rows) for c in batch.columns[:3]], pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(many), lists, codes],
                    ["id", "k1", "k2", "d1", "d2", "size", "bands", "code"])

    return run


def _keys(id_col: str, text_col: str) -> list:
    whole = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    return [F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(8), *whole[::-1]).alias("k2")]


def _similar(shingle: int, threshold: float):
    """Pairs whose shingle sets have at least the threshold's Jaccard similarity."""

    def sets(column, first: int, last: int):
        data, offsets = text_bytes(column.slice(first, last - first))
        row, code, _ = shingles(Words(data, offsets), shingle)
        return row, code

    def run(batches):
        for batch in batches:
            sizes = np.diff(text_bytes(batch.column(2))[1]) + np.diff(text_bytes(batch.column(3))[1])
            ends, keep = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(batch.num_rows, bool)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
                (ra, ca), (rb, cb) = sets(batch.column(2), first, last), sets(batch.column(3), first, last)
                row, code = np.concatenate([ra, rb]), np.concatenate([ca, cb])
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                both = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] == code[:-1]))
                common = np.bincount(row[both], minlength=last - first)
                keep[first:last] = common >= threshold * (np.bincount(row, minlength=last - first) - common) - 1e-9
                first = last
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["one", "other"]).filter(pa.array(keep))

    return run


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's smallest node."""
    hubs = buckets.groupBy("band").agg(F.min("node").alias("one"))
    return buckets.select("band", F.col("node").alias("other")).join(hubs, "band").where("one < other").select("one", "other")


def _small_pairs(buckets: DataFrame) -> DataFrame:
    """All pairs of members of different components in buckets of up to ``SMALL`` members."""
    small = buckets.where(F.col("n") <= SMALL)
    left, right = (small.select("band", F.col("node").alias(name), F.col("component").alias(f"of_{name}")) for name in ("one", "other"))
    return left.join(right, "band").where("one < other AND of_one <> of_other").select("one", "other")


def _cells(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """Members of larger buckets by cell: a bucket is cut into parts, and a cell holds two parts or, if ``whole``, one."""
    large = buckets.where(F.col("n") > SMALL).join(texts.select("node", "size", "code", F.octet_length("text").alias("bytes")), "node")
    parts = large.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL_ROWS), F.ceil(F.sum("bytes") / CELL_BYTES), F.lit(1)).cast("int").alias("parts"))
    dealt = large.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(F.xxhash64("band", F.least("part", "with"), F.greatest("part", "with")).alias("cell"), "node", "component", "part",
                        (F.col("part") == F.col("with")).alias("own"), "size", "code")


def _whole(own: np.ndarray, part: np.ndarray) -> bool:
    """Does the cell hold one part only? Then its members are compared with each other, else across the parts."""
    return bool(own.all()) and len(np.unique(part)) == 1


def _close(cell: pa.Table, threshold: float, most: int):
    """(first, hits) by slices of rows: pairs across components whose sizes and signatures do not rule them out, each once."""
    node, component, part, size = (cell[name].to_numpy() for name in ("node", "component", "part", "size"))
    whole = _whole(cell["own"].to_numpy(), part)
    code = cell["code"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
    step = max(1, (1 << 20) // max(1, len(node)))
    for first in range(0, len(node), step):
        at = slice(first, first + step)
        different = np.zeros((len(node[at]), len(node)), np.uint16)
        for word in range(code.shape[1]):
            x = code[at, None, word] ^ code[None, :, word]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            different += np.bitwise_count(x & np.uint64(0x1111111111111111))
        hits = (different <= most) & (node[at, None] < node) & (component[at, None] != component)
        hits &= np.minimum(size[at, None], size) >= threshold * np.maximum(size[at, None], size) - 1e-9
        yield first, hits if whole else hits & (part[at, None] != part)


def _drawn(threshold: float, most: int):
    """The members of a cell that are in any pair to be verified."""

    def run(cell: pa.Table) -> pa.Table:
        wanted = np.zeros(cell.num_rows, bool)
        for first, hits in _close(cell, threshold, most):
            wanted |= hits.any(axis=0)
            wanted[first:first + len(hits)] |= hits.any(axis=1)
        return cell.select(["cell", "node", "component", "part", "own"]).filter(pa.array(wanted))

    return run


def _linked(shingle: int, threshold: float, most: int):
    """Verified pairs of a cell, without those between components that others of its pairs have joined."""

    def run(cell: pa.Table) -> pa.Table:
        node, group = cell["node"].to_numpy(), cell["component"].to_numpy().copy()
        data, offsets = text_bytes(cell["text"].combine_chunks())
        found = [shingles(Words(part, ends), shingle) for _, part, ends in chunks(data, offsets, CHUNK)]
        codes = np.unique(np.concatenate([codes for _, codes, _ in found]), return_inverse=True)[1]
        many = cell["size"].to_numpy()
        starts, marked, links = np.cumsum(many) - many, np.zeros(len(codes) + 1, bool), []
        for first, hits in _close(cell, threshold, most):
            for one, near in enumerate(hits, first):
                others = np.flatnonzero(near)
                others = others[group[others] != group[one]]
                if not len(others):
                    continue
                own, sizes = codes[starts[one]:starts[one] + many[one]], many[others]
                marked[own] = True
                at = np.arange(sizes.sum()) + np.repeat(starts[others] - (np.cumsum(sizes) - sizes), sizes)
                common = np.bincount(np.repeat(np.arange(len(others)), sizes), marked[codes[at]], len(others))
                marked[own] = False
                for other in others[common >= threshold * (many[one] + sizes - common) - 1e-9]:
                    if group[other] != group[one]:
                        links.append((node[one], node[other]))
                        group[group == group[other]] = group[one]
        links = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"one": links[:, 0], "other": links[:, 1]})

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = SHINGLE,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``id``, ``k1, k2`` (hashes of id and text), ``class_id`` (smallest id) and ``kept``."""
    short_batches(docs.sparkSession)
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), *_keys(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    id_field = keyed.schema["id"]
    long = T.LongType()
    schema = T.StructType([id_field, *[T.StructField(name, long) for name in ("k1", "k2", "d1", "d2", "size")], *[T.StructField(name, T.ArrayType(long)) for name in ("bands", "code")]])
    sketch = stage(keyed.mapInArrow(_sketcher(bands, rows, shingle), schema).withColumn("row", F.monotonically_increasing_id()), "sketches")
    worded = sketch.where("size > 0")
    nodes = stage(worded.groupBy("d1", "d2").agg(F.min(F.struct("k1", "k2")).alias("text_key"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("code").alias("code"))
                  .withColumn("node", F.monotonically_increasing_id()), "nodes")  # fixed by being written
    placed = nodes.select("node", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stage(placed.join(shared, "band").withColumn("component", F.col("node")), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "size", "code", F.col("text_key.k1").alias("k1"), F.col("text_key.k2").alias("k2"))
    texts = stage(keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).groupBy("node").agg(
        F.first("text").alias("text"), F.first("size").alias("size"), F.first("code").alias("code")), "texts")
    fits = (F.least("size", "hub_size") >= threshold * F.greatest("size", "hub_size") - 1e-9) & (_different(bands * rows) <= _most_different(bands * rows, threshold))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (columns ``one, other``) of texts that are similar enough, each read once."""
        sides = [texts.select(F.col("node").alias(name), *[F.col(old).alias(new) for old, new in zip(("size", "code"), made)]) for name, made in (("one", ("size", "code")), ("other", ("hub_size", "hub_code")))]
        near = stage(pairs.distinct().join(sides[0], "one").join(sides[1], "other").where(fits).select("one", "other"), "candidates")
        left, right = (texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}")) for name in ("one", "other"))
        told = near.join(left, "one").join(right, "other").select("one", "other", "text_one", "text_other")
        return stage(told.mapInArrow(_similar(shingle, threshold), "one long, other long"), "verified")

    def compared(buckets: DataFrame) -> DataFrame:
        """Links between members of larger buckets, enough to join all components that any pair joins."""
        most = _most_different(bands * rows, threshold)
        drawn = _cells(buckets, texts).groupBy("cell").applyInArrow(_drawn(threshold, most), "cell long, node long, component long, part int, own boolean")
        told = stage(drawn, "cells").join(texts, "node").groupBy("cell").applyInArrow(_linked(shingle, threshold, most), "one long, other long")
        return stage(told, "linked")

    links = verified(_hub_pairs(buckets))
    component = stage(components(links, "one", "other"), "components")
    merged = buckets.drop("component").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = merged.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    buckets = stage(merged.join(mixed, "band", "left_semi").select("node", "band", "n", "component"), "buckets")
    links = links.union(verified(_small_pairs(buckets))).union(compared(buckets))
    component = stage(components(links, "one", "other"), "components")
    of_text = nodes.join(component, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    members = stage(worded.join(of_text, ["d1", "d2"]).select("id", "k1", "k2", "row", "component"), "members")
    best = members.groupBy("component").agg(F.min("id").alias("class_id"), F.min(F.struct("id", "row")).getField("row").alias("best"))
    alone = sketch.where("size = 0").select("id", "k1", "k2", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    return members.join(best, "component").select("id", "k1", "k2", "class_id", (F.col("row") == F.col("best")).alias("kept")).union(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class; texts without words all stay.

    Of rows that agree in id and text one stays, whichever; they are combined before the shuffle, so a row of any number of
    repeats is no hot key. Null texts, an empty table, ties and clashing column names as in the module's cases.
    """
    k1, k2, left, salt = (free_name(docs.columns, name) for name in ("k1", "k2", "n_kept", "salt"))
    kept = classes(docs, id_col, text_col, **options).where("kept").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.count(F.lit(1)).alias(left))
    one, two = _keys(id_col, text_col)
    marked = docs.withColumns({k1: one, k2: two}).join(kept, [k1, k2])
    # Several rows of one key are kept only if they have no words; these differ in the salt.
    salted = marked.withColumn(salt, F.when(F.col(left) > 1, F.monotonically_increasing_id()).otherwise(0))
    return salted.dropDuplicates([k1, k2, salt]).select(*[F.col(f"`{name}`") for name in docs.columns])


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it is the one that stays."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "kept")
