"""Line dedup over content-defined chunks of lines.

Lines that stand in the corpus once cannot be part of a repeat, so only runs of repeated lines are looked at. A run is cut
into chunks where a rolling hash over the hashes of two lines says so (``DIVISOR``) and at its ends; the hash depends on the lines alone,
so a passage has the same inner chunks wherever it stands. A chunk has two lines or more; a line of ``LONG_WORDS`` words
(parted by white space) is a chunk by itself. The first place of every chunk (smallest id, then place) is kept. A later place is grown line by
line, up to ``GROW`` lines on each side, as long as the kept document goes on with the same lines, and neighbouring chunks of one
passage meet to one passage. Of passages of a document that overlap or touch, but are kept in different places, the longest is taken.

A passage is cut only if the kept place is the same by its bytes and nothing is cut from it. So what goes stands, in one
piece, in a text that stays; text that stands nowhere else is never cut. Where two rules meet, more stays, not less.

Lines and chunks are hashed in tasks. Counts and first places combine before every shuffle, so a passage that a third of all
documents hold costs a row a task; what is collected for a document are its own repeated lines and passages.

Defined cases: a null or empty text has no chunks and stays; of a repeated long line in one text the first stays; a
repeated line of fewer words between lines that are not repeated with it stays; a text all of whose lines go becomes empty; rows
that agree in id and text count as one document and are cut alike; null ids come before all others; two passages that share a 64-bit hash but
not their bytes both stay; an empty table stays empty; other columns pass through under any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.batches import chunks, free_name, mix, short_batches, slice_hashes, slices, text_bytes
from sessionlake.plans.staging import stage

LONG_WORDS = 50
DIVISOR = 2
GROW = 8
_SLICE = 50
_EXTRACT_BYTES = 4 << 20
_FEED = 10
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def filled_lines(data: np.ndarray, offsets: np.ndarray):
    """(row, number in the row, first byte, byte after the last, line feeds before it, words, hash) of every line that is not empty."""
    feed = np.flatnonzero(data == _FEED)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    # A line ends at a line feed or at the end of its row.
    ends = np.concatenate([feed, offsets[filled + 1]])
    row = np.concatenate([np.searchsorted(offsets, feed, "right") - 1, filled])
    last = np.concatenate([np.zeros(len(feed), bool), np.ones(len(filled), bool)])
    order = np.lexsort((last, ends, row))
    ends, row, last = ends[order], row[order], last[order]
    if not len(ends):
        return tuple(np.zeros(0, np.int64) for _ in range(6)) + (np.zeros(0, np.uint64),)
    starts = np.concatenate([[0], np.where(last[:-1], ends[:-1], ends[:-1] + 1)])
    kept = np.flatnonzero(ends > starts)
    starts, ends, row = starts[kept], ends[kept], row[kept]
    open_ = np.concatenate([[True], _SPACE[data[:-1]]])  # a word can begin here
    open_[offsets[:-1][offsets[:-1] < len(data)]] = True
    words = np.concatenate([[0], np.cumsum(open_ & ~_SPACE[data])])
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    number = np.arange(len(row)) - first[row]
    gap = np.where(number > 0, starts - np.concatenate([[0], ends[:-1]]), 0)
    return row, number, starts, ends, gap, words[ends] - words[starts], slice_hashes(data, starts, ends)


def _key_columns(id_col: str, text_col: str) -> list:
    whole = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    return [F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(4), *whole[::-1]).alias("k2")]


def _find(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        for first, part, ends in chunks(data, offsets):
            row, number, start, end, gap, words, code = filled_lines(part, ends)
            at = pa.array(first + row)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(k).take(at) for k in range(3)], pa.array(number), pa.array(start - ends[row]), pa.array(end - start), pa.array(gap),
                pa.array(words >= LONG_WORDS), pa.array(code.view(np.int64))], ["k1", "k2", "id", "number", "start", "size", "gap", "long", "hash"])


def line_chunks(numbers: list[int], codes: list[int], gaps: list[int], long: list[bool]):
    """(first, last) places in the lists of every chunk: pieces of two lines or more of runs of numbers, and long lines."""
    h = np.array(codes, np.uint64)
    # The line feeds between two lines are part of what is hashed.
    rolled = mix(h[:-1] * _ROLL + h[1:] + np.array(gaps[1:], np.uint64))
    low = 0
    for at in range(len(numbers)):
        run_ends = at + 1 == len(numbers) or numbers[at + 1] != numbers[at] + 1
        if long[at]:
            yield at, at
        # The two lines before a boundary belong to one chunk, so every chunk but the last of a run has at least two.
        if run_ends or (at > low and int(rolled[at - 1]) % DIVISOR == 0):
            if at > low:
                yield low, at
            low = at + 1


def _grown(numbers: list[int], first: int, step: int) -> list[int]:
    """Places next to ``first`` in one direction, as long as the run goes on."""
    out, at = [], first
    while len(out) < GROW and 0 <= at + step < len(numbers) and numbers[at + step] == numbers[at] + step:
        at += step
        out.append(at)
    return out


def _joint(codes: list[int], gaps: list[int], places: list[int], inner: int) -> list[int]:
    """Running hashes over the lines at ``places``, each with the line feeds towards the place before it (none for ``inner`` itself)."""
    out, h, before = [], 0, inner
    for at in places:
        h = ((h ^ codes[at]) * int(_ROLL) + (gaps[max(at, before)] if at != before else 0)) & _MASK
        out.append(h - (1 << 64) if h >> 63 else h)
        before = at
    return out


_CHUNK_FIELDS = "hash long, size long, first long, last long, start long, end long, lefts array<long>, left_at array<long>, rights array<long>, right_end array<long>"


def _chunk(batches):
    for batch in slices(batches, _SLICE):
        rows, out = [], []
        for row, lines in enumerate(batch.column(3).to_pylist()):
            lines.sort(key=lambda line: line["number"])
            number, start, size, gap, long, code = ([line[name] for line in lines] for name in ("number", "start", "size", "gap", "long", "hash"))
            code = [value & _MASK for value in code]
            for first, last in line_chunks(number, code, gap, long):
                whole = _joint(code, gap, list(range(first, last + 1)), first)[-1]
                left, right = _grown(number, first, -1), _grown(number, last, 1)
                rows.append(row)
                out.append((whole ^ (last - first), start[last] + size[last] - start[first], number[first], number[last], start[first], start[last] + size[last],
                            _joint(code, gap, left, first), [start[at] for at in left], _joint(code, gap, right, last), [start[at] + size[at] for at in right]))
        at = pa.array(rows, pa.int64())
        columns = list(zip(*out)) or [[]] * 10
        kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(3)], *[pa.array(list(c), kind) for c, kind in zip(columns, kinds)]],
                                         [str(k) for k in range(13)])


_RUN = "first long, last long, start long, end long, a1 long, a2 long, a_first long, a_last long, a_start long, a_end long"


def passages(runs: list[dict]) -> list[dict]:
    """Of the runs of one document those to cut: runs of one kept passage meet, then the longest first, none touching another."""
    runs = sorted(runs, key=lambda run: (run["a1"], run["a2"], run["first"] - run["a_first"], run["start"] - run["a_start"], run["first"], -run["last"]))
    joined: list[dict] = []
    for run in runs:
        one = joined[-1] if joined else None
        if one and all(one[k] == run[k] for k in ("a1", "a2")) and all(one[k] - one[f"a_{k}"] == run[k] - run[f"a_{k}"] for k in ("first", "start")) and run["first"] <= one["last"] + 1:
            if run["last"] > one["last"]:
                one |= {k: run[k] for k in ("last", "end", "a_last", "a_end")}
        else:
            joined.append(dict(run))
    taken: list[dict] = []
    for run in sorted(joined, key=lambda run: (run["start"] - run["end"], run["first"])):
        apart = lambda other: run["first"] > other["last"] + 1 or run["last"] < other["first"] - 1
        again = lambda other: (run["first"] > other["last"] or run["last"] < other["first"]) and all(run[k] == other[k] for k in ("a1", "a2", "a_first", "a_last"))
        if all(apart(other) or again(other) for other in taken):
            taken.append(run)
    return taken


def _choose(batches):
    names = [part.split()[0] for part in _RUN.split(", ")]
    for batch in slices(batches, _SLICE):
        rows, out = [], []
        for row, runs in enumerate(batch.column(2).to_pylist()):
            for run in passages(runs):
                rows.append(row)
                out.append([run[name] for name in names])
        at = pa.array(rows, pa.int64())
        columns = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(list(c), pa.int64()) for c in columns]], ["k1", "k2", *names])


def _extract(batches):
    held, size = [], 0
    for batch in slices(batches, _SLICE):
        for row, wanted in enumerate(batch.column(1).to_pylist()):
            raw = memoryview(batch.column(0)[row].as_buffer())
            for place in wanted:
                held.append((place["passage"], place["kept"], bytes(raw[place["start"]:place["end"]])))
                size += place["end"] - place["start"]
                if size > _EXTRACT_BYTES:
                    yield _extracted(held)
                    held, size = [], 0
    yield _extracted(held)


def _extracted(held: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*held)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.bool_(), pa.binary()))], ["passage", "kept", "bytes"])


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2`` (a document) and ``start, size`` in bytes of every passage that is kept elsewhere."""
    short_batches(docs.sparkSession)
    keyed = docs.where(F.col(f"`{text_col}`").isNotNull()).select(*_key_columns(id_col, text_col), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    head = f"k1 long, k2 long, id {keyed.schema['id'].dataType.simpleString()}"
    lines = stage(keyed.mapInArrow(_find, f"{head}, number long, start long, size long, gap long, long boolean, hash long"), "lines")
    often = lines.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "size")
    shared = lines.join(often, ["hash", "size"]).select("k1", "k2", "id", F.struct("number", "start", "size", "gap", "long", "hash").alias("line")).distinct()
    of_docs = shared.groupBy("k1", "k2", "id").agg(F.collect_list("line").alias("lines"))
    found = stage(of_docs.mapInArrow(_chunk, f"{head}, {_CHUNK_FIELDS}"), "line-chunks")

    place = F.struct("id", "k1", "k2", "start", "first", "last", "end", "lefts", "left_at", "rights", "right_end")
    kept = found.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a")).where("n > 1").select("hash", "size", "a")
    later = found.join(kept, ["hash", "size"]).where("NOT (id <=> a.id AND k1 = a.k1 AND k2 = a.k2 AND start = a.start)")
    same = lambda side: F.size(F.filter(F.zip_with(side, f"a.{side}", lambda one, other: one == other), lambda equal: equal))
    later = later.withColumns({"l": same("lefts"), "r": same("rights")})
    at = lambda places, n, own: F.when(F.col(n) > 0, F.get(places, F.col(n) - 1)).otherwise(F.col(own))
    runs = later.select(
        "k1", "k2", (F.col("first") - F.col("l")).alias("first"), (F.col("last") + F.col("r")).alias("last"), at("left_at", "l", "start").alias("start"), at("right_end", "r", "end").alias("end"),
        F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), (F.col("a.first") - F.col("l")).alias("a_first"), (F.col("a.last") + F.col("r")).alias("a_last"),
        at("a.left_at", "l", "a.start").alias("a_start"), at("a.right_end", "r", "a.end").alias("a_end")).distinct()
    own = [name.split()[0] for name in _RUN.split(", ")]
    chosen = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct(*own)).alias("runs"))
    cuts = stage(chosen.mapInArrow(_choose, f"k1 long, k2 long, {_RUN}"), "passages")

    # A kept place from which something is cut itself is no kept place.
    of_kept = cuts.groupBy(F.col("k1").alias("a1"), F.col("k2").alias("a2")).agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    touched = F.exists("gone", lambda gone: (gone["first"] <= F.col("a_last")) & (gone["last"] >= F.col("a_first")))
    sure = cuts.join(of_kept, ["a1", "a2"], "left").where(F.col("gone").isNull() | ~touched).drop("gone")
    sure = stage(sure.withColumn("passage", F.xxhash64("a1", "a2", "a_start", "a_end")), "sure-passages")

    wanted = sure.select("k1", "k2", "start", "end", "passage", F.lit(False).alias("kept")).union(
        sure.select("a1", "a2", "a_start", "a_end", "passage", F.lit(True).alias("kept")).distinct())
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end", "passage", "kept")).alias("wanted"))
    texts = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "wanted")
    told = texts.mapInArrow(_extract, "passage long, kept boolean, bytes binary").groupBy("passage").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    equal = told.where("low = high").select("passage")
    return sure.join(equal, "passage").select("k1", "k2", "start", (F.col("end") - F.col("start")).alias("size"))


def _cutter(text_at: int, cuts_at: int):
    def run(batches):
        for batch in batches:
            column, cuts = batch.column(text_at), batch.column(cuts_at).to_pylist()
            changed = [row for row, each in enumerate(cuts) if each]
            if changed:
                texts = column.to_pylist()
                for row in changed:
                    raw, kept, at = texts[row].encode(), [], 0
                    for place in sorted(cuts[row], key=lambda x: x["start"]):  # they can overlap
                        kept.append(raw[at:place["start"]])
                        at = max(at, place["start"] + place["size"] + 1)  # with the line feed behind it
                    rest = raw[at:]
                    text = b"".join(kept) + rest
                    if at > len(raw) and text.endswith(b"\n"):
                        text = text[:-1]  # the last line went: so does the feed before it
                    texts[row] = text.decode()
                column = pa.array(texts, column.type)
            columns = list(batch.columns[:cuts_at])
            columns[text_at] = column
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(cuts_at)])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every later copy of a chunk of lines cut out of its text."""
    k1, k2, cuts = (free_name(docs.columns, name) for name in ("k1", "k2", "cuts"))
    one, two = _key_columns(id_col, text_col)
    later = repeated(docs, id_col, text_col).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_list(F.struct("start", "size")).alias(cuts))
    marked = docs.withColumns({k1: one, k2: two}).join(later, [k1, k2], "left").select(*[F.col(f"`{name}`") for name in docs.columns], cuts)
    return marked.mapInArrow(_cutter(docs.columns.index(text_col), len(docs.columns)), docs.schema)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's text without repeated chunks, as digests, and how many bytes went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    before = docs.select("doc_id", "text", F.octet_length("text").alias("bytes_before"))
    return dedup_lines(before).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("bytes_kept"),
        (F.col("bytes_before") - F.octet_length("text")).cast("long").alias("bytes_cut"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        (F.col("bytes_before") > F.octet_length("text")).alias("changed"),
    )
