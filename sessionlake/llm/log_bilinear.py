"""Scoring of texts by a log-bilinear language model that is trained by noise-contrastive estimation.

The model predicts the feature vector of the next token from those of the two tokens before, ``h = c1 * q[w-1] + c2 * q[w-2]``,
and gives a token the score ``h . r[w] + b[w]``. Its vocabulary is the ``words`` most frequent training tokens, the end of a
text (which also stands before its start), and one class for all other tokens; a token of that class has the share
``(c + 1) / (n + v + 1)`` of it, with ``n`` and ``v`` the class's training tokens and distinct tokens, so every token has a
probability and all of them (unseen ones as one) sum to one. Probabilities are normalised over the whole vocabulary by
matrix products over the distinct contexts of a batch.

What is learnt comes from every training text. Token counts are one aggregate over all of them, kept as a table that grows
with the corpus. The tokens at the head of that table (``FREQUENT`` at most, of ``LONGEST`` bytes at most) are sent to the
tasks; all others are joined by token, so a token of a third of all rows is never a join key unless it is longer than that or
stands in no training text, where adaptive execution splits it. Weights are trained in ``rounds``: each round takes
its share of the training texts, every task runs over all tokens of its part from the same start, and the tasks' weights are
averaged by tokens, first in ``MERGERS`` tasks and then over one row from each. A round uses noise words shared by a minibatch,
whose scores are a matrix product too.

Defined cases: a null or empty text is the end alone; a null id hashes as the empty text; repeated rows are texts of their
own; tokens of equal count are ordered by their bytes; without training texts all counts are 0 and the model knows two classes of
equal probability; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.batches import chunks, short_batches, slice_hashes, text_bytes
from sessionlake.plans.staging import stage

WORDS = 1_500
DIMS = 24
ROUNDS = 4
FREQUENT = 262_144
LONGEST = 64
NOISE = 64
MINIBATCH = 1_024
RATE = 0.1
MERGERS = 8
OTHER, END = 0, 1
_CHUNK = 4 << 20
_POSITIONS = 1 << 19
_CONTEXTS = 2_048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Tokens:
    """Runs of bytes between white space, A-Z lower-cased, of a chunk of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        filled = ~_SPACE[data]
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = ~(filled[:-1] & filled[1:]) | border[1:-1]
        self.starts = np.flatnonzero(filled & edge[:-1])
        self.ends = np.flatnonzero(filled & edge[1:]) + 1
        self.counts = np.diff(np.searchsorted(self.starts, offsets))
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)
        hashes, self.first, self.kind = np.unique(slice_hashes(self.data, self.starts, self.ends), return_index=True, return_inverse=True)
        self.hashes = hashes

    def texts(self, kinds: np.ndarray) -> pa.Array:
        """The distinct tokens of these numbers as strings."""
        starts = self.starts[self.first[kinds]]
        sizes = self.ends[self.first[kinds]] - starts
        ends = np.cumsum(sizes)
        flat = self.data[np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(kinds), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _count(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for _, part, ends in chunks(data, offsets, _CHUNK):
            tokens = Tokens(part, ends)
            many = np.bincount(tokens.kind, minlength=len(tokens.hashes))
            yield pa.RecordBatch.from_arrays([tokens.texts(np.arange(len(many))), pa.array(many)], ["token", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([batch.num_rows])], ["token", "n"])


def token_counts(texts: DataFrame) -> DataFrame:
    """``token, n`` over all texts (one column); the end of a text is the empty token."""
    return stage(texts.mapInArrow(_count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 0"), "token-counts")


@dataclass
class Counts:
    """Totals of the training tokens and the head of their table, most frequent first."""

    total: int
    distinct: int
    ends: int
    tokens: list[bytes]
    counts: np.ndarray
    words: int  # how many of ``tokens`` the model knows

    def __post_init__(self):
        self.sizes = np.array([len(token) for token in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.tokens) or b"\0", np.uint8)
        hashes = slice_hashes(self.data, self.starts, self.starts + self.sizes) if self.tokens else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.tokens = []
        known = int(self.counts[:self.words].sum()) + self.ends
        self.other_total = self.total - known
        self.other_distinct = self.distinct - self.words - (1 if self.ends else 0)
        self.base = np.log10((self.counts + 1) / (self.total + self.distinct + 1))
        self.base_end = math.log10((self.ends + 1) / (self.total + self.distinct + 1))
        self.share = np.log10((self.counts + 1) / (self.other_total + self.other_distinct + 1))
        self.share[:self.words] = 0

    def unigrams(self) -> np.ndarray:
        """Smoothed shares of the model's vocabulary."""
        many = np.concatenate([[self.other_total, self.ends], self.counts[:self.words]]) + 1.0
        return many / many.sum()

    def find(self, tokens: Tokens) -> np.ndarray:
        """Place of every distinct token in the head of the table, else -1."""
        out = np.full(len(tokens.hashes), -1, np.int64)
        if not len(self.sorted):
            return out
        low = np.searchsorted(self.sorted, tokens.hashes)
        low[low == len(self.sorted)] = 0
        at = np.flatnonzero(self.sorted[low] == tokens.hashes)
        place = self.order[low[at]]
        starts, ends = tokens.starts[tokens.first[at]], tokens.ends[tokens.first[at]]
        same = ends - starts == self.sizes[place]
        at, place, starts = at[same], place[same], starts[same]
        if len(at):
            sizes = self.sizes[place]
            first = np.cumsum(sizes) - sizes
            step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            equal = tokens.data[np.repeat(starts, sizes) + step] == self.data[np.repeat(self.starts[place], sizes) + step]
            same = np.logical_and.reduceat(equal, first)
            out[at[same]] = place[same]
        return out


def head_of(counts: DataFrame, words: int = WORDS, frequent: int = FREQUENT) -> Counts:
    """Totals and the head of a table of counts: all tokens from the lowest level of counts at which they fit ``frequent``."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = (counts.where("token = ''").agg(F.sum("n")).first()[0]) or 0
    short = counts.where((F.col("token") != "") & (F.octet_length("token") <= LONGEST)).withColumn("level", F.floor(F.log2("n") * 8))
    lowest, held = None, 0
    for row in sorted(short.groupBy("level").count().collect(), reverse=True):  # eight levels a doubling
        held += row["count"]
        if held > frequent:
            break
        lowest = row["level"]
    if lowest is None:
        return Counts(total, distinct, ends, [], np.zeros(0, np.int64), 0)
    table = short.where(F.col("level") >= lowest).select(F.col("token").cast("binary").alias("token"), "n").toArrow()
    head = sorted(zip(table.column("n").to_pylist(), table.column("token").to_pylist()), key=lambda pair: (-pair[0], pair[1]))
    return Counts(total, distinct, ends, [token for _, token in head], np.array([n for n, _ in head], np.int64), min(words, len(head)))


ENCODED = "ids array<smallint>, n_tokens long, n_known long, base double, share double, rare array<string>, rare_n array<int>"


def _encoder(counts, keep: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(keep))
            for first, part, ends in chunks(data, offsets, _CHUNK):
                yield pa.RecordBatch.from_arrays([*[c.slice(first, len(ends) - 1) for c in batch.columns[:keep]], *_encode(counts.value, Tokens(part, ends))],
                                                 [str(k) for k in range(keep + 7)])

    return run


def _encode(counts: Counts, tokens: Tokens) -> list[pa.Array]:
    rows = len(tokens.counts)
    found = counts.find(tokens)
    place = found[tokens.kind]
    seen = place >= 0
    base = np.bincount(tokens.row[seen], counts.base[place[seen]], rows) + counts.base_end
    share = np.bincount(tokens.row[seen], counts.share[place[seen]], rows).astype(np.float64)  # whole numbers where there is nothing to add
    known = np.bincount(tokens.row[seen], minlength=rows) + (1 if counts.ends else 0)
    cut = np.concatenate([[0], np.cumsum(tokens.counts + 1)])
    ids = np.full(cut[-1], END, np.int16)
    inner = np.ones(cut[-1], bool)
    inner[cut[1:] - 1] = False
    ids[inner] = np.where(seen & (place < counts.words), place + 2, OTHER)
    key, many = np.unique(tokens.row[~seen] * (1 << 32) + tokens.kind[~seen], return_counts=True)
    rare_cut = pa.array(np.searchsorted(key >> 32, np.arange(rows + 1)).astype(np.int32))
    return [
        pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)), pa.array(tokens.counts + 1), pa.array(known), pa.array(base), pa.array(share),
        pa.ListArray.from_arrays(rare_cut, tokens.texts(key & 0xFFFFFFFF)), pa.ListArray.from_arrays(rare_cut, pa.array(many.astype(np.int32))),
    ]


class Model:
    """Weights of the log-bilinear model; ``r`` and ``q`` have one row a vocabulary entry, ``c`` one a place before the token."""

    NAMES = ("r", "q", "c", "b")

    def __init__(self, unigrams: np.ndarray, dims: int = DIMS):
        draw = np.random.default_rng(11)
        size = len(unigrams)
        self.log_noise = np.log(unigrams).astype(np.float32)
        self.cumulated = np.cumsum(unigrams)
        self.r = draw.normal(0, 0.1, (size, dims)).astype(np.float32)
        self.q = draw.normal(0, 0.1, (size, dims)).astype(np.float32)
        self.c = np.ones((2, dims), np.float32)
        self.b = self.log_noise.copy()
        self.steps = [np.full_like(getattr(self, name), 0.1) for name in self.NAMES]  # sums of squared gradients

    def parts(self) -> list[np.ndarray]:
        return [*(getattr(self, name) for name in self.NAMES), *self.steps]

    def flat(self) -> np.ndarray:
        return np.concatenate([part.reshape(-1) for part in self.parts()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for part in self.parts():
            part[...] = flat[at:at + part.size].reshape(part.shape)
            at += part.size

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.q[one] * self.c[0] + self.q[two] * self.c[1]

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray, draw: np.random.Generator) -> None:
        """One AdaGrad step of noise-contrastive estimation on a minibatch, with noise words shared by all of it."""
        rate = np.float32(RATE)
        noise = np.minimum(np.searchsorted(self.cumulated, draw.random(NOISE), "right"), len(self.b) - 1)
        h, r_t, r_x = self.hidden(one, two), self.r[target], self.r[noise]
        level = np.float32(math.log(NOISE))
        g_t = _sigmoid(self.log_noise[target] + level - np.einsum("ij,ij->i", h, r_t) - self.b[target])
        g_x = -_sigmoid(h @ r_x.T + (self.b[noise] - self.log_noise[noise] - level))
        g_h = g_t[:, None] * r_t + g_x @ r_x
        place, grad, grad_b = _summed(np.concatenate([target, noise]), np.concatenate([g_t[:, None] * h, g_x.T @ h]), np.concatenate([g_t, g_x.sum(axis=0)]))
        before, grad_q, _ = _summed(np.concatenate([one, two]), np.concatenate([g_h * self.c[0], g_h * self.c[1]]), None)
        grad_c = np.stack([np.einsum("ij,ij->j", g_h, self.q[one]), np.einsum("ij,ij->j", g_h, self.q[two])])
        scale = np.float32(1 / len(target) ** 0.5)  # sums over a minibatch; rare words keep their whole gradient
        for name, step, rows, each in zip(self.NAMES, self.steps, (place, before, slice(None), place), (grad, grad_q, grad_c * scale, grad_b)):
            step[rows] += each * each
            getattr(self, name)[rows] += rate * each / np.sqrt(step[rows])

    def train(self, ids: np.ndarray, cut: np.ndarray, draw: np.random.Generator, minibatch: int = MINIBATCH) -> None:
        """One pass over texts that stand one behind the other."""
        one, two = contexts(ids, cut)
        for at in range(0, len(ids), minibatch):
            part = slice(at, at + minibatch)
            self.step(ids[part], one[part], two[part], draw)

    def log10_probabilities(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each target after its two tokens."""
        key, turn = np.unique(one * len(self.b) + two, return_inverse=True)
        norm = np.empty(len(key), np.float32)
        columns = np.ascontiguousarray(self.r.T)
        for at in range(0, len(key), _CONTEXTS):
            part = key[at:at + _CONTEXTS]
            score = self.hidden(part // len(self.b), part % len(self.b)) @ columns
            score += self.b
            top = score.max(axis=1)
            score -= top[:, None]
            np.exp(score, out=score)
            norm[at:at + _CONTEXTS] = np.log(score.sum(axis=1)) + top
        own = np.einsum("ij,ij->i", self.hidden(one, two), self.r[target]) + self.b[target]
        return (own.astype(np.float64) - norm[turn]) / math.log(10)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(key: np.ndarray, rows: np.ndarray, single):
    """Sums of the rows (and single values) of equal keys."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(rows[order], first, axis=0), None if single is None else np.add.reduceat(single[order], first)


def contexts(ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token and the one before that; before a text stands its end."""
    out = []
    for back in (1, 2):
        before = np.full(len(ids), END, np.int64)
        before[back:] = ids[:-back]
        place = np.arange(len(ids)) - np.repeat(cut[:-1], np.diff(cut))
        before[place < back] = END
        out.append(before)
    return out[0], out[1]


def _id_lists(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    cut = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(cut[0], cut[-1] - cut[0]).to_numpy().astype(np.int64), cut - cut[0]


def _trainer(model, turn: int):
    def run(batches):
        mine, seen, at = None, 0, 0
        for batch in batches:
            ids, cut = _id_lists(batch.column(0))
            if mine is None:
                mine = Model(model.value[0], model.value[1])
                mine.load(model.value[2])
            mine.train(ids, cut, np.random.default_rng([turn, at, len(ids)]))
            seen, at = seen + len(ids), at + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([(mine.flat() * seen).tobytes()], pa.binary())], ["seen", "flat"])

    return run


def _merge(batches):
    total, seen = None, 0
    for batch in batches:
        for many, flat in zip(batch.column(0), batch.column(1)):
            values = np.frombuffer(flat.as_buffer(), np.float64)
            total, seen = (values if total is None else total + values), seen + many.as_py()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total.tobytes()], pa.binary())], ["seen", "flat"])


def train(encoded: DataFrame, counts: Counts, rounds: int = ROUNDS, dims: int = DIMS) -> Model:
    """The model after all texts of ``encoded`` (columns ``ids``, ``turn`` below ``rounds``) were seen once."""
    model, context = Model(counts.unigrams(), dims), encoded.sparkSession.sparkContext
    for turn in range(rounds):
        start = context.broadcast((counts.unigrams(), dims, model.flat()))
        part = encoded.where(F.col("turn") == turn).select("ids").mapInArrow(_trainer(start, turn), "seen long, flat binary")
        merged = stage(part, "weights").repartition(MERGERS).mapInArrow(_merge, "seen long, flat binary").collect()  # one row a merger
        if merged:
            model.load(sum(np.frombuffer(row["flat"], np.float64) for row in merged) / sum(row["seen"] for row in merged))
    return model


def _scorer(model, keep: int):
    def run(batches):
        for batch in batches:
            mine = Model(model.value[0], model.value[1])
            mine.load(model.value[2])
            ids, cut = _id_lists(batch.column(keep))
            one, two = contexts(ids, cut)
            row, total = np.repeat(np.arange(len(cut) - 1), np.diff(cut)), np.zeros(len(cut) - 1)
            for at in range(0, len(ids), _POSITIONS):
                part = slice(at, at + _POSITIONS)
                total += np.bincount(row[part], mine.log10_probabilities(ids[part], one[part], two[part]), len(total))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(total)], [str(k) for k in range(keep + 1)])

    return run


def crc_rest(column: Column, modulus: int) -> Column:
    """crc32 of an id's text, modulo."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, dims: int = DIMS,
           rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document; those where ``held_out`` is false are learnt from."""
    spark = docs.sparkSession
    short_batches(spark)
    text = F.col(f"`{text_col}`").cast("string")
    counts_table = token_counts(docs.where(~held_out).select(text.alias("text")))
    counts = head_of(counts_table, words, frequent)
    head = spark.sparkContext.broadcast(counts)
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), held_out.alias("held_out"), text.alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    encoded = picked.mapInArrow(_encoder(head, 2), f"id {kind}, held_out boolean, {ENCODED}").withColumn("row", F.monotonically_increasing_id())
    encoded = stage(encoded.withColumn("turn", F.pmod(F.xxhash64("row"), F.lit(rounds)).cast("int")), "encoded")
    model = train(encoded.where("NOT held_out"), counts, rounds, dims)
    weights = spark.sparkContext.broadcast((counts.unigrams(), dims, model.flat()))
    own = encoded.select("row", "id", "held_out", "n_tokens", "n_known", "base", "share", "ids").mapInArrow(
        _scorer(weights, 7), f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, share double, score double")
    rare = encoded.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("each")).select(
        "row", F.col("each.rare").alias("token"), F.col("each.rare_n").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0)) + 1
    joined = rare.join(counts_table, "token", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(c / F.lit(counts.total + counts.distinct + 1))).alias("rare_base"),
        F.sum(F.col("times") * F.log10(c / F.lit(counts.other_total + counts.other_distinct + 1))).alias("rare_share"))
    nothing = lambda name: F.coalesce(F.col(name), F.lit(0))
    return own.join(joined, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + nothing("rare_known")).cast("long").alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + nothing("rare_base")).alias("base_score"), (F.col("score") + F.col("share") + nothing("rare_share")).alias("score"))


def op11_log_bilinear(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the log-bilinear model and under smoothed token counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, crc_rest(F.col("doc_id"), 7) == 2).withColumnRenamed("id", "doc_id")
