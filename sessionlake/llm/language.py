"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to ``ORDER`` with counts from a bounded sample of labelled
texts; after training the counts are frozen. The code length of a byte is the one its longest known context
gives: -log2(c / (n + d)) if the byte followed that context, else the escape -log2(d / (n + d)) plus the code
length under the next shorter context (n: times the context was seen, d: different bytes after it; a context a
language has not seen costs nothing; below order 0 a byte costs 8 bits; no exclusions). The language with the
shortest code for the whole text wins, the smaller name on ties. The score is that language's share of
2 ** -length over all languages, each equally likely before.

The model is fitted on about ``rows_per_language`` rows of each language, drawn by a hash of the id, of at most
``max_row_bytes`` bytes each, so it does not grow with the corpus; prediction reads every byte of every text.
A language whose rows are all longer is fitted on its shortest ones, of as many bytes in all, one row at least.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing can be
learned; rows with a null id, text or language are not learned from; repeated rows count and are predicted
alike; other columns pass through; the two new columns come last, and their names are lengthened where they clash.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.batches import CHUNK_BYTES, chunks, free_name, short_batches, text_bytes

ORDER = 4
ROWS_PER_LANGUAGE = 400
MAX_ROW_BYTES = 50_000
UNDETERMINED = "und"
_PAD = 10  # the byte that stands before the first one of a text
_EMPTY = np.uint64((1 << 64) - 1)


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows one after another, each behind ORDER pad bytes; and the row of each byte (-1: padding)."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(data)) + ORDER * (row + 1)
    out = np.full(len(data) + ORDER * len(sizes), _PAD, np.uint8)
    owner = np.full(len(out), -1)
    out[at], owner[at] = data, row
    return out, owner


def _keys(padded: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each place from ``first`` (ORDER at least) to ``last``: the byte, above it the bytes before, nearest first."""
    key = padded[first:last].astype(np.uint64)
    for back in range(1, ORDER + 1):
        key |= padded[first - back:last - back].astype(np.uint64) << np.uint64(8 * back)
    return key


def _below(order: int) -> np.uint64:
    return np.uint64((1 << 8 * (order + 1)) - 1)


class Lookup:
    """Positions of distinct keys by open addressing, searched for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.key = np.full(1 << self.bits, _EMPTY)
        self.value = np.full(1 << self.bits, -1, np.int32)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.key[place] == _EMPTY
            _, chosen = np.unique(place[free], return_index=True)
            chosen = np.flatnonzero(free)[chosen]
            self.key[place[chosen]], self.value[place[chosen]] = keys[left[chosen]], left[chosen]
            rest = np.setdiff1d(np.arange(len(left)), chosen, assume_unique=True)
            left, place = left[rest], (place[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        place = self._place(keys)
        seen = self.key[place]
        out = np.where(seen == keys, self.value[place], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        place = place[open_]
        while len(open_):
            place = (place + 1) & ((1 << self.bits) - 1)
            seen = self.key[place]
            hit = seen == keys[open_]
            out[open_[hit]] = self.value[place[hit]]
            more = ~hit & (seen != _EMPTY)
            open_, place = open_[more], place[more]
        return out


class Model:
    """Frozen context trees of all languages. ``counts``: arrays lang (index), order, key, n."""

    def __init__(self, languages: list[str], lang: np.ndarray, order: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.languages = languages
        width = len(languages)
        self.grams: list[tuple[Lookup, np.ndarray]] = []
        self.escapes: list[tuple[Lookup, np.ndarray]] = []
        shorter = None
        for k in range(ORDER + 1):
            use = order == k
            keys, at = np.unique(key[use], return_inverse=True)
            count = np.zeros((len(keys), width))
            np.add.at(count, (at, lang[use]), n[use])
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, different = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, count)
            np.add.at(different, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(different / (total + different)), 0.0)
                seen = -np.log2(count / (total + different)[of])
            if shorter is None:
                lower = np.full((len(keys), width), 8.0)
            else:
                lower = shorter[1][np.searchsorted(shorter[0], keys & _below(k - 1))]
            cost = np.where(count > 0, seen, escape[of] + lower)
            self.grams.append((Lookup(keys), cost.astype(np.float32)))
            self.escapes.append((Lookup(contexts), escape.astype(np.float32)))
            shorter = (keys, cost)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each byte in each language."""
        lookup, table = self.grams[ORDER]
        found = lookup.find(keys)
        out = table[found]
        rest = np.flatnonzero(found < 0)
        out[rest] = 0
        for k in range(ORDER, -1, -1):
            if not len(rest):
                break
            own = keys[rest] & _below(k)
            if k < ORDER:
                lookup, table = self.grams[k]
                found = lookup.find(own)
                hit = found >= 0
                out[rest[hit]] += table[found[hit]]
                rest, own = rest[~hit], own[~hit]
            lookup, table = self.escapes[k]
            found = lookup.find(own >> np.uint64(8))
            known = found >= 0
            out[rest[known]] += table[found[known]]
        out[rest] += 8.0
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row in each language."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        padded, owner = _padded(data, offsets)
        step = max(1 << 14, (CHUNK_BYTES << 2) // max(4, len(self.languages)))
        for first in range(ORDER, len(padded), step):
            last = min(first + step, len(padded))
            row = owner[first:last]
            real = np.flatnonzero(row >= 0)
            if not len(real):
                continue
            row = row[real]
            cost = self.costs(_keys(padded, first, last)[real])
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            total[row[starts]] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return total


@lru_cache(maxsize=1)
def _letter():
    import regex

    return regex.compile(r"\p{L}")


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows have a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for row in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[row] = bool(_letter().search(data[offsets[row]:offsets[row + 1]].tobytes().decode("utf-8", "replace")))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_language: int = ROWS_PER_LANGUAGE, max_row_bytes: int = MAX_ROW_BYTES) -> Model | None:
    """A model of the languages of ``docs``; None if no row can be learned from."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    size = F.octet_length("text")
    found = rows.groupBy("lang").agg(F.count(F.when(size <= max_row_bytes, 1)), F.count(F.lit(1)), F.min(size)).collect()  # one row per language
    if not found:
        return None
    sizes = {lang: n for lang, n, _, _ in found if n}
    wanted = {lang: min(n, rows_per_language, max(1, rows_per_language * max_row_bytes // shortest)) / n for lang, short, n, shortest in found if not short}
    limit = size <= max_row_bytes
    if wanted:
        long = rows.where(F.col("lang").isin(*wanted))
        at = long.agg(*[F.percentile_approx(F.when(F.col("lang") == lang, size), part, 1_000_000) for lang, part in wanted.items()]).first()
        for lang, most in zip(wanted, at):
            limit = limit | ((F.col("lang") == lang) & (size <= most))
            sizes[lang] = 1  # all of them are learned from
    rows = rows.where(limit)
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / sizes[lang]))])
    drawn = F.pmod(F.xxhash64(F.lit(6), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(drawn < share[F.col("lang")]).select("text", "lang")
    index = {lang: at for at, lang in enumerate(languages)}

    def run(batches):
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            data, offsets = text_bytes(batch.column(0))
            for first, part, ends in chunks(data, offsets):
                padded, owner = _padded(part, ends)
                keys, owner = _keys(padded, ORDER, len(padded)), owner[ORDER:]
                keys, of = keys[owner >= 0], lang[first + owner[owner >= 0]]
                for k in range(ORDER + 1):
                    # The language stands above the five bytes of a key.
                    both, n = np.unique(of.astype(np.uint64) << np.uint64(40) | keys & _below(k), return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array((both >> np.uint64(40)).astype(np.int64)), pa.array(np.full(len(n), k)), pa.array((both & _below(ORDER)).astype(np.int64)), pa.array(n)],
                        ["lang", "order", "key", "n"])

    counted = sample.mapInArrow(run, "lang long, order long, key long, n long").groupBy("lang", "order", "key").agg(F.sum("n").alias("n")).toArrow()
    lang, order, key, n = (counted[name].to_numpy() for name in ("lang", "order", "key", "n"))
    return Model(languages, lang, order, key.astype(np.uint64), n)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language of every whole text and its score, without a shuffle."""
    short_batches(docs.sparkSession)
    pred_col, score_col = free_name(docs.columns, pred_col), free_name(docs.columns, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    at = docs.columns.index(text_col)

    def run(batches):
        own = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            names, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            for first, part, ends in chunks(data, offsets) if own else ():
                lengths, letters = own.lengths(part, ends), has_letter(part, ends)
                best = lengths.argmin(axis=1)
                low = lengths[np.arange(len(best)), best]
                share = 1 / np.exp2(np.maximum(low[:, None] - lengths, -1000)).sum(axis=1)
                for row in np.flatnonzero(letters).tolist():
                    names[first + row], scores[first + row] = own.languages[best[row]], share[row]
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """A third of all documents, by checksum of the id; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def keep_known(docs: DataFrame, min_score: float = 0.5, **columns) -> DataFrame:
    """The rows of ``docs`` whose language is known; rejected are texts without a letter and those below ``min_score``.

    If no language can be learned, every text with a letter stays.
    """
    learned = docs.where(~held_out(columns.get("id_col", "doc_id")))
    model = train(learned, **columns)
    text_col = columns.get("text_col", "text")
    if model is None:
        return docs.where(F.col(f"`{text_col}`").rlike(r"\p{L}"))
    told = predict(docs, model, text_col)
    language, share = (F.col(f"`{name}`") for name in told.columns[-2:])
    return told.where((language != UNDETERMINED) & (share >= min_score)).select(*[F.col(f"`{name}`") for name in docs.columns])


def op6_language(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
