"""Token ids as a compact file: static range asymmetric numeral coding in independent, interleaved blocks.

A file is a folder of two Parquet tables. ``table`` holds the shared frequencies, scaled so that they sum to a
power of two. ``blocks`` holds one row per block: whole documents in rising id order, coded by ``LANES``
interleaved coders. A block carries its coders' states at the start and at every checkpoint, the words each
run between checkpoints reads, and a checksum, so blocks, and runs inside a block, decode on their own.

Steps: tokens are written once (staged), counted by id, range-partitioned by document, and coded. The tokenizer
runs over words between spaces and line feeds, which it never joins, so each distinct word is encoded once per chunk
of texts, and seldom twice while it stays in the cache of its worker.

Defined cases: a null or empty text holds only the end id; ids equal in rising order (null first) are ordered by
the hash of their ids; repeated rows are all written; other columns are not read; an empty table writes an
empty file that reads back as no rows; a damaged block raises.
"""

from __future__ import annotations

import math
import os
import re
import uuid
import zlib
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.batches import byte_characters, chunks, short_batches, slices, text_bytes
from sessionlake.plans.joins import broadcast_if_small
from sessionlake.plans.staging import shared_folder, stage

CACHE_ENTRIES = 60_000
CACHE_CHARACTERS = 64  # longer ones seldom come again and would make the cache large
CHUNK_TEXT = 4_000_000
LANES = 1024
BLOCK_IDS = 1 << 18
CHECKPOINT_STEPS = 128
SEGMENT_BYTES = 32_000_000
LOW = np.uint64(1 << 31)
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = r"!-&(-/:;=-@\[-`{-~"  # of ASCII all but ' and <, which begin contractions and special tokens
_LATIN_WORD = f"^(?P<word>[{_LATIN}]+)(?P<stops>[{_SIGNS}]*)$"
_PLAIN = re.compile(f"[{_LATIN}0-9{_SIGNS}]+").fullmatch
_PIECES = re.compile(f"[{_LATIN}]+|[0-9]|[{_SIGNS}]+").findall


class Tokens:
    """Ids of texts under one tokenizer file; keeps the ids of recent pieces.

    The distinct units (between spaces) of a chunk of texts are found first, and each is encoded once. A byte-level
    tokenizer that lower-cases, drops spaces and splits letters, digits and signs (probed once) gives the pieces of
    Latin units straight to its merge model; every other unit runs through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.code = {"<u2": "H", "<u4": "I"}[self.kind]
        self.characters = {byte: character for byte, character in enumerate(byte_characters()) if byte != 10}
        self.kept: dict[str, bytes] = {}
        self.kept_before: dict[str, bytes] = {}
        probes = ["The", "a\n b  c", "Winter, Snow.", "qzXv..,", "ÉtÀgères?! Straße", "antidisestablishment",
                  "a1b22--C3_d (x)[y]{z}|~`^ \"Q\"*** $5.00 4f/b\\c &#%@+=>;"]
        self.plain = not any(_PLAIN(token.content) for token in self.tokenizer.get_added_tokens_decoder().values())
        self.plain = self.plain and all(self._whole([probe]) == [b"".join(self._units(probe.split()))] for probe in probes)

    def _whole(self, units: list[str]) -> list[bytes]:
        return [array(self.code, self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes() for unit in units]

    def _model(self, pieces: list[str]) -> list[bytes]:
        """The merge model reads a character for each byte."""
        tokenize = self.tokenizer.model.tokenize
        mapped = "\n".join(pieces).encode().decode("latin-1").translate(self.characters).split("\n") if pieces else []
        return [array(self.code, [token.id for token in tokenize(piece)]).tobytes() for piece in mapped]

    def _recent(self, keys: list[str], counts, compute) -> list[bytes]:
        """Ids of distinct keys. Only short ones that come more than once are kept: most others never come again."""
        out = [self.kept.get(key) for key in keys]
        for at, ids in enumerate(out):
            if ids is None and (ids := self.kept_before.get(keys[at])) is not None:
                out[at] = self._keep(keys[at], ids)
        new = [at for at, ids in enumerate(out) if ids is None]
        for at, ids in zip(new, compute([keys[at] for at in new])):
            out[at] = self._keep(keys[at], ids) if counts[at] > 1 and len(keys[at]) <= CACHE_CHARACTERS else ids
        return out

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(self.kept) >= CACHE_ENTRIES:
            self.kept, self.kept_before = {}, self.kept
        self.kept[key] = ids
        return ids

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of units that are not one Latin word with signs behind it."""
        cut = [_PIECES(unit.lower()) if self.plain and _PLAIN(unit) else None for unit in units]
        whole = iter(self._whole([unit for unit, pieces in zip(units, cut) if pieces is None]))
        distinct = Counter(chain.from_iterable(pieces for pieces in cut if pieces))
        ids = dict(zip(distinct, self._recent(list(distinct), list(distinct.values()), self._model)))
        return [next(whole) if pieces is None else b"".join(map(ids.__getitem__, pieces)) for pieces in cut]

    def _distinct(self, units: pa.Array, counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of the pieces of ``units``, and the two pieces that each unit is made of (the first one is empty)."""
        out, of = [b""], np.zeros((len(units), 2), np.int64)
        rest = np.ones(len(units), bool)
        if self.plain:
            word, stops = pc.extract_regex(units, _LATIN_WORD).flatten()
            rest = word.is_null().to_numpy(zero_copy_only=False)
            for side, column in enumerate((pc.utf8_lower(word), stops)):
                column = column.drop_null().dictionary_encode()
                at = column.indices.to_numpy()
                of[~rest, side] = at + len(out)
                often = np.bincount(at, counts[~rest], len(column.dictionary))
                out += self._recent(column.dictionary.to_numpy(zero_copy_only=False).tolist(), often, self._model)
        of[rest, 0] = np.arange(rest.sum()) + len(out)
        others = units.filter(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()
        return out + self._recent(others, counts[rest], self._units), of

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and how many each has; null counts as empty."""
        units = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        found = units.flatten().dictionary_encode()
        at = found.indices.to_numpy()
        pieces, of = self._distinct(found.dictionary, np.bincount(at, minlength=len(found.dictionary)))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // np.dtype(self.kind).itemsize
        ids, ends = gather(np.frombuffer(b"".join(pieces), self.kind), size, of.reshape(-1))
        ids, ends = gather(ids, np.diff(ends[::2]), at)
        last = np.cumsum(pc.list_value_length(units).to_numpy())
        return ids, np.diff(ends[last], prepend=0)


def gather(values: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ``values`` (of ``size`` each) in ``order``, and where each begins there and the last one ends."""
    first = (np.cumsum(size) - size)[order]
    size = size[order]
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends


def id_type(vocabulary: int) -> str:
    """The narrowest little-endian unsigned type for ids below ``vocabulary``."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    """One tokenizer per worker process."""
    return Tokens(path)


def _joined(batches, limit: int):
    """Runs of whole batches of about ``limit`` bytes as one batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id (as ``id``) and its token ids with ``end_id`` at the end (as ``ids``, narrow binary)."""

    def run(batches):
        own = tokens_of(path)
        end = np.array(end_id, own.kind)
        for batch in _joined(batches, CHUNK_TEXT):
            for first, _, offsets in chunks(*text_bytes(batch.column(1)), CHUNK_TEXT):
                part = batch.slice(first, len(offsets) - 1)
                ids, counts = own.encode(part.column(1))
                ids = np.insert(ids, np.cumsum(counts), end)
                ends = np.concatenate([[0], np.cumsum(counts + 1) * ids.itemsize]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), column], ["id", "ids"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    short_batches(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], T.StructField("ids", T.BinaryType())]))


def frequencies(tokens: DataFrame, kind: str, size: int) -> np.ndarray:
    """How often each id below ``size`` occurs; counted in tasks, one row per id and task shuffled."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_numpy(zero_copy_only=False)), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[counts["id"].to_numpy()] = counts["n"].to_numpy()
    return out


def scaled(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies that sum to ``1 << bits``; every id that occurs keeps at least one."""
    used = np.flatnonzero(counts)
    bits = min(22, max(12, int(len(used)).bit_length() + 2))
    if len(used) > 1 << bits:
        raise ValueError(f"{len(used)} different ids; at most {1 << bits} can be coded")
    out = np.zeros(len(counts), np.int64)
    if not len(used):
        return out, bits
    share = counts[used].astype(object) * (1 << bits) // int(counts.sum())
    out[used] = np.maximum(1, share.astype(np.int64))
    over = int(out.sum()) - (1 << bits)
    for at in used[np.argsort(-out[used], kind="stable")]:
        if over <= 0:
            out[at] -= over
            break
        less = min(over, int(out[at]) - 1)
        out[at] -= less
        over -= less
        if not over:
            break
    return out, bits


class Coder:
    """Interleaved static range coder over one frequency table."""

    def __init__(self, ids: np.ndarray, frequency: np.ndarray, bits: int):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.ids = ids.astype(np.int64)
        self.frequency = frequency.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(frequency)[:-1]]).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
        self.symbol = np.repeat(np.arange(len(ids)), frequency)
        self.of_id = np.full(int(ids.max()) + 1 if len(ids) else 0, -1)
        self.of_id[self.ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, list[int]]:
        """Words, states at every checkpoint (the first is the start), words read before each checkpoint."""
        symbols = self.of_id[ids]
        steps = math.ceil(len(ids) / LANES)
        padded = np.full(steps * LANES, symbols[-1] if len(ids) else 0)
        padded[:len(ids)] = symbols
        frequency = self.frequency[padded].reshape(steps, LANES)
        start = self.start[padded].reshape(steps, LANES)
        limit = np.uint64((1 << 31) >> int(self.bits) << 32)
        state = np.full(LANES, LOW)
        words = np.zeros((steps, LANES), np.uint32)
        sent = np.zeros((steps, LANES), bool)
        kept: list[np.ndarray] = []
        for step in range(steps - 1, -1, -1):
            f = frequency[step]
            full = state >= f * limit
            sent[step] = full
            words[step] = state  # the low half
            state = np.where(full, state >> np.uint64(32), state)
            whole = state // f
            state = (whole << self.bits) + (state - whole * f) + start[step]
            if step % CHECKPOINT_STEPS == 0:
                kept.append(state)
        per_step = np.concatenate([[0], np.cumsum(sent.sum(axis=1))])
        return words[sent].astype("<u4").tobytes(), b"".join(s.astype("<u8").tobytes() for s in kept[::-1]), per_step[:steps:CHECKPOINT_STEPS].tolist()

    def decode_run(self, words: np.ndarray, state: np.ndarray, steps: int) -> np.ndarray:
        """Ids of ``steps`` steps from a checkpoint's state and the words from there on."""
        out = np.empty((steps, LANES), np.int64)
        state, at = state.astype(np.uint64), 0
        for step in range(steps):
            slot = state & self.mask
            symbol = self.symbol[slot]
            out[step] = symbol
            state = self.frequency[symbol] * (state >> self.bits) + slot - self.start[symbol]
            low = np.flatnonzero(state < LOW)
            state[low] = (state[low] << np.uint64(32)) | words[at:at + len(low)]
            at += len(low)
        return self.ids[out.reshape(-1)]

    def decode(self, words: bytes, states: bytes, offsets: list[int], count: int) -> np.ndarray:
        """All ids of a block, one run between checkpoints after another."""
        words, states = np.frombuffer(words, "<u4").astype(np.uint64), np.frombuffer(states, "<u8").reshape(-1, LANES)
        steps = math.ceil(count / LANES)
        runs = [self.decode_run(words[first:], states[k], min(CHECKPOINT_STEPS, steps - k * CHECKPOINT_STEPS))
                for k, first in enumerate(offsets)]
        return np.concatenate(runs)[:count] if runs else np.zeros(0, np.int64)


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _blocks_schema(id_type_: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("segment", T.LongType()),
        T.StructField("first", T.LongType()),  # ids of the segment before this block
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type_)),
        T.StructField("n_tokens", T.ArrayType(T.LongType())),
        T.StructField("words", T.BinaryType()),
        T.StructField("states", T.BinaryType()),
        T.StructField("offsets", T.ArrayType(T.LongType())),
        T.StructField("crc32", T.LongType()),
    ])


def _block_writer(shared, kind: str):
    def run(batches):
        coder, segment, first = Coder(*shared.value), TaskContext.get().partitionId(), 0
        docs, parts, held = [], [], 0
        id_kind = None

        def block():
            ids = np.concatenate([np.frombuffer(part, kind) for part in parts]).astype(np.int64)
            words, states, offsets = coder.encode(ids)
            row = [segment, first, len(ids), docs, [len(part) // np.dtype(kind).itemsize for part in parts], words, states, offsets, checksum(ids)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(id_kind), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([value], type_) for value, type_ in zip(row, types)], [str(k) for k in range(len(row))])

        for batch in slices(batches):
            id_kind = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // np.dtype(kind).itemsize
                if held >= BLOCK_IDS:
                    yield block()
                    first += held
                    docs, parts, held = [], [], 0
        if parts:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise ``docs`` and write their ids below ``path`` in rising order of ``id_col``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = id_type(size)
    tokens = stage(tokenize(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    counts, bits = scaled(frequencies(tokens, kind, size))
    used = np.flatnonzero(counts)
    table = pa.table({"id": used, "frequency": counts[used], "bits": np.full(len(used), bits)})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((used, counts[used], bits))
    total = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    ordered = tokens.repartitionByRange(math.ceil(total / SEGMENT_BYTES) or 1, F.col("id"), F.xxhash64("ids")).sortWithinPartitions("id", F.xxhash64("ids"))
    ordered.mapInArrow(_block_writer(shared, kind), _blocks_schema(tokens.schema["id"].dataType)).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document of the file: ``id``, ``start``, ``n_tokens`` and its ids (or only their CRC-32, with ``digest``)."""
    table = spark.read.parquet(f"{path}/table").orderBy("id").toArrow()  # as many rows as the vocabulary has at most
    bits = table["bits"][0].as_py() if table.num_rows else 12
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(), table["frequency"].to_numpy(), bits))
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches):
        coder = Coder(*shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                segment, first, count, docs, lengths, words, states, offsets, crc = (column[at].as_py() for column in batch.columns)
                ids = coder.decode(words, states, offsets, count)
                if checksum(ids) != crc:
                    raise ValueError(f"damaged block at {first} of segment {segment}")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                if digest:
                    last = pa.array([checksum(ids[s:e]) for s, e in zip(starts, ends)], pa.int64())
                else:
                    last = pa.array([ids[s:e].astype("<u4").tobytes() for s, e in zip(starts, ends)], pa.binary())
                columns = [pa.array(docs, batch.column(3).type.value_type), pa.array(np.full(len(docs), segment)), pa.array(first + starts), pa.array(lengths, pa.int64()), last]
                yield pa.RecordBatch.from_arrays(columns, ["id", "segment", "within", "n_tokens", "last"])

    id_kind = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_kind), T.StructField("segment", T.LongType()), T.StructField("within", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("last", T.LongType() if digest else T.BinaryType())])
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # one row per segment of SEGMENT_BYTES
    segments = blocks.groupBy("segment").agg(F.sum("n_ids").alias("n")).select("segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.mapInArrow(run, schema).join(broadcast_if_small(segments), "segment").select(
        "id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def op5_token_file(spark, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to a file, read it back, and describe each document's ids."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/token-file-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_ids(spark, path, digest=True).withColumnRenamed("id", "doc_id")
