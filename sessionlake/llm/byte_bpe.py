"""Byte-level BPE encoding and decoding through a sentencepiece model written straight from a rank file.

Every vocabulary entry becomes one piece, its bytes mapped to printable characters, scored by its negative
rank, under identity normalisation; sentencepiece then merges the best-ranked pair first, leftmost on ties.
Texts are split by the tokenizer's pattern and each pre-token is encoded on its own. A pre-token that is a
vocabulary entry takes that id at once. Decoding maps ids back to their bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; the names of special tokens are
ordinary text; texts of any length are encoded whole; repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.batches import Recent, byte_characters, free_name, short_batches, slices

CACHE_ENTRIES = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 entry and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in lines if line.strip())}


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value) -> bytes:
    """A protocol buffer field: bytes, float or integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Its ids are positions in rank order; one unknown piece follows the vocabulary."""
    characters = byte_characters()
    size = len(ranks)
    pieces = [_field(1, _field(1, "".join(characters[b] for b in entry).encode()) + _field(2, -float(rank)) + _field(3, 1))
              for entry, rank in sorted(ranks.items(), key=lambda item: item[1])]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    minus_one = (1 << 64) - 1
    trainer = (_field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, minus_one) + _field(42, minus_one)
               + _field(43, minus_one))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder over one rank file; keeps the ids of recent pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        ordered = sorted(ranks.items(), key=lambda item: item[1])
        self.ids = np.array([rank for _, rank in ordered], "<u4")
        self.bytes_of = {rank: entry for entry, rank in ordered}
        self.whole = {}
        for entry, rank in ordered:
            try:
                self.whole[entry.decode()] = np.uint32(rank).tobytes()
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.characters = {byte: character for byte, character in enumerate(byte_characters())}
        self.split = regex.compile(pattern).findall
        self.recent = Recent(self._pre_token, CACHE_ENTRIES)

    def _pre_token(self, token: str) -> bytes:
        whole = self.whole.get(token)
        if whole is not None:
            return whole
        mapped = token.encode().decode("latin-1").translate(self.characters)
        return self.ids[self.model.encode(mapped, out_type=int)].tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.recent.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


def _encoder(path: str, pattern: str, text_at: int):
    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches):
            ids = [own.encode(text) if text else b"" for text in batch.column(text_at).to_pylist()]
            columns = [*batch.columns, pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    return run


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of every text as a binary of little-endian unsigned 32-bit integers, without a shuffle.

    The new column comes last; its name is lengthened where it clashes.
    """
    short_batches(docs.sparkSession)
    ids_col = free_name(docs.columns, ids_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.BinaryType())])
    return docs.mapInArrow(_encoder(path, pattern, docs.columns.index(text_col)), schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that the ids stand for, in a last column whose name is lengthened where it clashes."""
    bytes_col = free_name(encoded.columns, bytes_col)

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches):
            raw = [own.decode(ids) if ids else b"" for ids in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    at = encoded.columns.index(ids_col)
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns, the ids of every text and the bytes they decode to, in one pass."""

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches):
            ids = [own.encode(text) if text else b"" for text in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array(ids, pa.binary()), pa.array(list(map(own.decode, ids)), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = [free_name(docs.columns, name) for name in ("ids", "decoded")]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(name, T.BinaryType()) for name in names]]))


def digests(docs: DataFrame) -> DataFrame:
    """Per row of ``doc_id, text``: number of ids, hash of the ids, hash of the decoded bytes."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return round_trip(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token count, id digest and decoded digest of every whole document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
