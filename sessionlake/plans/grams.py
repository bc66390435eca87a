"""Grams of fixed length over whole texts, in one linear pass each.

A gram is a run of 8, 4, 2 or 1 bytes of the UTF-8 form, written as an integer. A text of any length is cut into its
grams by a few additions over the whole buffer, so the cost follows its bytes and not the length of its pieces. A needle
that stands in a text brings all its grams along; one of them, the rarest, is enough to find the texts worth a look.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZES = (8, 4, 2, 1)
COUNT_BITS = 16
FILTER_BITS = 20
_RUN_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_size(needle: bytes) -> int:
    """The longest gram that fits the needle; 0 for an empty one."""
    return next((size for size in SIZES if len(needle) >= size), 0)


def codes(data: np.ndarray, size: int) -> np.ndarray:
    """The gram that begins at each byte, as far as there are bytes left for it."""
    many = max(0, len(data) - size + 1)
    out = np.zeros(many, np.uint64)
    for at in range(size):
        out |= data[at:at + many].astype(np.uint64) << np.uint64(8 * at)
    return out


def spread(code: np.ndarray, bits: int) -> np.ndarray:
    """A hash of each gram of this many bits."""
    mixed = (code ^ (code >> np.uint64(29))) * _STEP
    return ((mixed ^ (mixed >> np.uint64(32))) * _STEP >> np.uint64(64 - bits)).astype(np.int64)


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of about a MB; a longer row stands alone, null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, raw = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _RUN_BYTES, "right")) - 1)
        yield first, raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def inside(offsets: np.ndarray, size: int, many: int) -> np.ndarray:
    """Which grams do not cross from one row into the next."""
    keep = np.ones(many, bool)
    for back in range(1, size):
        border = offsets[1:-1] - back
        keep[border[(border >= 0) & (border < many)]] = False
    return keep


def count_grams(sizes: list[int]):
    """Per hash of a gram, how many places of all texts (column 0) have it: rows ``size, bucket, n``."""

    def run(batches):
        total = {size: np.zeros(1 << COUNT_BITS, np.int64) for size in sizes}
        for batch in batches:
            for _, data, offsets in runs(batch.column(0)):
                for size in sizes:
                    code = codes(data, size)
                    total[size] += np.bincount(spread(code[inside(offsets, size, len(code))], COUNT_BITS), minlength=1 << COUNT_BITS)
        for size, many in total.items():
            some = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(some), pa.array(many[some])], ["size", "bucket", "n"])

    return run


def anchor(counts):
    """For each needle (column 1) its rarest gram: rows ``token, needle, size, code``; a needle with a gram that no text has goes."""

    def run(batches):
        for batch in batches:
            rows, sizes, found = [], [], []
            for row, needle in enumerate(batch.column(1).to_pylist()):
                raw = needle.encode()
                size = gram_size(raw)
                if size:
                    code = codes(np.frombuffer(raw, np.uint8), size)
                    many = counts.value[size][spread(code, COUNT_BITS)]
                    if many.min() > 0:
                        rows.append(row)
                        sizes.append(size)
                        found.append(code[many.argmin()])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes, pa.int32()), pa.array(np.array(found, np.uint64).view(np.int64))],
                ["token", "needle", "size", "code"])

    return run


def find_grams(filters):
    """Rows ``id, size, code``: for each text (column 1) the distinct grams that pass the filter of their size."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in runs(batch.column(1)):
                for size, passes in filters.value.items():
                    code = codes(data, size)
                    at = np.flatnonzero(inside(offsets, size, len(code)) & passes[spread(code, FILTER_BITS)])
                    pairs = np.unique(np.stack([(np.searchsorted(offsets, at, "right") - 1).astype(np.uint64), code[at]], axis=1), axis=0)
                    row = pa.array(first + pairs[:, 0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), pa.array(np.full(len(pairs), size, np.int32)), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))],
                        ["id", "size", "code"])

    return run


SKETCH_SIZE = 4
SKETCH_GRAMS = 65_536
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sampled(data: np.ndarray) -> np.ndarray:
    """Hashes of half of all distinct grams, the same half wherever a gram stands; A-Z lower-cased."""
    hashes = np.unique(spread(codes(_LOWER[data], SKETCH_SIZE), 32))
    return hashes[hashes & 1 == 0] >> 1


def _bits(hashes: np.ndarray) -> bytes:
    """A filter with two to four bits for each of the hashes."""
    size = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    held = np.zeros(size, bool)
    held[hashes & (size - 1)] = True
    return np.packbits(held).tobytes()


def sketch(batches):
    """Rows ``path, bits`` from rows ``path, texts`` that are sorted by path.

    The texts of a row go into one filter; a path with very many grams has several, so no filter fills up.
    """
    path, held, many = None, [], 0
    for batch in batches:
        lists = batch.column(1)
        for row, name in enumerate(batch.column(0).to_pylist()):
            if path is not None and (name != path or many > SKETCH_GRAMS):
                yield _sketched(path, held)
                held, many = [], 0
            path = name
            for text in lists[row]:
                if text.is_valid:
                    found = _sampled(np.frombuffer(text.as_buffer(), np.uint8))
                    held.append(found)
                    many += len(found)
            if len(held) > 256:
                held = [np.unique(np.concatenate(held))]
                many = len(held[0])
    if path is not None:
        yield _sketched(path, held)


def _sketched(path: str, held: list[np.ndarray]) -> pa.RecordBatch:
    bits = _bits(np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([bits], pa.binary())], ["path", "bits"])


def may_hold(pattern: bytes):
    """Rows ``path`` of the filters (rows ``path, bits``) that do not rule the pattern out; None if the pattern has no sampled gram."""
    wanted = _sampled(np.frombuffer(pattern, np.uint8)) if len(pattern) >= SKETCH_SIZE else np.zeros(0, np.int64)
    if not len(wanted):
        return None

    def run(batches):
        for batch in batches:
            keep = []
            for row, bits in enumerate(batch.column(1)):
                raw = np.frombuffer(bits.as_buffer(), np.uint8)
                at = wanted & (len(raw) * 8 - 1)
                if (raw[at >> 3] >> (7 - (at & 7)) & 1).all():
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64()))], ["path"])

    return run
