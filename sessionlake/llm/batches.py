"""Text of an Arrow batch as bytes, its words, and rolling hashes over them, all vectorised."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def free_name(taken, base: str) -> str:
    """``base``, lengthened until no column of ``taken`` has that name in any case."""
    lower = {name.lower() for name in taken}
    while base.lower() in lower:
        base += "_"
    return base


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible in Latin-1, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in visible else spare))
        spare += byte not in visible
    return out


class Recent(dict):
    """Values of recent keys, computed when first asked for; holds ``limit`` keys and those of the round before."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.before = compute, limit, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


def short_batches(spark, rows: int = BATCH_ROWS) -> None:
    """Let no Arrow batch of this session hold more than ``rows`` rows, as texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slices(batches, rows: int = 1_000):
    """The batches in slices of ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of every row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of runs of whole rows of about ``limit`` bytes; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _kept_powers(size) if size <= 4 * CHUNK_BYTES else _kept_powers.__wrapped__(size)


@lru_cache(maxsize=2)
def _kept_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE)
    down = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h ^= h >> np.uint64(29)
    h *= _BASE
    return h ^ (h >> np.uint64(32))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice of bytes; equal slices have equal hashes wherever they stand."""
    size = CHUNK_BYTES
    while size < len(data) + 1:
        size *= 2
    up, down = _powers(size)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


class Words:
    """Words of a chunk of rows: maximal runs of ASCII digits and letters and of all other characters
    beyond ASCII, with A-Z lower-cased. Words never cross rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        inside = _IS_WORD[self.data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each row, and the end
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hashes = slice_hashes(self.data, self.starts, self.ends)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``length`` words inside one row, and the windows' hashes."""
        total = len(self.starts) - length + 1
        if total <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(total, np.uint64)
        for at in range(length):
            h *= _STEP
            h += self.hashes[at:at + total]
        inside = np.flatnonzero(self.row[:total] == self.row[length - 1:])
        return inside, mix(h[inside])

    def joined(self, first: int, length: int) -> bytes:
        """The words of one window with single spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[first:first + length], self.ends[first:first + length]))
