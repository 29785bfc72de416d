"""Words, positions and hashes of whole Arrow batches of text, without a Python loop over words.

A batch's UTF-8 bytes are classified by a 256-entry table, so a word class must be one that
bytes decide: ASCII is in or out by character, everything from 0x80 on is inside words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
S32, S29 = np.uint64(32), np.uint64(29)
#: Bytes of text handled at once in a task; a longer text is handled alone.
SLICE = 1 << 20


@dataclass
class Slice:
    """Consecutive rows of a batch: their bytes and where each row's bytes begin."""

    first: int
    data: np.ndarray
    offsets: np.ndarray  # rows + 1, from 0

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    hash: np.ndarray   # uint64
    start: np.ndarray  # byte
    end: np.ndarray
    bounds: np.ndarray  # rows + 1: first word of each row

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.per_row)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    """Rows in runs of about ``limit`` bytes. A null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield Slice(at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S32)) * M2
    h = (h ^ (h >> S29)) * M3
    return h ^ (h >> S32)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, 0, (1,))
    size = end - start
    h = size.astype(np.uint64) * M1
    left, at, where = size, start, None
    while len(left):
        chunk = eight[at]
        short = left < 8
        keep = (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        chunk[short] &= keep
        if where is None:
            h = mix(h ^ chunk) * M1
        else:
            h[where] = mix(h[where] ^ chunk) * M1
        more = np.flatnonzero(left > 8)
        where = more if where is None else where[more]
        left, at = left[more] - 8, at[more] + 8
    return h


def words(part: Slice, inside: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes of the class ``inside``; runs end where a row ends."""
    data = LOWER[part.data] if lower else part.data
    n = len(data)
    mask = np.zeros(n + 2, bool)
    mask[1:-1] = inside[part.data]
    starts = mask[1:] & ~mask[:-1]   # by byte, one extra
    ends = mask[:-1] & ~mask[1:]     # a word ends before this byte
    cut = part.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    joined = cut[mask[cut] & mask[cut + 1]]
    starts[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return Words(word_hash(data, start, end), start, end, np.searchsorted(start, part.offsets))


def shingle_hash(w: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words (of the whole slice)."""
    n = max(0, len(w) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ w[k:k + n]) * M1
        h ^= h >> S29
    return mix(h)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(total)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
