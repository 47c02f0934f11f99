"""Columns of texts to hashed words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed odd multipliers for mixing.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of a block of texts that is hashed at once, so that its arrays stay in the cache.
BLOCK = 256 << 10
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes its argument."""
    x ^= x >> np.uint64(32)
    x *= M2
    x ^= x >> np.uint64(29)
    x *= M3
    x ^= x >> np.uint64(32)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint64)
_lower[0x41:0x5B] += 0x20
_lower = _lower * M1 + np.uint64(1)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array that starts at 0, nulls empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    return pc.fill_null(column.cast(pa.string()), "")


def block_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is the mixed sum of a value for each of its bytes and places."""
    full = ~_space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(full & (np.concatenate(([True], ~full[:-1])) | first[:-1]))
    n = np.diff(np.searchsorted(start, offsets))
    if not len(start):
        return np.zeros(0, np.uint64), n
    place = np.arange(start[0], len(data), dtype=np.uint64) - np.repeat(start, np.diff(np.append(start, len(data)))).astype(np.uint64)
    each = mix(_lower[data[start[0] :]] + place * M2)
    each[~full[start[0] :]] = 0
    return mix(np.add.reduceat(each, start - start[0])), n


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts, words per text); words are parted by ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    found, at = [], 0
    while at < len(texts):
        end = min(max(at + 1, int(np.searchsorted(raw, raw[at] + BLOCK))), len(texts))
        found.append(block_hashes(data[raw[at] : raw[end]], raw[at : end + 1] - raw[at]))
        at = end
    return tuple(np.concatenate([x[i] for x in found]) if found else np.zeros(0, (np.uint64, np.int64)[i]) for i in (0, 1))
