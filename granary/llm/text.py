"""Vectorised reading of text columns in Arrow batches: bytes, words, word hashes and shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(0, np.uint64), np.ones(0, np.uint64)]
#: Multipliers of the words of a shingle by place.
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)

#: ASCII letters become lower-case, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between the characters space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words of a-z, 0-9 and everything beyond ASCII (after lower-casing).
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def text_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about CHUNK_BYTES of text; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, len(col))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data`` and, per row, the index of its first word (one more entry at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[first] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[first[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, from one running polynomial sum over the bytes."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def shingle_sets(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its 5-word shingles); fewer words make one shingle, none an empty set."""
    none = np.zeros(0, np.uint64)
    for row, _, raw, offsets in text_chunks(batch, column):
        data = LOWER[raw]
        starts, ends, first = words(data, offsets, NOT_SPACE)
        h = word_hashes(data, starts, ends)
        five = none
        if len(h) >= 5:
            n = len(h) - 4
            five = h[:n] * _PLACES[0]
            for k in range(1, 5):
                five += h[k : k + n] * _PLACES[k]
            five = mix(five)
        for i in range(len(first) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= 5:
                s = np.sort(five[a : b - 4])
                yield row + i, s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield row + i, mix((h[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield row + i, none


def set_name(s: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set that does not depend on order."""
    with np.errstate(over="ignore"):
        total = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(s)) * np.uint64(_BASE)
    return int(mix(total).view(np.int64)[0])
