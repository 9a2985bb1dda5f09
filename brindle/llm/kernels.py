"""Vectorised numpy kernels over the byte buffers of Arrow string columns.

Every kernel works on whole texts.  ``slices`` cuts a column into runs of rows
of half a MB so that temporaries stay bounded; one text longer than a run is a
run of its own, and is read in pieces.  Hashes are 64 bits wide and mix each block of bytes before the
next comes in, so strings of regular build have no collisions by their build.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 500_000
_ODD = U64(0xD6E8FEB86659FD93)
_C = ctypes.CDLL(None)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words64(data: np.ndarray) -> np.ndarray:
    """The 64-bit little-endian word that begins at each byte and one past the last; zeros follow the data."""
    return np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))


def slices(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk, side="right")) - 1
        last = min(max(last, first + 1), n)
        low, high = int(offsets[first]), int(offsets[last])
        yield first, data[low:high], offsets[first : last + 1] - low
        first = last


def class_table(*inside: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the bytes in the given closed ranges."""
    table = np.zeros(256, bool)
    for low, high in inside:
        table[low : high + 1] = True
    return table


#: The bytes that separate words of `[^\x20\x09-\x0D]+`.
SPACE = class_table((0x20, 0x20), (0x09, 0x0D))
#: The ASCII bytes that separate words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
NOT_ALNUM = class_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes that are not in ``breaks``; runs end with their row."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(breaks[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    first[cuts] = True
    last[cuts - 1] = True
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    upto = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(upto))
    return starts, ends, row


#: Spans of more bytes than this are hashed one by one.
LONG = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes wherever they stand.

    Blocks of eight bytes are taken in one after another, each followed by a
    mixing step that is not linear; long spans have a BLAKE2b digest.
    """
    size = ends - starts
    value = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x9FB21C651E98DF25))
    long = size > LONG
    if long.any():
        raw = data.tobytes() if long.sum() > 1 else None
        for i in np.flatnonzero(long).tolist():
            a, b = int(starts[i]), int(ends[i])
            value[i] = int.from_bytes(hashlib.blake2b(raw[a:b] if raw is not None else data[a:b].tobytes(), digest_size=8).digest(), "little")
        live = np.flatnonzero(~long)
    else:
        live = np.arange(len(size))
    block = words64(data)
    j = 0
    while len(live):
        live = live[size[live] > j]
        left = np.minimum(size[live] - j, 8)
        value[live] = mix(value[live] ^ (block[starts[live] + j] & _KEEP[left])) + _ODD
        j += 8
    return value


#: Bytes of one text that are read at once; a longer text is read in pieces, so that temporaries stay bounded.
PIECE = 4_000_000


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of a run of texts, A-Z as a-z; a text that is longer than a piece must be a run of its own."""
    if len(data) <= piece or len(offsets) > 2:
        data = lower(data)
        starts, ends, row = words(data, offsets, breaks)
        return span_hashes(data, starts, ends), row
    out, begin = [], 0
    between = breaks[lower(np.arange(256, dtype=np.uint8))]
    while begin < len(data):
        end = min(begin + piece, len(data))
        while end < len(data) and not between[data[end - 1]]:  # on to the end of a word
            gap = np.flatnonzero(between[data[end : end + piece]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + piece, len(data))
        part = data[begin:end]
        out.append(word_hashes(part, np.array([0, len(part)]), breaks, len(part))[0])
        begin = end
    value = np.concatenate(out)
    return value, np.zeros(len(value), np.int64)


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as its counterpart in ``other``."""
    size = ends - starts
    same = size == other_ends - other_starts
    long = np.flatnonzero(same & (size > LONG))
    for i in long.tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[other_starts[i] : other_ends[i]])
    left, right = words64(data), words64(other)
    live = np.flatnonzero(same & (size <= LONG))
    j = 0
    while len(live):
        live = live[size[live] > j]
        keep = _KEEP[np.minimum(size[live] - j, 8)]
        here = (left[starts[live] + j] & keep) == (right[other_starts[live] + j] & keep)
        same[live[~here]] = False
        live = live[here]
        j += 8
    return same


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes at each place that has so many; ``width`` is 8 times a power of two.

    Doubling: the hash of twice as many bytes mixes those of both halves, not linearly.
    """
    out = mix(words64(data)[: max(0, len(data) - 7)] + _ODD)
    size = 8
    while size < width:
        half = out[: max(0, len(out) - size)]
        out = mix((half * U64(0xFF51AFD7ED558CCD)) ^ out[size:])
        size *= 2
    return out


def release() -> None:
    """Give memory that a finished task no longer uses back to the machine: workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        _C.malloc_trim(0)
    except AttributeError:  # not glibc
        pass


_MULTIPLIERS = mix(np.arange(100, 116, dtype=U64)) | U64(1)


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, sorted by row and hash.

    A row with fewer than k words, but not none, has its whole sequence as one.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, U64)
    out_row, out = [], []
    if n >= k:
        at = np.flatnonzero(row[k - 1 :] == row[: n - k + 1])
        total = np.zeros(len(at), U64)
        for j in range(k):
            total += mix(hashes[at + j] * _MULTIPLIERS[j])
        out_row.append(row[at])
        out.append(mix(total))
    for size in range(1, k):
        rows = np.flatnonzero(count == size)
        if len(rows):
            total = np.full(len(rows), U64(size))
            for j in range(size):
                total += mix(hashes[first[rows] + j] * _MULTIPLIERS[j])
            out_row.append(rows)
            out.append(mix(total))
    rows, value = np.concatenate(out_row), np.concatenate(out)
    if len(out) > 1:
        order = np.argsort(rows, kind="stable")
        rows, value = rows[order], value[order]
    ends = np.cumsum(np.bincount(rows, minlength=n_rows)).tolist()
    begin = 0
    for end in ends:  # numpy's sort of plain integers is many times faster than a sort by two keys
        value[begin:end].sort()
        begin = end
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    return rows[new], value[new]
