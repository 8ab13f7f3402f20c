"""Vectorised byte and word handling for Arrow batches of texts.

Every routine works on the UTF-8 buffer of a whole slice of rows at once, so the
cost per byte is a few NumPy passes and never a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 512 << 10  # rows are taken together up to this many bytes (one long row goes alone)

_U = np.uint64
_rng = np.random.RandomState(20240917)
_BYTE_A = (_rng.randint(0, 2**63, 256, dtype=np.int64).astype(_U) << _U(1)) | _U(1)
_BYTE_B = (_rng.randint(0, 2**63, 256, dtype=np.int64).astype(_U) << _U(1)) | _U(1)
BASES = (_U(0x9E3779B97F4A7C15 | 5), _U(0xC2B2AE3D27D4EB4D))
_VALUES = (_BYTE_A, _BYTE_B)
_SHINGLE = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and len(column) else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES + 1024)
        base = BASES[which]
        inverse = _U(pow(int(base), -1, 1 << 64))
        p = np.full(n, base, dtype=_U)
        q = np.full(n, inverse, dtype=_U)
        p[0] = q[0] = _U(1)
        with np.errstate(over="ignore"):
            have = (np.multiply.accumulate(p), np.multiply.accumulate(q))
        _powers[which] = have
    return have


def rolling(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums from which `window_hash` reads the hash of any byte range."""
    n = len(data)
    _, inverse = powers(which, n + 1)
    out = np.zeros(n + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[which][data] * inverse[:n], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Karp-Rabin hash of bytes [start, end), whatever their place in the buffer.

    Good for choosing places by content and for finding candidates only: modulo 2**64 there are long texts
    (Thue-Morse words) that differ and collide. What decides equality is hashed by `contents` or compared.
    """
    p, _ = powers(which, len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * p[start])


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads low-order structure over all 64 bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(33))
        h = h * _U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _U(33))
        h = h * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


def contents(data: np.ndarray, start, end, seed=None) -> np.ndarray:
    """XXH3 of each byte range [start, end), seeded by a number for each range."""
    view, hashed = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    if seed is None:
        found = [hashed(view[a:b]) for a, b in zip(start.tolist(), end.tolist())]
    else:
        found = [hashed(view[a:b], s) for a, b, s in zip(start.tolist(), end.tolist(), seed.tolist())]
    return np.array(found, _U)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes not marked in `separator` (a table of 256)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separator[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row's first byte opens a word of its own
    start = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | first[:n]))
    end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | first[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


NEAR = 64  # places in a word whose values are looked up; those of later places are computed
_NEAR_VALUES = mix(np.arange(NEAR * 256, dtype=_U) + _U(0x9E3779B97F4A7C15))


PORTION = 1 << 20  # bytes whose values are held at a time


def _range_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray, offset: int = 0) -> np.ndarray:
    """Sum of the bytes' values in each range, none empty, places counted from `offset` on."""
    size = end - start
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    code = ((place + offset) << 8) | data[place + np.repeat(start, size)]
    late = code >= NEAR << 8
    if late.any():
        values = _NEAR_VALUES[np.where(late, 0, code)]
        with np.errstate(over="ignore"):
            values[late] = mix(code[late].astype(_U) + _U(0x9E3779B97F4A7C15))
    else:
        values = _NEAR_VALUES[code]
    with np.errstate(over="ignore"):
        return np.add.reduceat(values, first)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, none empty: the sum of a pseudo-random value for each byte at its place in the range."""
    if not len(start):
        return np.zeros(0, _U)
    total = np.cumsum(end - start)
    sums, i = np.zeros(len(start), _U), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PORTION, side="right")))
        if end[i] - start[i] > PORTION:  # one long range, piece by piece
            j, n = i + 1, int(end[i] - start[i])
            with np.errstate(over="ignore"):
                for at in range(0, n, PORTION):
                    sums[i] += _range_sums(data, start[i : i + 1] + at, np.minimum(start[i : i + 1] + at + PORTION, end[i]), at)[0]
        else:
            sums[i:j] = _range_sums(data, start[i:j], end[i:j])
        i = j
    return mix(sums)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, words being runs of bytes other than separators (ASCII white space), A-Z lowered."""
    low = lower_ascii(data)
    start, end, row = words(low, offsets, separator)
    return range_hashes(low, start, end), row


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word shingles.

    A row with fewer words has the whole sequence as its one shingle; a row
    without words has none.
    """
    h, row = word_hashes(data, offsets)
    n_rows = len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    out = []
    with np.errstate(over="ignore"):
        weights = _SHINGLE if width == 5 else mix(np.arange(1, width + 1, dtype=_U))
        k = len(h) - width + 1
        rolled = np.zeros(max(k, 0), _U)
        for j in range(width if k > 0 else 0):
            rolled += h[j : j + k] * weights[j]
        rolled = mix(rolled)
        for i in range(n_rows):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                short = mix((h[a:b] * weights[: b - a]).sum(dtype=_U) + _U(b - a))
                out.append(np.array([short], _U))
            else:
                out.append(np.zeros(0, _U))
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
