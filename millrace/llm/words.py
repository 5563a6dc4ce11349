"""Vectorised word splitting and hashing over Arrow string buffers, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240817)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []

#: Bytes that one vectorised step handles; a longer single text is one step of its own.
STEP_BYTES = 2 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES)
        both = []
        for base in (_BASE, _INVERSE):
            seq = np.full(size, base, np.uint64)
            seq[0] = 1
            both.append(np.cumprod(seq, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, last
        row = last


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words between bytes of ``space`` (by default ``[^\\x20\\x09-\\x0D]+``), and the offsets of each row's words."""
    n = len(data)
    full = np.empty(n + 2, bool)
    full[0] = full[-1] = False
    full[1:-1] = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    here, before = full[1:], full[:-1]
    starts = np.flatnonzero(here & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~here))
    return starts, ends, np.searchsorted(starts, offsets)


def coded(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """An id for each word and the different words by id, exactly: ``letters`` are the words' bytes without what is between them."""
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range, A-Z lower-cased first unless told otherwise."""
    ahead, back = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    table = _VALUES[LOWER] if lower else _VALUES
    np.cumsum(table[data] * ahead[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive values; as many as there are full windows."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = h[:size].copy()
    for k in range(1, n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + size]
    return mix(out)
