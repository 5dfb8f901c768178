"""Vectorised reading of Arrow text: byte buffers, words, 64-bit word hashes.

A column of texts is looked at as one byte array with offsets, so that no Python
loop runs over characters or words. Hashes are polynomials modulo 2**64 over
random byte values, scrambled at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240607)
#: A random odd value for each byte, and the base and its inverse modulo 2**64.
BYTE = (_RNG.integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(BASE, -1, 2**64)
#: A-Z count as a-z.
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are hashed at a time.
SEGMENT = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if _POWERS.get("n", np.zeros(0)).size < n:
        for name, b in (("n", BASE), ("i", _INVERSE)):
            a = np.full(max(n, SEGMENT), b, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["n"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the number of words before it (one more at the end)."""
    inside = ~SPACE[data]
    start, end = inside.copy(), inside.copy()
    if data.size:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offs[(offs > 0) & (offs < data.size)]
        start[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """64-bit hashes of the spans [s, e), which are sorted by start."""
    out = np.empty(len(s), np.uint64)
    k = 0
    while k < len(s):
        a = int(s[k])
        to = max(k + 1, int(np.searchsorted(s, a + SEGMENT // 2)))
        b = int(e[k:to].max())
        pw, inv = powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * pw[: b - a], out=sums[1:])
        x, y = s[k:to] - a, e[k:to] - a
        out[k:to] = mix((sums[y] - sums[x]) * inv[x] + (y - x).astype(np.uint64))
        k = to
    return out


def pieces(batch: pa.RecordBatch, text: str, most: int = 8 << 20, rows: int | None = None):
    """Slices of a batch with about ``most`` bytes of text and at most ``rows`` rows, one row at least."""
    size = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
    ends = np.cumsum(size, dtype=np.int64)
    k = 0
    while k < batch.num_rows:
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
        to = min(to, k + rows) if rows else to
        yield batch.slice(k, to - k)
        k = to
