"""Vectorised byte-level text primitives over Arrow string columns (numpy, no loop over words).

A column's UTF-8 buffer is cut into slices of whole documents of about a megabyte, so memory is
bounded by the slice or by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words that end at ASCII white space only.
NON_SPACE = ~_WS
#: Bytes of words made of ASCII letters (lower-cased), digits and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240229)
_MASK = (1 << 64) - 1
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_pow = {_P: np.ones(1, np.uint64), _PINV: np.ones(1, np.uint64)}
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _pow[base] = have if n <= 1 << 23 else have[: 1 << 20]
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes each."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words never cross documents."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = is_word[buf]
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    ends = off[1:]
    after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(mask & ~before)
    return start, np.flatnonzero(mask & ~after) + 1, np.searchsorted(off, start, "right") - 1


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_P, len(buf)), out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, wherever the span stands."""
    return mix((pre[end] - pre[start]) * _powers(_PINV, len(pre))[start])


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (in one flat array; callers cut at documents)."""
    out = np.full(max(0, len(h) - n + 1), np.uint64(n * 0x51ED270B & _MASK), np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * _MULT[j]
    return mix(out)


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document (A-Z lower-cased, white-space words).

    With fewer than n words the whole sequence is one shingle; without words the set is empty.
    """
    low = LOWER[buf]
    start, end, doc = words(low, off, NON_SPACE)
    h = span_hash(prefix(low), start, end)
    runs = run_hash(h, n)
    first = np.searchsorted(doc, np.arange(len(off)))
    out = []
    for d in range(len(off) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= n:
            s = runs[a : b - n + 1].copy()
            s.sort()
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(run_hash(h[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def word_texts(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by single spaces."""
    raw = buf.tobytes()
    return b" ".join(raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True))
