"""Vectorised words and n-grams over Arrow string arrays: 64-bit hashes, no Python object for a word.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes. A word's hash is a polynomial over random byte values modulo
2**64, finished with a mixer, so equal words have equal hashes everywhere and different words collide with a chance
of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES_LOWER = _VALUES[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_NOT_SPACE = ~_BLANK
#: Bytes handled at a time; a longer document is handled alone.
CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1024)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U))
        if size > 8 * CHUNK:  # one very long document: don't keep these
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finisher."""
    with np.errstate(over="ignore"):
        x = x + U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows that together have at most CHUNK bytes, or one longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of rows at[0], at[1], ..., relative to at[0], and each row's first word (n+1)."""
    base = at[0]
    part = data[base : at[-1]]
    rows = at - base
    solid = _NOT_SPACE[part]
    n = len(part)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = rows[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, rows)


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some rows, one after the other, and each row's first word (n+1)."""
    starts, ends, first = word_spans(data, at)
    part = data[at[0] : at[-1]]
    n = len(part)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U)
        np.cumsum((_VALUES_LOWER if lower else _VALUES)[part] * up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(U)), first


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; the last n-1 words start none."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        if n <= 6:
            out = np.zeros(size, U)
            for k in range(n):
                out = out * _BASE + words[k : k + size]
            return mix(out, n)
        up, down = powers(len(words) + 1)
        total = np.zeros(len(words) + 1, U)
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix((total[n:] - total[:-n]) * down[:size], n)


def per_row(column, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) for each row of a string column."""
    data, at = utf8(column)
    for i, j in chunks(at):
        hashes, first = word_hashes(data, at[i : j + 1], lower)
        for k in range(i, j):
            yield k, hashes[first[k - i] : first[k - i + 1]]


def lists(values: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """A list column from one array for each row."""
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    flat = np.concatenate(values) if values else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(kind, copy=False)))
