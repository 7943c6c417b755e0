"""Whole Arrow string columns as byte arrays: word bounds and word hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes scanned at once; a longer text is cut at word bounds, so memory does not follow its length.
SLICE = 1 << 19

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_UP = np.arange(256, dtype=np.uint8)
_UP[65:91] += 32
LOWER_VALUE = _VALUE[_UP]
_P = 0x9E3779B97F4A7C15
_POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SLICE - 1, _P, np.uint64)]))
_INV = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SLICE - 1, pow(_P, -1, 1 << 64), np.uint64)]))

#: Bytes that are part of a word: all but the six white-space characters of ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ASCII letters and digits, and every byte of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser of 64 bits: every input bit moves every output bit."""
    h = h ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows (strings or binaries) one after another, and where each row starts, with the end last. Null is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null(b"" if binary else "") if column.null_count else column
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, at: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of slices of at most SLICE bytes that split no word; a longer word has a slice of its own."""
    i, n = 0, len(data)
    while i < n:
        j = min(n, i + SLICE)
        if j < n:
            k = int(at[np.searchsorted(at, j, "right") - 1])
            if k > i:
                j = k
            else:
                gap = np.flatnonzero(~word[data[i:j]])
                if len(gap):
                    j = i + int(gap[-1]) + 1
                else:
                    end = int(at[np.searchsorted(at, i, "right")])
                    while j < end and word[data[j : j + SLICE]].all():
                        j = min(end, j + SLICE)
                    rest = np.flatnonzero(~word[data[j : min(end, j + SLICE)]])
                    j = j + int(rest[0]) if len(rest) else end
        yield i, j
        i = j


def words(column: pa.Array, word: np.ndarray = NOT_SPACE, stem: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each lower-cased word of all rows, and where each row's words start, with the end last.

    With `stem`, words are cut to so many leading bytes first.
    """
    data, at = raw(column)
    hashes, counts = [], np.zeros(len(at), np.int64)
    for i, j in slices(data, at, word):
        part = data[i:j]
        inside = word[part]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(at, [i, j])
        new = at[lo:hi] - i
        new = new[new < len(part)]
        starts[new] = inside[new]
        s = np.flatnonzero(starts)
        if len(s):
            value = LOWER_VALUE[part]
            value *= _POW[: len(part)] if len(part) <= SLICE else np.cumprod(np.r_[np.ones(1, np.uint64), np.full(len(part) - 1, _P, np.uint64)])
            value[~inside] = 0
            if stem:
                depth = np.arange(len(part)) - s[np.maximum(np.cumsum(starts) - 1, 0)]
                value[depth >= stem] = 0
            hashes.append(mix(np.add.reduceat(value, s) * _INV[np.minimum(s, SLICE - 1)]))
            counts += np.searchsorted(s, np.clip(at - i, 0, len(part)))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def word_counts(column: pa.Array, word: np.ndarray = NOT_SPACE) -> np.ndarray:
    """Number of words of each row."""
    data, at = raw(column)
    total = np.zeros(len(at), np.int64)
    for i in range(0, len(data), SLICE):
        inside = word[data[max(0, i - 1) : i + SLICE]]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        first = at[np.searchsorted(at, i) : np.searchsorted(at, i + SLICE)] - max(0, i - 1)
        first = first[first < len(inside)]
        starts[first] = inside[first]
        if i:
            starts = starts[1:]
        sums = np.concatenate([[0], np.cumsum(starts)])
        total += sums[np.clip(at - i, 0, len(starts))]
    return np.diff(total)


def head(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = NOT_SPACE[data]
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False))
    if n >= len(ends):
        return text
    return data[: ends[n - 1] + 1].tobytes().decode("utf-8", "surrogatepass") if n > 0 else ""
