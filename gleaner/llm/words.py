"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

Texts stay the UTF-8 bytes that Arrow hands over. A word is a run of bytes that
are not one of space, tab, line feed, vertical tab, form feed and carriage
return, which are the same words that the pattern ``[^\\x20\\x09-\\x0D]+`` finds.
Work goes in blocks of about a megabyte, and a longer text is hashed in pieces
cut at white space, so memory is bounded by one text and its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_PIECE_BYTES = 1 << 16

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
SEPARATORS = np.ones(256, bool)
"""For words without punctuation: whatever is neither a letter or digit of ASCII nor part of another character."""
SEPARATORS[48:58] = SEPARATORS[65:91] = SEPARATORS[97:123] = SEPARATORS[128:] = False
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _SAME.copy()
_LOWER[65:91] += np.uint64(32)

_BASE = 0x9E6C63D0876A9A47 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = np.array(
    [0x8A5CD789635D2DFF, 0x121FD2155C472F97, 0xF9BD4D4A2F4E3B29, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
     0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE_BYTES + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Texts:
    """Consecutive rows of a batch: their bytes, and where each text begins (one more than texts)."""

    first_row: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Words in order; ``first[i]`` is the first word of text ``i``, ``first[-1]`` their number."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def text_blocks(column: pa.Array) -> Iterator[Texts]:
    """The texts of a string column in blocks; a null text is an empty one."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(bounds, bounds[row] + BLOCK_BYTES, "right")) - 1
        last = min(n, max(last, row + 1))
        yield Texts(row, raw[bounds[row]: bounds[last]], bounds[row: last + 1] - bounds[row])
        row = last


def words_of(texts: Texts, lower: bool = False, breaks: np.ndarray = SPACES) -> Words:
    """Words between bytes that ``breaks`` marks; ``lower`` takes A-Z for a-z."""
    data, bounds = texts.data, texts.bounds
    n = len(data)
    if not n:
        nothing = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), nothing, nothing, np.zeros(len(bounds), np.int64))
    solid = ~breaks[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    begins[edges] = solid[edges]
    stops[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = _hashed(data, starts, ends, _LOWER if lower else _SAME)
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds))


def spans_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of byte spans that are in order and don't overlap."""
    return _hashed(data, starts, ends, _LOWER if lower else _SAME)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span, from running sums over pieces of the data."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = int(np.searchsorted(ends, at + _PIECE_BYTES, "right"))
        if j <= i:  # one span longer than a piece
            out[i] = _long_span(data[starts[i]: ends[i]], values)
            i += 1
            continue
        piece = values[data[at: ends[j - 1]]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _POWERS[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * _INVERSES[s]
        i = j
    return mixed(out)


def _long_span(data: np.ndarray, values: np.ndarray) -> np.uint64:
    total, shift = 0, 1
    for at in range(0, len(data), _PIECE_BYTES):
        piece = values[data[at: at + _PIECE_BYTES]]
        total += shift * int((piece * _POWERS[: len(piece)]).sum(dtype=np.uint64))
        shift = shift * pow(_BASE, len(piece), 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` neighbouring words, as a number below 2**63; those of all texts run on."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += hashes[k: k + m] * _multiplier(k)
    return mixed(total) >> np.uint64(1)


def long_ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """As ``ngrams``, other numbers, from running sums: takes as long for any ``n``."""
    out = np.empty(max(0, len(hashes) - n + 1), np.uint64)
    for a in range(0, len(out), _PIECE_BYTES - n):  # sums stay within the powers at hand
        b = min(len(out), a + _PIECE_BYTES - n)
        sums = np.zeros(b - a + n, np.uint64)
        np.cumsum(hashes[a: b + n - 1] * _POWERS[: b - a + n - 1], out=sums[1:])
        out[a:b] = (sums[n:] - sums[:-n]) * _INVERSES[: b - a]
    return mixed(out) >> np.uint64(1)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole, non-empty word sequence; for fewer words than an n-gram has."""
    factors = np.array([_multiplier(k) for k in range(len(hashes))], np.uint64)
    total = (hashes * factors).sum(dtype=np.uint64, keepdims=True)
    return mixed(total + np.array([len(hashes)], np.uint64)) >> np.uint64(1)


def _multiplier(k: int) -> np.uint64:
    return _MULTIPLIERS[k % len(_MULTIPLIERS)] + np.uint64(2 * (k // len(_MULTIPLIERS)))


def shingle_set(words: Words, grams: np.ndarray, text: int, n: int) -> np.ndarray:
    """Sorted distinct n-grams of a text; with fewer words the whole sequence; empty without words."""
    a, b = words.first[text], words.first[text + 1]
    if b - a >= n:
        return np.unique(grams[a: b - n + 1])
    return whole(words.hashes[a:b]) if b > a else np.zeros(0, np.uint64)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of numpy arrays."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.to_pandas_dtype()), kind))
