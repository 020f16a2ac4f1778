"""Vectorised text primitives shared by the operators: words, lines and their 64-bit hashes, straight from Arrow buffers.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters; ASCII letters count as lower case.
A NULL text behaves as an empty one. Work is done on pieces of a batch of about ``PIECE`` bytes (a longer text is one piece).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)

#: Lower-cased byte of a word, 0 for every other byte.
WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORD_BYTE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORD_BYTE[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
WORD_BYTE[128:] = np.arange(128, 256)

_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for key, base in (("p", _P), ("i", _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash values as floats within (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


@dataclass
class Piece:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and offsets of each text within them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def pieces(texts: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[Piece]:
    """The texts of a column without copying, some rows at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield Piece(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, cut at the texts' borders."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = flag.copy()
    start[1:] &= ~flag[:-1]
    end = flag.copy()
    end[:-1] &= ~flag[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    start[cut] = flag[cut]
    end[cut - 1] = flag[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (uint8), equal for equal contents wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inverse = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words in text order; those of text i are ``at[i]:at[i+1]``."""

    hashes: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def words(piece: Piece) -> Words:
    lower = WORD_BYTE[piece.data]
    starts, ends = runs(lower > 0, piece.offsets)
    return Words(span_hashes(lower, starts, ends), np.searchsorted(starts, piece.offsets), starts, ends)


def word_hash(word: str) -> int:
    """The hash that ``words`` gives this word."""
    w = words(next(pieces(pa.array([word]))))
    if len(w.hashes) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(w.hashes[0])


def count_between(prefix_flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.zeros(len(prefix_flag) + 1, np.int64)
    np.cumsum(prefix_flag, out=sums[1:])
    return np.diff(sums[offsets])


def distinct_per_owner(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each owner with their multiplicities: owners, keys, counts; owners ascend. ``owner`` must ascend."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    return o[at], k[at], np.diff(np.append(at, len(k)))


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key within ``sorted_keys``, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    i = np.searchsorted(sorted_keys, keys)
    i[i == len(sorted_keys)] = 0
    return np.where(sorted_keys[i] == keys, i, -1)


def together(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of 64-bit hashes in which equal ones stand together, and the places in it where a run of equal ones starts.

    Sorted are the hashes with their places in the lowest bits, which is much faster than an argsort. Hashes that are alike in all other bits
    may take turns, so a hash can have several runs.
    """
    bits = np.uint64(max(len(keys) - 1, 0).bit_length())
    order = (np.sort(keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    s = keys[order]
    return order, np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])


def lookup_hashes(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``lookup`` of hashes that repeat: each run of equal ones once and in ascending order, so that large tables are read nearly from front to back."""
    order, first = together(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(lookup(sorted_keys, keys[order[first]]), np.diff(np.append(first, len(keys))))
    return out
