"""Words of Arrow text columns as 64-bit hashes, for whole batches at once.

Texts are read as UTF-8 bytes. A byte's kind (0 separates) and its folded form come from two tables; a word is a
stretch of one kind. Its hash is a sum over its folded bytes, mixed, so equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: bytes of text that are worked on at once; a longer text is taken alone
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (fixed values)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def keyed(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit numbers that look random, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt)) | U64(1)


@lru_cache(maxsize=8)
def _powers(bits: int) -> np.ndarray:
    return np.cumprod(np.full(1 << bits, 0x9E3779B97F4A7C15, U64))


_BYTE_VALUE = keyed(256, 11)


@dataclass(frozen=True)
class Alphabet:
    kind: np.ndarray  # uint8[256], 0 for separators
    fold: np.ndarray  # uint8[256]


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def alphabet(is_word, *, marks: bool = False) -> Alphabet:
    """Words of the bytes that `is_word` names; with `marks`, stretches of other bytes but white space are words too."""
    kind = np.array([1 if is_word(b) else 2 if marks and not (b == 32 or 9 <= b <= 13) else 0 for b in range(256)], np.uint8)
    return Alphabet(kind, _fold())


#: all but white space
SPACED = alphabet(lambda b: not (b == 32 or 9 <= b <= 13))
#: ASCII letters and digits, and all beyond ASCII
ALNUM = alphabet(lambda b: chr(b).isalnum() if b < 128 else True)
#: the same, and stretches of marks between
MARKED = alphabet(lambda b: chr(b).isalnum() if b < 128 else True, marks=True)


@dataclass(frozen=True)
class Words:
    """The words of rows [low, high) of a column: the row, the hash and the kind of each, in reading order."""

    low: int
    high: int
    row: np.ndarray  # int64, relative to low, ascending
    hash: np.ndarray  # uint64
    kind: np.ndarray  # uint8, as in the alphabet

    def bounds(self) -> np.ndarray:
        """Where each row's words begin, and the end."""
        return np.searchsorted(self.row, np.arange(self.high - self.low + 1))


def words(column: pa.Array, letters: Alphabet, target: int = CHUNK_BYTES) -> Iterator[Words]:
    """All rows in order, some at a time; nulls have no words."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + target, "right")) - 1)
        yield _words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], letters, low, high)
        low = high


def _words(data: np.ndarray, ends: np.ndarray, letters: Alphabet, low: int, high: int) -> Words:
    kind = letters.kind[data]
    begin = kind != 0
    begin[1:] &= kind[1:] != kind[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    begin[heads] = kind[heads] != 0  # no word runs over the end of a text
    inside = np.flatnonzero(kind)
    starts = np.flatnonzero(begin)
    if not len(starts):
        return Words(low, high, np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.uint8))
    first = np.flatnonzero(begin[inside])  # of each word, among the bytes inside words
    sizes = np.diff(first, append=len(inside))
    at = np.arange(len(inside)) - np.repeat(first, sizes)
    value = _BYTE_VALUE[letters.fold[data[inside]]] * _powers(max(10, int(sizes.max()).bit_length()))[at]
    hashes = mix(np.add.reduceat(value, first) + sizes.astype(U64) * U64(0xD6E8FEB86659FD93))
    return Words(low, high, np.searchsorted(ends, starts, "right") - 1, hashes, kind[starts])


def chained(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash for each n neighbouring words; texts are not told apart here."""
    if len(hashes) < n:
        return np.empty(0, U64)
    keys, total = keyed(n, 101 + salt), np.zeros(len(hashes) - n + 1, U64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * keys[k]
    return mix(total)
