"""Words, lines and shingles of a whole block of texts at once, as numpy arrays.

A block is the concatenated UTF-8 of some texts with the offset of each. Everything is
hashed to 64 bits by one prefix sum over the bytes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.random.default_rng(20240501).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        size = 1 << (n - 1).bit_length()
        factors = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return _powers[kind][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (the usual 64-bit finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Block:
    """Texts ``0..n-1``: text i is ``data[offsets[i]:offsets[i+1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def starts(self) -> np.ndarray:
        """True at the first byte of every text that has one."""
        mark = np.zeros(len(self.data) + 1, bool)
        mark[self.offsets] = True
        return mark[:-1]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def hashes(self, begin: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
        """A hash of the bytes of each range, the same wherever the range lies."""
        values = (_BYTE[_FOLDED] if fold else _BYTE)[self.data] * _power("up", len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        if not len(begin):
            return np.zeros(0, np.uint64)
        shift = _power("down", len(self.data))[begin]
        return mixed((sums[end] - sums[begin]) * shift + (end - begin).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text of every word: maximal runs without ASCII white space."""
        solid = ~_SPACE[self.data]
        first = self.starts()
        opens = solid & (first | ~np.concatenate(([False], solid[:-1])))
        closes = solid & np.concatenate((first[1:] | ~solid[1:], [True]))[: len(solid)]
        begin = np.flatnonzero(opens)
        return begin, np.flatnonzero(closes) + 1, self.owner(begin)

    def points(self) -> np.ndarray:
        """Code points before every byte, and in all."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=sums[1:])
        return sums


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Cut a string column into blocks of about ``limit`` bytes, whole texts each:
    ``(first row, row after the last, block)``. NULL counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        after = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        after = min(max(after, row + 1), len(column))
        yield row, after, Block(data[offsets[row] : offsets[after]], offsets[row : after + 1] - offsets[row])
        row = after


def grams(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``size`` words of one text, and the index of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total += words[at + j] * _GRAM[j]
    return mixed(total + np.uint64(size)), at


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def shingle_sets(block: Block, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text: runs of ``size`` words with A-Z
    folded; the whole sequence where there are fewer words; nothing without words."""
    begin, end, owner = block.words()
    words = block.hashes(begin, end, fold=True)
    runs, at = grams(words, owner, size)
    bounds = np.searchsorted(owner[at], np.arange(block.texts + 1))
    edges = np.searchsorted(owner, np.arange(block.texts + 1))
    for text in range(block.texts):
        n = edges[text + 1] - edges[text]
        if 0 < n < size:
            own = words[edges[text] : edges[text + 1]]
            with np.errstate(over="ignore"):
                yield mixed(np.array([(own * _GRAM[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        else:
            yield distinct(runs[bounds[text] : bounds[text + 1]])
