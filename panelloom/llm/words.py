"""Words and hashes of word windows, in numpy, for batches of whole texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_LAST = _U(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers of the rolling sums over bytes and over words, and seeds of the lanes.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
LANES = (0x243F6A8885A308D3, 0x13198A2E03707344)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit changes all output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes of text hashed at once, and how many powers of a base a worker keeps (2 tables of 8 bytes each).
BLOCK, KEPT_POWERS = 1 << 18, 1 << 19


@cache
def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse; one table of KEPT_POWERS is kept for each base."""
    up, down = _table(base, KEPT_POWERS) if n <= KEPT_POWERS else _table.__wrapped__(base, n)
    return up[:n], down[:n]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, without a copy, with about `size` bytes in a column of strings or bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with about `size` bytes of text, and their texts; null: empty."""
    for part in slices(batches, column, size):
        yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts: where they stand, whose they are, and their hashes."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        data = b" ".join(texts) + b" "
        if fold:
            data = data.lower()  # of bytes: A-Z alone
        self.data = np.frombuffer(data, np.uint8)
        inside = (self.data != 32) & ((self.data < 9) | (self.data > 13))
        turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            turn = np.concatenate(([0], turn))
        self.starts, self.ends = turn[0::2], turn[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(lengths + 1)))
        #: The number of the first word of each text, and one more.
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        #: Words from each word on in its text.
        self.left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        if not len(self.starts):
            return np.empty(0, _U)
        out = np.empty(len(self.starts), _U)
        cuts = np.unique(np.searchsorted(self.ends, np.arange(0, self.ends[-1] + BLOCK, BLOCK)))
        for i, j in zip(cuts, np.append(cuts[1:], len(out))):
            if i == j:
                continue
            low, high = self.starts[i], self.ends[j - 1]
            up, down = _powers(BYTE_BASE, int(high - low))
            sums = np.concatenate(([_U(0)], np.cumsum((self.data[low:high].astype(_U) + _U(1)) * up)))
            starts, ends = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
        return out

    def windows(self, size: int, lane: int = 0, words: np.ndarray | None = None) -> np.ndarray:
        """64 bits for the window of `size` words at each word; the largest value where the text ends before."""
        words = self.hashes() if words is None else words
        n = len(words)
        out = np.full(n, _LAST)
        if n >= size:
            up, down = _powers(WORD_BASE, n)
            sums = np.concatenate(([_U(0)], np.cumsum(mix(words ^ _U(LANES[lane])) * up)))
            out[: n - size + 1] = mix((sums[size:] - sums[:-size]) * down[: n - size + 1] ^ _U(LANES[lane]))
            out[out == _LAST] = _LAST - _U(1)
            out[self.left < size] = _LAST
        return out


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each run of `width` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def local_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Whether each value is the least of some run of `width` values; every run has one at least."""
    if len(x) < width:
        return np.zeros(len(x), bool)
    least = _sliding(x, width, np.minimum)
    pad = np.zeros(width - 1, x.dtype)
    return _sliding(np.concatenate((pad, least, pad)), width, np.maximum) == x
