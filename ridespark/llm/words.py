"""Words of a batch of texts and their 64-bit hashes, by numpy over the bytes of an Arrow column.

All byte work runs over slices of bounded size, whatever the batch holds, and one text may be
longer than a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_STEP = 1 << 14

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of the two definitions in use; every byte of a character beyond ASCII is a word byte.
NOT_SPACE = ~_SPACES
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + _STEP)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of consecutive texts: byte ranges in `data`, hashes, and the first word of every text."""

    data: np.ndarray
    text_at: np.ndarray  # n + 1 byte offsets
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n + 1 word offsets

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For every word, its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, fold: np.ndarray = SAME) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        i = 0
        while i < len(self):
            base = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, base + SLICE_BYTES, "right")))
            part = fold[self.data[base : int(self.ends[j - 1])]].astype(np.uint64)
            up, down = _power(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * down[s])
            i = j
        return out

    def bytes_of(self, i: int, j: int, fold: np.ndarray = SAME) -> bytes:
        """Words i to j - 1, joined by a space."""
        return b" ".join(fold[self.data[self.starts[k] : self.ends[k]]].tobytes() for k in range(i, j))


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of every `size` consecutive hashes; entry i covers i to i + size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, q in enumerate(multipliers(size, seed * 1_000_003 + size)):
        out += hashes[j : j + n] * q
    return mix(out)


def inside(words: Words, size: int) -> np.ndarray:
    """Marks the windows of `size` words that lie in one text."""
    of = words.text_of()
    return of[: max(0, len(of) - size + 1)] == of[size - 1 :] if len(of) >= size else np.empty(0, bool)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def words_of(data: np.ndarray, at: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Maximal runs of word bytes inside each text."""
    base = int(at[0])
    data, at = data[base : int(at[-1])], at - base
    is_word = word_bytes[data]
    before = np.empty_like(is_word)
    before[1:] = is_word[:-1]
    if len(before):
        before[0] = False
        before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[:-1] = is_word[1:]
    if len(after):
        after[-1] = False
        cut = at[1:-1] - 1
        after[cut[cut >= 0]] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return Words(data, at, starts, ends, np.searchsorted(starts, at))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about `size` bytes of text; a longer text stands alone."""
    _, at = text_buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every piece, one piece after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(n) - n
    out[0] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last position of every run of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
