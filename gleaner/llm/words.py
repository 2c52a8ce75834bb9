"""Words of Arrow string columns as NumPy arrays, hashed without a Python loop over words.

A word is a run of bytes other than space and \\x09-\\x0D. Hashes have 64 bits: a sum of per-byte random
values times powers of an odd number by place, mixed at the end. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
MASK = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_GRAM = _U(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text that one call of the kernels takes at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null counts as empty) and where each text starts and ends in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def slices(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together, or one row."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; one more at the end
    solid: np.ndarray  # which bytes belong to words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, np.uint64)
        heads = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(heads, lens)
        terms = _BYTE[self.data[self.solid]] * powers(_STEP, int(lens.max()))[place]
        return mix(np.add.reduceat(terms, heads) + lens.astype(np.uint64) * _GRAM)


def split(texts: pa.Array, lower: bool = False) -> Words:
    """lower: A-Z become a-z; other letters stay."""
    data, bounds = flat(texts)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return Words(data, starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, bounds), solid)


class Grams:
    """Hashes of runs of words, for any start and length, from prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        power = powers(_GRAM, n + 1)
        np.cumsum(hashes * power[:n], dtype=np.uint64, out=self.sums[1:])
        self.back = powers(_U(pow(int(_GRAM), -1, 1 << 64)), n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * _STEP + _U(salt))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the words at which a run of `size` words of one text starts."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    lens = np.diff(first)
    fits = lens >= size
    np.add.at(ok, first[:-1][fits], 1)
    np.add.at(ok, first[1:][fits] - size + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0) if n else np.zeros(0, np.int64)
