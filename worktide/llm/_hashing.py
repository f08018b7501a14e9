"""Hashes of words and of runs of words, for whole batches of texts at once.

Words are runs of anything but ASCII white space. A batch is one byte array; a
word's hash comes from prefix sums of a polynomial over it (arithmetic mod
2**64, an odd base, a fixed random value for each byte), a run's hash in the
same way from its words. No Python loop touches a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes of text that are worked on at once, and the most powers that are kept.
SLICE_BYTES, KEPT_POWERS = 1 << 19, 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
RUN_BASE = 0xD6E8FEB86659FD93 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = tuple(both)
        if size <= KEPT_POWERS:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values * base**i, with a leading 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the ranges start..end that don't depend on where they lie."""
    return mixed((sums[end] - sums[start]) * powers(base, len(sums))[1][start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin and end
    (one offset more than texts). lower: A-Z count as a-z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = LOWERED[data]
    blank = np.concatenate([[True], BLANK[data]])
    edge = blank[1:] != blank[:-1]
    start = np.flatnonzero(edge & blank[:-1])
    end = np.flatnonzero(edge & blank[1:])
    hashes = between(prefix(OF_BYTE[data], BASE), start, end, BASE)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(start, begins)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (null: empty) of about ``most`` bytes together, each with the
    place of its first text; a longer text is alone. Only one run at a time is
    copied out of the batch."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()

    def run(a: int, b: int) -> tuple[int, list[bytes]]:
        return a, [t or b"" for t in texts.slice(a, b - a).cast(pa.binary()).to_pylist()]

    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield run(first, i)
            first, total = i, 0
        total += size + 1
    if first < len(sizes):
        yield run(first, len(sizes))
