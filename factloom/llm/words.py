"""Whole batches of texts as arrays of word hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def chunks(sizes, limit: int = 1 << 18):
    """(from, to) ranges of consecutive items of at most ``limit`` bytes together, or one larger item."""
    low = total = 0
    for i, n in enumerate(sizes):
        if i > low and total + n > limit:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int, lower: bool) -> np.ndarray:
    table = mixed((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) * _ODD)
    if lower:
        table[65:91] = table[97:123]
    return table


_POWERS = [np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64: 0 to n - 1."""
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), _ODD, dtype=np.uint64))])
    return _POWERS[0][:n]


def word_hashes(texts: list[str | None], lower: bool = True, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): 64-bit hashes of all words in order; text i has hashes[bounds[i]:bounds[i + 1]].

    A word is a run without space, tab, line breaks, VT and FF. ``lower`` takes A to Z as a to z. A word's hash is a
    polynomial of its bytes modulo 2^64 over random byte values, spread by a finaliser. Null texts have no words.
    """
    data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(d) + 1 for d in data), dtype=np.int64, count=len(data))
    raw = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    blank = BLANKS[raw]
    inside = ~blank
    start = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]])) if len(raw) else np.zeros(0, dtype=np.int64)
    stop = np.flatnonzero(blank & np.concatenate([[False], inside[:-1]])) if len(raw) else np.zeros(0, dtype=np.int64)
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(start):
        return np.zeros(0, dtype=np.uint64), bounds
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    powers = _powers(len(raw) + 1)
    np.cumsum(_table(seed, lower)[raw] * powers[:len(raw)], out=sums[1:])
    # compare words at the same power: multiply by what is missing to the highest power
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    low = _inverse_powers(len(raw), inverse)[start]
    return mixed((sums[stop] - sums[start]) * low + (stop - start).astype(np.uint64)), bounds


_INVERSE = [np.ones(1, dtype=np.uint64)]


def _inverse_powers(n: int, inverse: np.uint64) -> np.ndarray:
    if len(_INVERSE[0]) < n:
        _INVERSE[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), inverse, dtype=np.uint64))])
    return _INVERSE[0]
