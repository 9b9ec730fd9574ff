"""Words and n-grams of many texts at once, as 64-bit hashes, without a Python step per word.

A word's hash is a polynomial in the random values of its bytes modulo 2**64. Prefix sums of the powers give every
word's value by one subtraction and one multiplication with an inverse power (the base is odd), whatever its length.
"""

from __future__ import annotations

import numpy as np

#: The six bytes that separate words (space, tab, line feed, vertical tab, form feed, carriage return).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 17
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverse


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span data[starts[i]:ends[i]]; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _SEGMENT, side="right")))
        high = int(ends[j - 1])
        if high - low > 8 * _SEGMENT:  # one huge span: in segments, so that tables and memory stay small
            total, at, scale = 0, low, 1
            powers, _ = _tables(_SEGMENT + 1)
            step = pow(_BASE, _SEGMENT, 1 << 64)
            while at < high:
                part = data[at : at + _SEGMENT]
                total = (total + scale * int(np.sum(_BYTE[part] * powers[: len(part)], dtype=np.uint64))) % 2**64
                at, scale = at + _SEGMENT, scale * step % 2**64
            out[i] = total
        else:
            powers, inverse = _tables(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[data[low:high]] * powers[: high - low], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each document's first word number (one more than there are documents)."""
    space = IS_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = True
    before[1:] = space
    before[offsets] = True  # a document's start parts words; its end is the next one's start
    solid = ~space
    starts = np.flatnonzero(solid & before[:-1])
    after = np.empty(len(data), bool)
    after[:-1] = space[1:]
    if len(data):
        after[-1] = True
        after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_TIMES = np.uint64(0xD1342543DE82EF95)


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive word hashes, by doubling; windows that cross documents are the caller's to drop."""
    if seed:
        h = mix(h, seed)
    if len(h) < n:
        return np.zeros(0, np.uint64)
    held, size, power, done, out = h, 1, _TIMES, 0, None
    while True:
        if n & size:
            part = held[done : done + len(h) - n + 1]
            with np.errstate(over="ignore"):
                out = part if out is None else out * power + part
            done += size
        if 2 * size > n:
            break
        with np.errstate(over="ignore"):
            held = held[:-size] * power + held[size:]
            power = power * power
        size *= 2
    return mix(out, n)


def whole(h: np.ndarray, seed: int = 0) -> int:
    """A hash of one short word sequence as a whole; its length counts, so it never meets a window of another size."""
    total = 0
    for x in (mix(h, seed) if seed else h).tolist():
        total = (total * int(_TIMES) + x) % 2**64
    return int(mix(np.array([total], np.uint64), len(h))[0])
