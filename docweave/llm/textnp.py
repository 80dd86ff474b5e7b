"""Vectorised word and shingle hashes of texts, for use inside Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at once: bounds the temporary arrays (about ten times as much) for any batch.
CHUNK = 1 << 21
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def chunked(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in lists of about CHUNK characters; one longer text stands alone."""
    part: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bytes, start and end of every word in them, its hash, and bounds: words bounds[i]:bounds[i+1] are of text i.

    Words are runs without space and the control characters 9 to 13. lower: A-Z count as a-z.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    up, down = _power(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=run[1:])
    hashed = mix((run[end] - run[start]) * down[start])
    offsets = np.cumsum([0] + [len(x) + 1 for x in raw])
    return data, start, end, hashed, np.searchsorted(start, offsets)


def single_spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of words() with one space after each, and where each starts there, with the length as the last."""
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    flat = data[keep]
    flat[_SPACE[flat]] = 32
    return flat, np.concatenate(([0], np.cumsum(end - start + 1)))


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (uint64) of its n-word shingles; of all its words if fewer; else empty."""
    factors = [np.uint64(pow(_BASE, 3 * k + 1, 1 << 64)) for k in range(n)]
    for part in chunked(texts):
        _, _, _, hashed, bounds = words(part)
        if len(hashed) >= n:
            long = len(hashed) - n + 1
            rolled = np.zeros(long, np.uint64)
            for k, f in enumerate(factors):
                rolled += mix(hashed[k : k + long] * f)
            rolled = mix(rolled)
        for i in range(len(part)):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= n:
                s = np.sort(rolled[a : b - n + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                few = sum((mix(hashed[a + k : a + k + 1] * factors[k]) for k in range(b - a)), np.zeros(1, np.uint64))
                yield mix(few + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
