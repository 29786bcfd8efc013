"""Hashes of words and windows, and anchors: positions that equal windows are bound to share.

An anchor of a window is its least sub-window hash. Equal windows have the same least sub-window at
the same offset, so a window whose anchor hash occurs once in the corpus cannot repeat. That thins
the windows that have to be shuffled, without losing one that repeats. Anchors are polynomials modulo
2**64, quick and good enough where an equal hash only means more work; what decides that windows are
equal is window_keys(), or the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 16), np.uint64(base & ((1 << 64) - 1)), np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial of Rabin-Karp over 64-bit values, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal runs wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers(len(sums) + 1)[1][starts])


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of `width` values."""
    n = max(0, len(sums) - width)
    return mix((sums[width:] - sums[:n]) * _powers(len(sums) + 1)[1][:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours, by doubling; as long as x less width - 1."""
    f, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def window_anchors(sums: np.ndarray, valid: np.ndarray, width: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(least sub-window hash of each window, mask of the sub-windows that are the least of a valid window).

    valid marks the windows that lie inside one document.
    """
    n, span = len(valid), width - part + 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    sub = windows(sums, part) | np.uint64(1)
    least = _sliding(sub, span, True)[:n]
    padded = np.zeros(n + 2 * (span - 1), np.uint64)
    padded[span - 1 : span - 1 + n] = np.where(valid, least, 0)
    return least, _sliding(padded, span, False)[: len(sub)] == sub


def inside(starts: np.ndarray, ends: np.ndarray, total: int, width: int) -> np.ndarray:
    """Mask of the window starts (total - width + 1 of them) whose window lies inside one of the runs."""
    n = max(0, total - width + 1)
    change = np.zeros(total + 1, np.int64)
    long = ends - starts >= width
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - width + 1, -1)
    return np.cumsum(change)[:n] > 0


#: Bytes above which a run is hashed by XXH64 in one call.
_LONG = 64
_SEED = 0x2545F4914F6CDD1D


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end]: eight bytes at a time with a mix after each, so runs have no algebra to cancel in."""
    size = ends - starts
    out = mix(size.astype(np.uint64) ^ np.uint64(_SEED))
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the bytes from each place on
    live, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(live):
        left = size[live] - at
        chunk = eight[starts[live] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))
        out[live] = mix(out[live] ^ chunk)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh64_intdigest(memoryview(data[starts[i] : ends[i]]), _SEED)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word, end word of each text); solid marks the bytes that words are made of."""
    if not len(data):
        none = np.zeros(len(starts), np.int64)
        return np.zeros(0, np.uint64), none, none
    inner = solid[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[ends] = True
    begin = inner & (np.concatenate([[True], ~inner[:-1]]) | edge[:-1])
    stop = inner & (np.concatenate([~inner[1:], [True]]) | edge[1:])
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return run_hashes(data, a, b), np.searchsorted(a, starts), np.searchsorted(a, ends)


#: The modulus of window_keys(), a prime, and its two bases.
_P = np.uint64((1 << 61) - 1)
_BASES = (0x1F83D9ABFB41BD6B % int(_P), 0x0BB67AE8584CAA73 % int(_P))


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return x - _P * (x >= _P)


def _times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo 2**61 - 1, for factors below it: products of 31-bit halves, as 2**61 counts as 1."""
    low, high = np.uint64((1 << 31) - 1), np.uint64(31)
    c0, c1, x0, x1 = np.uint64(c & int(low)), np.uint64(c >> 31), x & low, x >> high
    middle = x1 * c0 + x0 * c1
    return _reduce(x1 * c1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << high) + x0 * c0)


def rabin_karp(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """The polynomial of each window of `width` values, modulo 2**61 - 1.

    Windows are doubled, and those of the powers of two in width are joined, so a place takes about
    two products for each bit of width and no division.
    """
    if len(values) < width:
        return np.zeros(0, np.uint64)
    power, have, done, out = _reduce(values), 1, 0, None
    while True:
        if width & have:
            if out is None:
                out = power
            else:
                n = len(power) - done
                out = _reduce(_times(out[:n], pow(base, have, int(_P))) + power[done:])
            done += have
        if have * 2 > width:
            return out
        power = _reduce(_times(power[: len(power) - have], pow(base, have, int(_P))) + power[have:])
        have *= 2


def window_keys(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent Rabin-Karp hashes of each window of 64-bit values, 122 bits together.

    Two different windows get the same pair with a chance of about width / 2**122 * width.
    """
    return rabin_karp(values, width, _BASES[0]), rabin_karp(mix(values ^ np.uint64(_SEED)), width, _BASES[1])
