"""The 64-bit Mersenne Twister in numpy, with a jump to any place of its sequence.

A state of 312 words is renewed in whole arrays. The words follow a linear recurrence over GF(2): its polynomial P (degree 19,937)
comes from the words themselves by the Berlekamp-Massey algorithm, and the state J words later is the combination of the
first states that x^J mod P names. So each task starts at its own place, at a cost that grows with the logarithm of J only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the published generator: words of the state, the middle word, the twist, the split of a word, tempering, seeding.
N, M = 312, 156
TWIST = np.uint64(0xB5026F5AA96619E9)
HIGH, LOW = np.uint64(0xFFFFFFFF80000000), np.uint64(0x7FFFFFFF)
TEMPER = ((29, 0x5555555555555555), (-17, 0x71D67FFFEDA60000), (-37, 0xFFF7EEE000000000), (43, 0xFFFFFFFFFFFFFFFF))
SEED_FACTOR = 6364136223846793005
DEGREE = 19_937


def seeded(seed: int) -> np.ndarray:
    words = [seed % 2**64]
    for k in range(1, N):
        words.append((SEED_FACTOR * (words[-1] ^ words[-1] >> 62) + k) % 2**64)
    return np.array(words, np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a & HIGH) | (b & LOW)
    return (x >> np.uint64(1)) ^ ((x & np.uint64(1)) * TWIST)


def renewed(s: np.ndarray) -> np.ndarray:
    """The next 312 words; each depends on words that come before it, in three stretches."""
    out = np.empty(N, np.uint64)
    out[: N - M] = s[M:] ^ _mixed(s[: N - M], s[1 : N - M + 1])
    out[N - M : N - 1] = out[: M - 1] ^ _mixed(s[N - M : N - 1], s[N - M + 1 :])
    out[N - 1 :] = out[M - 1 : M] ^ _mixed(s[N - 1 :], out[:1])
    return out


def tempered(x: np.ndarray) -> np.ndarray:
    for shift, mask in TEMPER:
        moved = x >> np.uint64(shift) if shift > 0 else x << np.uint64(-shift)
        x = x ^ (moved & np.uint64(mask))
    return x


def stream(state: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` numbers after a state."""
    parts = []
    for _ in range(-(-count // N)):
        state = renewed(state)
        parts.append(state)
    return tempered(np.concatenate(parts))[:count] if parts else np.zeros(0, np.uint64)


@lru_cache(1)
def polynomial() -> int:
    """P, with bit i for the power i, from one bit of each of 2 * 19,937 words."""
    state, words = seeded(1), []
    for _ in range(2 * DEGREE // N + 2):
        state = renewed(state)
        words.append(state)
    bits = (np.concatenate(words)[: 2 * DEGREE] & np.uint64(1)).tolist()
    # Connection polynomials have bit i for the word i places back; `past` has the latest bit lowest.
    now, before, length, gap, past = 1, 1, 0, 1, 0
    for k, bit in enumerate(bits):
        past = past << 1 | bit
        if (now & past).bit_count() & 1:
            kept = now
            now ^= before << gap
            if 2 * length <= k:
                length, before, gap = k + 1 - length, kept, 0
        gap += 1
    if length != DEGREE:
        raise AssertionError(f"degree {length}")
    return int(bin(now)[2:].zfill(length + 1)[::-1], 2)


def _reduced(p: int, by: int) -> int:
    n = by.bit_length()
    while (d := p.bit_length() - n) >= 0:
        p ^= by << d
    return p


def _squared(p: int) -> int:
    return int("0".join(bin(p)[2:]), 2)


def jumped(state: np.ndarray, words: int) -> np.ndarray:
    """The state ``words`` words later."""
    by, g = polynomial(), 1
    for bit in bin(words)[2:]:
        g = _squared(g)
        g = _reduced(g << 1 if bit == "1" else g, by)
    coefficients = bin(g)[2:]
    sums = np.zeros(N + len(coefficients), np.uint64)
    sums[:N] = state
    for at, c in enumerate(coefficients[1:]):
        sums[at + N] = sums[at + M] ^ _mixed(sums[at : at + 1], sums[at + 1 : at + 2])[0]
        if c == "1":
            sums[at + 1 : at + 1 + N] ^= state
    return sums[len(coefficients) - 1 : len(coefficients) - 1 + N].copy()


def uniform_from(seed: int, start: int, count: int) -> np.ndarray:
    """Numbers ``start`` to ``start + count`` of a seed's sequence as doubles in [0, 1), from their upper 53 bits."""
    skip, rest = divmod(start, N)
    state = seeded(seed)
    if skip:
        state = jumped(state, skip * N)
    return (stream(state, rest + count)[rest:] >> np.uint64(11)) * 2.0**-53
