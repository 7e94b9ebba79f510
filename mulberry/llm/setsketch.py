"""SetSketch registers (O. Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog", 2021).

A register is the truncated exponent of the least of the exponential variates
that the elements of a set have there: max(0, min(q + 1, floor(1 - log_b x))).
The registers of a union are the maxima of the registers, so sketches merge;
with b close to 1 two registers agree about as often as the sets' Jaccard
similarity says.  The variates of an element are the first arrivals of a
Poisson process over the registers, so only arrivals before the latest register
minimum need to be drawn.
"""

from __future__ import annotations

import math

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def registers(elements: np.ndarray, m: int, b: float = 1.001, a: float = 20.0, q: int = 65534) -> np.ndarray:
    """The m registers (uint16) of a set of 64-bit hashes without repetitions; zeros if it is empty."""
    n = len(elements)
    if not n:
        return np.zeros(m, np.uint16)
    least = np.full(m, np.inf)
    active = elements.astype(np.uint64)
    at = np.zeros(n)
    step = 0
    draws = max(2, min(256, math.ceil(m * (math.log(m) + 2) / n)))
    while len(active):
        # draws more arrivals of each element that can still lower a minimum
        keys = np.arange(step, step + draws, dtype=np.uint64) * _GOLD
        bits = mix64(active[:, None] + keys[None, :])
        gaps = -np.log1p(-((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / (a * m)
        times = at[:, None] + np.cumsum(gaps, axis=1)
        places = (mix64(bits + _GOLD) % np.uint64(m)).astype(np.int64)
        np.minimum.at(least, places.ravel(), times.ravel())
        at = times[:, -1]
        on = at <= least.max()
        active, at = active[on], at[on]
        step += draws
        draws = max(2, min(256, draws // 2))
    # an arrival at time 0 would have an infinite exponent
    k = np.floor(1 - np.log(np.maximum(least, 1e-300)) / math.log(b))
    return np.clip(k, 0, q + 1).astype(np.uint16)


def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(x, y)


def jaccard(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n1: np.ndarray, n2: np.ndarray, b: float = 1.001, grid: int = 200) -> np.ndarray:
    """Similarities of the greatest joint likelihood, for arrays of pairs.

    above, below, equal: in how many registers the first sketch is larger,
    smaller, the same; n1, n2: the sizes of the sets.
    """
    n1, n2 = np.maximum(n1, 1).astype(float), np.maximum(n2, 1).astype(float)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    j = np.linspace(0, 1, grid + 1)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / math.log(b)

    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    same = 1 - up - down

    def term(count: np.ndarray, prob: np.ndarray) -> np.ndarray:
        return np.where(count[:, None] > 0, count[:, None] * np.log(np.maximum(prob, 1e-12)), 0.0)

    best = np.argmax(term(above, up) + term(below, down) + term(equal, same), axis=1)
    return j[np.arange(len(best)), best]
