"""Weighted MinHash signatures of word-shingle bags by hierarchical Poisson processes (BagMinHash).

A bag gives each shingle a weight, its number of occurrences. The weight axis is cut into the intervals
(0, 1], (1, 2], (2, 4], (4, 8], ...; each (shingle, interval) is a Poisson process in time whose rate is the
interval's width, and each of its points falls on one unit of weight within the interval and on one of the
signature's components, all drawn from hashes. A point counts if its unit is within the bag's weight, so
that bags share exactly the points of their common weight. A component is the earliest counting point on
it: two bags agree on a component with the probability of their weighted Jaccard similarity. Points are
drawn in order of time, and a process ends when it passes the latest component of its bag, so that a bag of
n shingles takes about n + m log m draws instead of n m.
"""

import numpy as np

from footfall.llm.common import mix64

SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = [np.uint64((2 * k + 1) * 0xD1342543DE82EF95 % (1 << 64)) for k in range(SHINGLE)]


def shingle_hashes(word_hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every shingle of SHINGLE words; a shorter text is one shingle, one without words none."""
    number = np.diff(bounds)
    shingles = np.where(number >= SHINGLE, number - SHINGLE + 1, np.minimum(number, 1))
    owner = np.repeat(np.arange(len(number)), shingles)
    first = np.repeat(bounds[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(len(owner))
    padded = np.concatenate([word_hashes, np.zeros(SHINGLE, np.uint64)])
    total = np.zeros(len(owner), np.uint64)
    ends = bounds[1:][owner]
    for k in range(SHINGLE):
        part = padded[first + k] * _MULTIPLIERS[k]
        total += np.where(first + k < ends, part, _MULTIPLIERS[k])
    return owner, mix64(total)


def bags(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) in order, and their numbers of occurrences."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.concatenate([at, [len(owner)]]))


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m signatures (times as 64-bit patterns) of bags; a bag without shingles has infinite times."""
    parts = []
    level = 0
    top = int(weights.max()) if len(weights) else 0
    while True:
        low = 0 if level == 0 else 1 << (level - 1)
        if low >= top:
            break
        inside = weights > low
        width = 1 if level == 0 else low
        key = mix64(hashes[inside] + np.uint64(level * int(_MULTIPLIERS[4]) % (1 << 64)))
        parts.append((owner[inside], key, weights[inside] - low, np.full(int(inside.sum()), width, np.int64)))
        level += 1
    times = np.full(n * m, np.inf)
    if not parts:
        return times.reshape(n, m).view(np.int64)
    bag, key, reach, width = (np.concatenate(x) for x in zip(*parts))
    now = np.zeros(len(bag))
    point = 0
    while len(bag):
        point += 1
        draw = mix64(key + np.uint64(point * int(_STEP) % (1 << 64)))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        now = now - np.log(uniform) / width
        place = mix64(draw + _STEP)
        component = ((place >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        unit = ((place & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        counts = unit < reach
        np.minimum.at(times, bag[counts] * m + component[counts], now[counts])
        last = times.reshape(n, m).max(axis=1)
        alive = now < last[bag]
        bag, key, reach, width, now = bag[alive], key[alive], reach[alive], width[alive], now[alive]
    return times.reshape(n, m).view(np.int64)


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """n x (m / rows) hashes, each of `rows` neighbouring components and the band's number."""
    n, m = signature.shape
    out = np.zeros((n, m // rows), np.uint64)
    for band in range(m // rows):
        total = np.full(n, np.uint64(band + 1), np.uint64)
        for k in range(rows):
            total = mix64(total * _STEP + signature[:, band * rows + k].view(np.uint64))
        out[:, band] = total
    return out.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact weighted Jaccard similarity of two bags with sorted distinct hashes."""
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = int(np.minimum(wa[at_a], wb[at_b]).sum())
    union = int(wa.sum()) + int(wb.sum()) - shared
    return shared / union if union else 0.0
