"""DartMinHash signatures (numpy, on Arrow batches).

Darts are thrown at each element in order of their rank: on every unit of weight
they arrive as a Poisson process whose gaps come from a hash of (element, unit,
number of the dart), so equal elements receive the same darts in every document.
Each dart names a coordinate; the earliest dart of a coordinate is its value.
A document of weight W needs ranks up to about k (ln k + 2) / W only, whence the
number of darts depends on k, not on the document's length. Documents with a
coordinate that no dart reached throw further.
"""

from __future__ import annotations

import numpy as np

GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document of each): every run of `size` words; all words of a shorter document together; none of an empty one."""
    n = np.diff(starts)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    at = np.arange(len(doc)) - np.repeat(first, count) + np.repeat(starts[:-1], count)
    length = np.minimum(n, size)[doc]
    h = mix(length.astype(np.uint64) * GOLD)
    for j in range(size):
        inside = length > j
        nxt = mix((h ^ words[np.where(inside, at + j, 0)]) * GOLD + np.uint64(1)) if len(words) else h
        h = np.where(inside, nxt, h)
    return h, doc


def signatures(elements: np.ndarray, doc: np.ndarray, n_docs: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(n_docs, k) earliest darts as (rank, dart) packed into 64 bits; a document without elements keeps NONE.

    `weights` are whole numbers of units, 1 if not given; an element that is listed twice with the same weight counts once.
    """
    best = np.full(n_docs * k, NONE, dtype=np.uint64)
    if weights is None:
        key, owner = elements, doc
    else:
        reps = weights.astype(np.int64)
        owner = np.repeat(doc, reps)
        unit = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(reps)])[:-1], reps)
        key = np.repeat(elements, reps)
        key = np.where(unit > 0, mix(key + unit.astype(np.uint64) * GOLD), key)
    total = np.bincount(owner, minlength=n_docs)
    reach = k * (np.log(k) + 2) / np.maximum(total, 1)
    while len(key):
        limit = reach[owner]
        k_now, o_now, r, m = key, owner, np.zeros(len(key)), 0
        while len(k_now):
            m += 1
            h = mix(k_now + np.uint64(m) * GOLD)
            r = r - np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
            inside = r <= limit
            if not inside.all():
                k_now, o_now, r, h, limit = k_now[inside], o_now[inside], r[inside], h[inside], limit[inside]
            g = mix(h ^ MIX2)
            packed = (r.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (g >> np.uint64(32))
            np.minimum.at(best, o_now * k + (g % np.uint64(k)).astype(np.int64), packed)
        short = (best.reshape(n_docs, k) == NONE).any(axis=1) & (total > 0)
        reach = np.where(short, reach * 2, reach)
        again = short[owner]
        key, owner = key[again], owner[again]
    return best.reshape(n_docs, k)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """(n_docs, k / rows) band keys; the band's number is part of the key."""
    n, k = sig.shape
    part = sig.reshape(n, k // rows, rows)
    h = mix(np.arange(1, k // rows + 1, dtype=np.uint64) * GOLD)[None, :].repeat(n, axis=0)
    for j in range(rows):
        h = mix((h ^ part[:, :, j]) * GOLD + np.uint64(1))
    return h.view(np.int64)
