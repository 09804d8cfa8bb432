"""Fuzzy keys of 64-bit fingerprints from the perfect binary Golay code.

Every 23-bit word is within three bits of exactly one of 4096 codewords. The keys of a word are
the codewords that it and its one-bit neighbours decode to: one or six of them. Two words that
differ in up to two bits have a word between them that neighbours both, so they share a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: a generator polynomial of the [23, 12, 7] code.
GENERATOR = 0b101011100011
#: (first bit, bits) of the segments of a fingerprint; the last is filled up with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Bits of a key that hold its second part, a codeword's index.
SECOND_BITS = 12


def codewords() -> np.ndarray:
    """Codeword of every 12-bit index: the index as a polynomial times the generator."""
    index = np.arange(1 << 12, dtype=np.int64)
    words = np.zeros_like(index)
    for bit in range(12):
        words ^= np.where(GENERATOR >> bit & 1, index << bit, 0)
    return words


@cache
def decoder() -> np.ndarray:
    """Index of the one codeword within three bits, for every 23-bit word (16 MB)."""
    errors = [sum(1 << i for i in bits) for w in range(4) for bits in combinations(range(23), w)]
    table = np.full(1 << 23, -1, dtype=np.int16)
    words = codewords()
    for e in errors:
        table[words ^ e] = np.arange(1 << 12, dtype=np.int16)
    return table


def segment(fingerprints: np.ndarray, k: int) -> np.ndarray:
    first, bits = SEGMENTS[k]
    return ((fingerprints >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def near(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid): the distinct keys of each word in a row of a matrix."""
    table = decoder()
    flips = np.array([0, *(1 << i for i in range(bits))], dtype=np.int64)
    keys = np.sort(table[words[:, None] ^ flips[None, :]].astype(np.int64), axis=1)
    fresh = np.ones(keys.shape, dtype=bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    # At most six codewords are near, so six columns hold them all.
    place = np.cumsum(fresh, axis=1) - 1
    out = np.zeros((len(words), 6), dtype=np.int64)
    rows, cols = np.nonzero(fresh)
    out[rows, place[rows, cols]] = keys[rows, cols]
    return out, np.arange(6)[None, :] < fresh.sum(axis=1)[:, None]


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) such that fingerprints within four bits share at least one key.

    Of four errors either at most two fall into each of the first two segments, and both are
    matched by their near codewords; or one of these has three or more, and then the other one
    and the last segment have at most one together: one equal, the other near.
    """
    parts = [segment(fingerprints, k) for k in range(3)]
    keys = [near(p, SEGMENTS[k][1]) for k, p in enumerate(parts)]
    rows_out, keys_out = [], []

    def add(kind: int, key: np.ndarray, valid: np.ndarray) -> None:
        rows, cols = np.nonzero(valid)
        rows_out.append(rows)
        keys_out.append(np.int64(kind) << 48 | key[rows, cols])

    n = len(fingerprints)
    both = (keys[0][0][:, :, None] << SECOND_BITS | keys[1][0][:, None, :]).reshape(n, 36)
    add(0, both, (keys[0][1][:, :, None] & keys[1][1][:, None, :]).reshape(n, 36))
    for kind, (equal, close) in enumerate(((1, 2), (2, 1), (0, 2), (2, 0)), 1):
        add(kind, parts[equal][:, None] << SECOND_BITS | keys[close][0], keys[close][1])
    return np.concatenate(rows_out), np.concatenate(keys_out)


def links_within(fps: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (indices) of one group of distinct fingerprints under distance ``most``.

    Balls around pivots: whatever lies within ``most`` bits of a pivot is one component with it.
    Two balls are compared member by member only while they are not connected yet and their
    pivots are near enough for a link, so a dense group costs its size times its few pivots.
    """
    left = np.arange(len(fps))
    balls, pivots, us, vs = [], [], [], []
    while len(left):
        p = left[0]
        close = np.bitwise_count(fps[left] ^ fps[p]) <= most
        ball = left[close]
        pivots.append(p)
        balls.append(ball)
        us.append(np.full(len(ball) - 1, p))
        vs.append(ball[1:])
        left = left[~close]
    root = list(range(len(balls)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    heads = fps[np.array(pivots, dtype=np.int64)] if pivots else fps[:0]
    for i in range(len(balls)):
        apart = np.bitwise_count(heads[i + 1 :] ^ heads[i])
        for j in i + 1 + np.flatnonzero(apart <= 3 * most):
            if find(i) == find(j):
                continue
            small, large = sorted((balls[i], balls[j]), key=len)
            for x in small:
                hit = np.flatnonzero(np.bitwise_count(fps[large] ^ fps[x]) <= most)
                if len(hit):
                    us.append(np.array([x]))
                    vs.append(large[hit[:1]])
                    root[find(i)] = find(j)
                    break
    return (np.concatenate(us), np.concatenate(vs)) if us else (left, left)
