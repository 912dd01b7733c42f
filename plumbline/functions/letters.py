"""Pairs of texts with a high Jaro similarity, found by the letters that one has and the other lacks.

Texts are sorted into cells by length and by how many letters of some groups they have. Cells too far apart are not compared;
of the others the letters are compared as bits. Pairs that may have enough letters in common are matched letter by letter,
with a bit for every place. Nothing is lost: letters may share a symbol, which only lets more pairs through.
"""

from __future__ import annotations

import numpy as np

LONGEST = 64  # letters of a text whose places fit in a word; longer ones are compared otherwise
SYMBOLS = 64  # different letters of all texts that are told apart, with one for none
OFTEN = "eaosrnidltcumpgbvhfyqzjxkw"  # letters of names, the frequent ones first
GROUPS = [OFTEN[g::5] for g in range(5)]  # letters counted together, beside the rest
BITS = 48  # letters compared at first
CELLS = 200_000  # pairs compared at once
BATCH = 32_768  # pairs matched at once
EPS = 1e-9
#: Places that a letter at place k can be matched to, for every window.
REACH = np.array([[(2 ** min(k + w + 1, 64) - 1) & ~(2 ** max(k - w, 0) - 1) for w in range(LONGEST // 2)] for k in range(LONGEST)], dtype=np.uint64)


class Texts:
    """Texts of up to 64 letters with what is compared of them."""

    def __init__(self, texts: list[str]):
        self.lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        width = max(int(self.lengths.max()) if len(texts) else 0, 1)
        points = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
        inside = np.arange(width) < self.lengths[:, None]
        known, code = np.unique(points[inside], return_inverse=True)
        self.exact = len(known) < SYMBOLS
        self.codes = np.zeros(points.shape, dtype=np.uint8)  # in the order of the letters, 0 behind the end
        if self.exact:
            self.codes[inside] = code + 1
        symbols = np.where(inside, points % 31 + 1, 0).astype(np.int64)
        rows = np.arange(len(texts))[:, None]
        self.counts = np.bincount((rows * 32 + symbols).ravel(), minlength=32 * len(texts)).reshape(-1, 32)
        self.counts[:, 0] = 0
        self.begin = points[:, :4] if width >= 4 else np.pad(points, ((0, 0), (0, 4 - width)))
        self.width = len(known) + 1
        self.places = np.zeros((len(texts), self.width), dtype=np.uint64)
        for k in range(width if self.exact else 0):
            self.places[rows[:, 0], self.codes[:, k]] |= np.uint64(1) << np.uint64(k)
        self.places[:, 0] = 0
        self.places = self.places.ravel()

    def first_bits(self) -> np.ndarray:
        """Words of 16 bits: the occurrences of letters in which texts differ most often."""
        share = np.stack([(self.counts >= k).mean(axis=0) for k in range(1, 5)])
        best = np.argsort(-(share * (1 - share)).ravel(), kind="stable")[:BITS]
        words = np.zeros((BITS // 16, len(self.counts)), dtype=np.uint16)
        for n, at in enumerate(best.tolist()):
            k, s = divmod(at, 32)
            words[n // 16] |= (self.counts[:, s] > k).astype(np.uint16) << np.uint16(n % 16)
        return words

    def all_bits(self) -> np.ndarray:
        """Two words: the first to fourth occurrence of every symbol."""
        bits = np.zeros((2, len(self.counts)), dtype=np.uint64)
        for s in range(1, 32):
            word, at = divmod(s * 4, 64)
            bits[word] |= ((np.uint64(1) << np.minimum(self.counts[:, s], 4).astype(np.uint64)) - np.uint64(1)) << np.uint64(at)
        return bits

    def cells(self) -> np.ndarray:
        """How many letters of each group every text has, and how many others; they add up to its length."""
        groups = [self.counts[:, [ord(c) % 31 + 1 for c in g]].sum(axis=1) for g in GROUPS]
        return np.stack([*groups, self.lengths - sum(groups)], axis=1).astype(np.int16)


def lacking(floor: float) -> np.ndarray:
    """By two lengths: letters that one has and the other lacks, in all, at a similarity of ``floor`` (-1: none is so similar)."""
    a, b = np.maximum(np.arange(LONGEST + 1), 1)[:, None].astype(float), np.maximum(np.arange(LONGEST + 1), 1)[None, :].astype(float)
    least = np.maximum(np.ceil((3 * floor - 1 - 1e-6) * a * b / (a + b)), 1)
    return np.where(least > np.minimum(a, b), -1, a + b - 2 * least).astype(np.int16)


def jaro_reaches(texts: Texts, i: np.ndarray, j: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether the Jaro similarity of texts i and j, the first by text first, reaches ``floor``."""
    a, b = texts.codes.take(i, axis=0), texts.codes.take(j, axis=0)
    at = (a != b).argmax(axis=1)
    swap = a[np.arange(len(i)), at] > b[np.arange(len(i)), at]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    a = texts.codes.take(i, axis=0)
    la, lb = texts.lengths.take(i), texts.lengths.take(j)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    row = j * texts.width
    used, matched = np.zeros(len(i), dtype=np.uint64), np.zeros(len(i), dtype=np.uint64)
    for k in range(a.shape[1]):
        free = texts.places.take(row + a[:, k]) & REACH[k].take(window) & ~used
        low = free & (~free + np.uint64(1))
        used |= low
        matched |= (low != 0).astype(np.uint64) << np.uint64(k)
    m = np.bitwise_count(used).astype(np.int64)
    both = m / np.maximum(la, 1) + m / np.maximum(lb, 1)
    out = np.zeros(len(i), dtype=bool)
    left = np.flatnonzero((m > 0) & (both + 1 >= 3 * (floor - EPS)))
    if not len(left):
        return out
    a, b = a[left], texts.codes.take(j[left], axis=0)
    used, matched, m, moved = used[left], matched[left], m[left], np.zeros(len(left), dtype=np.int64)
    start = np.arange(len(left)) * a.shape[1]
    a, b = a.ravel(), b.ravel()
    for k in range(int(m.max())):
        more = k < m
        pa, pb = np.bitwise_count((matched & (~matched + np.uint64(1))) - np.uint64(1)), np.bitwise_count((used & (~used + np.uint64(1))) - np.uint64(1))
        moved += more & (a.take(start + pa, mode="clip") != b.take(start + pb, mode="clip"))
        matched &= matched - np.uint64(1)
        used &= used - np.uint64(1)
    score = (both[left] + (m - moved // 2) / m) / 3
    out[left] = score >= floor[left] - EPS
    return out


def _batches(pairs):
    """The pairs, some at a time: neither few nor too many."""
    held, n = [], 0
    for i, j in pairs:
        held.append((i, j))
        n += len(i)
        if n >= BATCH:
            i, j = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            for at in range(0, n, BATCH):
                yield i[at : at + BATCH], j[at : at + BATCH]
            held, n = [], 0
    if n:
        yield np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held])


def similar(texts: Texts, half: int, floors: list[float], beginning: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs whose Jaro similarity reaches the floor for the letters they begin with alike.

    ``floors``: for 0, 1, ... such letters, falling. ``beginning``: the pairs with two or more, otherwise those with fewer.
    Pairs are of a text before ``half`` and one from there on, or of all texts where ``half`` is 0.
    """
    limits, bits, floor = np.stack([lacking(f) for f in floors]), texts.all_bits(), np.array(floors)
    left = np.arange(half) if half else np.arange(len(texts.lengths))
    right = np.arange(half, len(texts.lengths)) if half else left
    few = min(1, len(floors) - 1)
    pairs = _beginning_alike(texts, left, right, not half) if beginning else _near_cells(texts, left, right, not half, limits[few])
    least, most = (2, len(floors) - 1) if beginning else (0, few)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for x, y in _batches(pairs):
        alike = np.cumprod(texts.begin.take(x, axis=0) == texts.begin.take(y, axis=0), axis=1)[:, : len(floors) - 1].sum(axis=1)
        alike = np.minimum(alike, np.minimum(texts.lengths.take(x), texts.lengths.take(y)))
        lacks = np.bitwise_count(bits[0].take(x) ^ bits[0].take(y)) + np.bitwise_count(bits[1].take(x) ^ bits[1].take(y))
        keep = np.flatnonzero((lacks <= limits[alike, texts.lengths.take(x), texts.lengths.take(y)]) & (alike >= least) & (alike <= most))
        x, y = x[keep], y[keep]
        reach = jaro_reaches(texts, x, y, floor[alike[keep]])
        found.append((x[reach], y[reach]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _near_cells(texts: Texts, left: np.ndarray, right: np.ndarray, diagonal: bool, limit: np.ndarray):
    """(i, j) of pairs whose first bits differ in no more letters than ``limit`` allows for their lengths."""
    cells, words = texts.cells(), texts.first_bits()

    def sorted_cells(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = cells[rows]
        order = rows[np.lexsort(own.T[::-1])]
        own = cells[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]).any(axis=1)
        start = np.flatnonzero(new)
        return order, start, np.diff(np.r_[start, len(order)]), own[start]

    order, start, n, cell = sorted_cells(left)
    other, first, size, far = (order, start, n, cell) if diagonal else sorted_cells(right)
    lengths, spread = far.sum(axis=1), np.ascontiguousarray(far.T)
    for c in range(len(start)):
        length, low = int(cell[c].sum()), c if diagonal else 0
        allowed = limit[length].take(lengths[low:])
        apart = np.abs(spread[0, low:] - cell[c, 0])
        for g in range(1, len(spread)):
            apart += np.abs(spread[g, low:] - cell[c, g])
        near = low + np.flatnonzero(apart <= allowed)
        if not len(near):
            continue
        m = size[near]
        columns = np.repeat(first[near] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        most = np.repeat(limit[length].take(lengths[near]).astype(np.uint8), m)
        mine, yours = order[start[c] : start[c] + n[c]], other[columns]
        beside = [w.take(yours) for w in words]
        step = max(1, CELLS // len(yours))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            differ = np.bitwise_count(words[0][rows][:, None] ^ beside[0])
            for w, b in zip(words[1:], beside[1:]):
                differ += np.bitwise_count(w[rows][:, None] ^ b)
            hit = np.flatnonzero(differ <= most)
            if len(hit):
                row, column = np.divmod(hit, len(yours))
                if diagonal:  # in the own cell, which comes first, a pair is met from both sides
                    later = columns[column] > start[c] + at + row
                    row, column = row[later], column[later]
                yield rows[row], yours[column]


def _beginning_alike(texts: Texts, left: np.ndarray, right: np.ndarray, diagonal: bool):
    """(i, j) of pairs with the same first two letters."""
    begin = texts.begin[:, 0].astype(np.uint64) << np.uint64(32) | texts.begin[:, 1]
    other = right[np.argsort(begin[right], kind="stable")]
    order = other if diagonal else left[np.argsort(begin[left], kind="stable")]
    low, high = (np.searchsorted(begin[other], begin[order], side=s) for s in ("left", "right"))
    if diagonal:
        low = np.arange(1, len(order) + 1)
    n = np.maximum(high - low, 0)
    total, at = np.cumsum(n), 0
    while at < len(order):
        done = total[at - 1] if at else 0
        end = max(int(np.searchsorted(total, done + BATCH, side="right")), at + 1)
        m = n[at:end]
        i = np.repeat(order[at:end], m)
        yield i, other[np.repeat(low[at:end] - (total[at:end] - m - done), m) + np.arange(len(i))]
        at = end
