"""Pairs of texts that can be near by edits or alignment, found by a piece that both must have.

An edit spoils few pieces of a text. If more pieces are chosen than edits can spoil, one of them is left in the other text,
close to its place. The rarest pieces are chosen, so few pairs meet; their letters and pairs of letters are compared as bits.
Nothing is lost: letters may share a symbol, which only lets more pairs through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np

LONGEST = 64  # letters of a text that is cut into pieces; longer ones are compared with all
SIZES = (2, 3, 4)  # letters of a piece
CLASSES = 3  # classes of lengths in which pieces are looked up
BUCKETS = 22  # bits of a place in the index of pieces
BATCH = 100_000  # pairs that are looked at in one go
CROWDED = 0.25  # share of the other texts from which a text is compared with all of them
FIRST = 16  # letters of which the common subsequence is taken first
EDGE = 1e-4  # as in edits_allow: what rounding may take from a budget


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers from 1 to 31, 0 behind the end, and lengths."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    width = max(int(lengths.max()) if len(texts) else 0, 1)
    points = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    return np.where(np.arange(width) < lengths[:, None], points % 31 + 1, 0).astype(np.uint8), lengths


def letter_bits(letters: np.ndarray) -> np.ndarray:
    """Two words: the first to fourth occurrence of every symbol. A letter that the other text lacks is a bit it lacks."""
    bits = np.zeros((2, len(letters)), dtype=np.uint64)
    for s in range(1, 32):
        n = np.minimum((letters == s).sum(axis=1), 4).astype(np.uint64)
        word, at = divmod(s * 4, 64)
        bits[word] |= ((np.uint64(1) << n) - np.uint64(1)) << np.uint64(at)
    return bits


def pair_bits(letters: np.ndarray) -> np.ndarray:
    """Two words with a bit for every pair of neighbouring letters (pairs may share one)."""
    bits = np.zeros((2, len(letters)), dtype=np.uint64)
    for j in range(letters.shape[1] - 1):
        code = letters[:, j].astype(np.uint32) * 32 + letters[:, j + 1]
        at = (code * np.uint32(2654435761)) >> np.uint32(25)
        bit = np.where(letters[:, j + 1] > 0, np.uint64(1) << (at & np.uint32(63)).astype(np.uint64), np.uint64(0))
        bits[0] |= np.where(at < 64, bit, np.uint64(0))
        bits[1] |= np.where(at < 64, np.uint64(0), bit)
    return bits


def piece_codes(letters: np.ndarray, size: int) -> np.ndarray:
    """A number for the ``size`` letters from each place."""
    width = letters.shape[1] - size + 1
    code = np.zeros((len(letters), max(width, 0)), dtype=np.uint32)
    for k in range(size if width > 0 else 0):
        code = code << np.uint32(5) | letters[:, k : k + width]
    return code


class Rule:
    """What a pair that reaches ``threshold`` may lose, by the lengths of its shorter (x) and longer text (y)."""

    def __init__(self, algorithm: str, threshold: float):
        self.algorithm, self.threshold = algorithm, threshold
        self.edits = algorithm == "levenshtein"
        self.shared = 0 if self.edits else 1  # letters that neighbouring pieces may share

    def budget(self, x: int, y: int) -> int:
        """Edits, or points: an unmatched letter of x costs two at least, one of y within the alignment one."""
        whole = y * (1 - self.threshold) if self.edits else x * 2 * (1 - self.threshold)
        return int(np.floor(whole + EDGE))

    def spoiled(self, x: int, y: int) -> int:
        """Pieces that can be spoiled: an edit spoils one.

        Pieces of an alignment share an end letter at most, so an extra letter spoils one; an unmatched letter within the
        alignment spoils two and costs three; one more beside it, or before or behind the alignment, spoils one and costs
        two. Letters of y that are left over can't be more than those of x and what y is longer by.
        """
        return _spoiled(self.budget(x, y), y - x, self.edits)

    def shifts(self, x: int, y: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``n`` pieces the least and greatest shift at which it is to be sought in y.

        Of n pieces and n - 1 edits one is left that has as many edits before it as pieces, and so behind it.
        """
        d, i = y - x, np.arange(n)
        if self.edits:
            return np.maximum(-i, d - (n - 1 - i)), np.minimum(i, d + (n - 1 - i))
        unmatched = self.budget(x, y) // 2
        return np.full(n, -unmatched), np.full(n, d + unmatched)

    def letters(self, x: int, y: int) -> tuple[int, int]:
        """Letters that x and y may have and the other lacks."""
        most = self.budget(x, y)
        return (most - (y - x), most) if self.edits else (most // 2, y)

    def pairs(self, x: int, y: int) -> tuple[int, int]:
        """The same for pairs of letters."""
        most = self.budget(x, y)
        return (2 * most, 2 * most) if self.edits else (most, y)

    @cache
    def limits(self, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the length of y: whether it can be near, what x and y may lack of letters (rows 0, 2) and pairs (1, 3), edits."""
        limits, fits = np.zeros((4, LONGEST + 1), dtype=np.uint8), np.zeros(LONGEST + 1, dtype=bool)
        for k in range(x, min(LONGEST, max(self.reach(x), x)) + 1):
            (a, b), (c, d) = self.letters(x, k), self.pairs(x, k)
            fits[k] = min(a, b, c, d) >= 0
            limits[:, k] = np.clip([a, c, b, d], 0, 255)
        return fits, limits, np.array([self.budget(k, k) for k in range(LONGEST + 1)])

    def reach(self, x: int) -> int:
        """Length of the longest text that can be near one of ``x`` letters."""
        return int(x / self.threshold + EDGE) if self.edits and self.threshold > 0 else LONGEST


@cache
def _spoiled(budget: int, longer: int, edits: bool) -> int:
    if edits:
        return budget
    most = 0
    for inner in range(budget // 3 + 1):
        for outer in range((budget - 3 * inner) // 2 + 1):
            extra = min(budget - 3 * inner - 2 * outer, longer + inner + outer)
            most = max(most, 2 * inner + outer + extra)
    return most


def rarest_pieces(cost: dict[int, np.ndarray], width: int, n: int, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, total): for every row ``n`` pieces from left to right whose costs have the least sum (infinite if none fit).

    ``cost`` has a row of costs for each size, by place; pieces end within the first ``width`` letters."""
    rows = len(cost[SIZES[0]])
    none = np.float32(np.inf)
    before = np.zeros((width + 1, rows), dtype=np.float32)
    sizes, ends = [], []
    for _ in range(n):
        best = np.full((width + 1, rows), none, dtype=np.float32)
        size, end = np.zeros((width + 1, rows), dtype=np.int8), np.zeros((width + 1, rows), dtype=np.int8)
        for e in range(1, width + 1):
            best[e], end[e] = best[e - 1], end[e - 1]
            for g in SIZES:
                if e >= g:
                    total = before[min(e - g + shared, width)] + cost[g][:, e - g]
                    less = total < best[e]
                    best[e] = np.where(less, total, best[e])
                    size[e] = np.where(less, np.int8(g), size[e])
                    end[e] = np.where(less, np.int8(e), end[e])
        before = best
        sizes.append(size)
        ends.append(end)
    every, at = np.arange(rows), np.full(rows, width)
    start, chosen = np.zeros((n, rows), dtype=np.int64), np.zeros((n, rows), dtype=np.int64)
    for j in range(n - 1, -1, -1):
        e = ends[j][at, every].astype(np.int64)
        chosen[j] = sizes[j][e, every]
        start[j] = e - chosen[j]
        at = np.clip(start[j] + shared, 0, width)
    return start, chosen, before[width]


def _place(code: np.ndarray, size: np.ndarray | np.uint64, at: np.ndarray | np.uint64, salt: np.ndarray) -> np.ndarray:
    mixed = ((code.astype(np.uint64) << np.uint64(3) | size) << np.uint64(7) | at) * np.uint64(0x9E3779B97F4A7C15) + salt
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BUCKETS)).astype(np.uint32)


class Index:
    """Rows by piece, its place in the text and the salt of the row."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, salt: np.ndarray, sizes: set[int]):
        places, rows = [], []
        for g in sorted(sizes):
            code = piece_codes(letters, g)
            row, at = np.nonzero(np.arange(code.shape[1])[None, :] <= (lengths - g)[:, None])
            places.append(_place(code[row, at], np.uint64(g), at.astype(np.uint64), salt[row]))
            rows.append(row.astype(np.int32))
        place, row = np.concatenate(places), np.concatenate(rows)
        order = np.argsort((place & np.uint32(0x7FF)).astype(np.uint16), kind="stable")  # two passes, short keys are dealt
        order = order[np.argsort((place[order] >> np.uint32(11)).astype(np.uint16), kind="stable")]
        self.rows = row[order]
        self.starts = np.zeros(2**BUCKETS + 1, dtype=np.int32)
        np.cumsum(np.bincount(place, minlength=2**BUCKETS), out=self.starts[1:])


def _met(index: Index, x: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of the rows that the index has at each place, some at a time."""
    first = index.starts[place]
    n = index.starts[place + np.uint32(1)] - first
    some = np.flatnonzero(n)
    x, first, n = x[some], first[some], n[some]
    total = np.cumsum(n, dtype=np.int64)
    low = 0
    while low < len(x):
        done = total[low - 1] if low else 0
        high = max(int(np.searchsorted(total, done + BATCH, side="right")), low + 1)
        m = n[low:high]
        shift = np.repeat(first[low:high] - (total[low:high] - m - done).astype(np.int32), m)
        yield np.repeat(x[low:high], m), index.rows[shift + np.arange(len(shift), dtype=np.int32)]
        low = high


class Side:
    """Texts of a side of a tile, with all that is compared of them."""

    def __init__(self, texts: list[str]):
        self.letters, self.lengths = symbols(texts)
        self.far = self.lengths.astype(np.uint8)
        self.bits = np.concatenate([letter_bits(self.letters), pair_bits(self.letters)])

    def __len__(self) -> int:
        return len(self.lengths)

    def ending(self, size: int) -> np.ndarray:
        """A number for the last ``size`` letters."""
        code = np.zeros(len(self), dtype=np.uint64)
        for k in range(size):
            at = np.maximum(self.lengths - 1 - k, 0)
            code = code * np.uint64(1099511628211) + self.letters[np.arange(len(self)), at]
        return code

    @cached_property
    def places(self) -> np.ndarray:
        """For every row and symbol a word with a bit for each place of the symbol."""
        out, every = np.zeros((len(self), 32), dtype=np.uint64), np.arange(len(self))
        for k in range(self.letters.shape[1]):
            out[every, self.letters[:, k]] |= np.uint64(1) << np.uint64(k)
        out[:, 0] = 0
        return out.ravel()


class Costs:
    """How often the pieces of texts are found in a side, in those with the same salt where there is one."""

    def __init__(self, letters: np.ndarray, salt: np.ndarray | None = None):
        self.salted, self.tables = salt is not None, {}
        for g in SIZES:
            code = piece_codes(letters, g)  # pieces with a letter behind the end don't matter
            place = _place(code, np.uint64(g), np.uint64(0), salt[:, None]) if self.salted else code
            self.tables[g] = np.bincount(place.ravel(), minlength=2**BUCKETS if self.salted else 32**g).astype(np.float32)

    def of(self, letters: np.ndarray, salt: np.ndarray) -> dict[int, np.ndarray]:
        code = {g: piece_codes(letters, g) for g in SIZES}
        return {g: self.tables[g][_place(c, np.uint64(g), np.uint64(0), salt[:, None]) if self.salted else c] for g, c in code.items()}


def _ending_size(rule: Rule, x: Side, y: Side) -> int:
    """Length of the ending by which texts are told apart: that with the least pairs to expect (0: none)."""
    length = int(np.bincount(x.lengths).argmax())
    n = rule.spoiled(length, length) + 1
    if not rule.edits or n < 2:
        return 0
    some, own = np.flatnonzero(x.lengths == length)[:500], slice(0, 8192)  # for an estimate
    letters, plain = x.letters[some, :length], Costs(y.letters[own])
    cost = plain.of(letters, some)
    best, least = 0, float(rarest_pieces(cost, length, n, rule.shared)[2].mean())
    for size in sorted({int(length * share) for share in (0.2, 0.3, 0.4, 0.5)} - {0}):
        same = Costs(y.letters[own], y.ending(size)[own]).of(letters, x.ending(size)[some])
        total = float(rarest_pieces(cost, length - size, n - 1, rule.shared)[2].mean()) + float(rarest_pieces(same, length - size, n, rule.shared)[2].mean())
        if total < least:
            best, least = size, total
    return best


def _lacking(x: Side, y: Side, i: np.ndarray, j: np.ndarray, words: tuple[int, int]) -> np.ndarray:
    """Bits of these words that i has and j lacks."""
    lacks = np.zeros(len(i), dtype=np.uint8)
    for w in words:
        lacks += np.bitwise_count(x.bits[w].take(i) & ~y.bits[w].take(j))
    return lacks


def _near_bits(rule: Rule, x: Side, y: Side, i: np.ndarray, j: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose letters, pairs of letters and, under edits, common subsequence let them reach the threshold.

    All x have ``length`` letters.
    """
    fits, limits, budgets = rule.limits(length)
    keep = np.flatnonzero(fits.take(y.far.take(j)))
    i, j = i[keep], j[keep]
    for words, row in (((0, 1), 0), ((2, 3), 1)):
        near = _lacking(x, y, i, j, words) <= limits[row].take(y.far.take(j))
        i, j = i[near], j[near]
        if rule.edits:
            near = _lacking(y, x, j, i, words) <= limits[row + 2].take(y.far.take(j))
            i, j = i[near], j[near]
    if rule.edits and len(i):
        for first in (FIRST, LONGEST):  # of the first letters of y as many are in order in x as edits leave
            far = y.lengths.take(j)
            read = np.minimum(far, first)
            near = in_order(x, y, i, j, first, length) >= read - budgets.take(far)
            i, j = i[near], j[near]
    return i, j


def in_order(x: Side, y: Side, i: np.ndarray, j: np.ndarray, first: int, length: int) -> np.ndarray:
    """Length of the longest common subsequence of texts of x, of ``length`` letters, and the first letters of y."""
    every = np.uint64(2**64 - 1)
    row, left = i.astype(np.int64) * 32, np.full(len(i), every)
    letters = y.letters[:, : min(first, y.letters.shape[1])].take(j, axis=0)
    for k in range(letters.shape[1]):
        met = left & x.places.take(row + letters[:, k])
        left = (left + met) | (left - met)
    mask = every >> np.uint64(64 - length) if length else np.uint64(0)
    return np.bitwise_count(~left & mask).astype(np.int64)


def meeting(rule: Rule, x: Side, y: Side, later) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, crowded): pairs of a text of x and one of y that is as long or longer, and texts of x to be compared with all.

    ``later(i, j)``: whether a pair is to be found in this direction. Under edits texts with one ending of some letters and
    texts with different ones are sought apart: the latter have an edit less for what is before the ending.
    """
    crowded = np.zeros(len(x), dtype=bool)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if not len(x) or not len(y):
        return *found[0], np.flatnonzero(crowded)
    size = _ending_size(rule, x, y)
    ends = x.ending(size), y.ending(size)
    costs = {True: Costs(y.letters, ends[1] if size else None)}
    costs[False] = Costs(y.letters) if size else costs[True]
    step = 1 + int(y.lengths.max() - y.lengths.min()) // CLASSES
    low = int(y.lengths.min())
    kind = (y.lengths - low) // step
    if rule.edits:  # of one class none allows more edits than another
        kind = np.unique(kind * (LONGEST + 1) + [rule.budget(k, k) for k in y.lengths.tolist()], return_inverse=True)[1]
    lengths = np.unique(x.lengths)
    chosen: dict[tuple[int, int, bool], tuple] = {}
    prices: dict[tuple[int, bool], dict] = {}
    plans = []
    for length in lengths.tolist():
        rows = np.flatnonzero(x.lengths == length)
        for c in np.unique(kind[(y.lengths >= length) & (y.lengths <= max(rule.reach(length), length))]).tolist():
            ys = np.unique(y.lengths[(kind == c) & (y.lengths >= length) & (y.lengths <= max(rule.reach(length), length))]).tolist()
            for same in ((True, False) if size else (True,)):
                n = max(rule.spoiled(length, k) for k in ys) + (1 if same else 0)
                if n == 0:  # endings differ, so there is an edit that the budget has not
                    continue
                if length <= size or n > length:
                    crowded[rows] = True
                    continue
                if (length, n, same) not in chosen:
                    if (length, same) not in prices:
                        prices[length, same] = costs[same].of(x.letters[rows, :length], ends[0][rows])
                    chosen[length, n, same] = rarest_pieces(prices[length, same], length - size, n, rule.shared)
                crowded[rows[~(chosen[length, n, same][2] <= CROWDED * 4 * len(y))]] = True  # some four places in ten are sought
                plans.append((length, rows, c, ys, n, same))
    used = {int(g) for start, pieces, _ in chosen.values() for g in np.unique(pieces)} & set(SIZES)
    if not used:
        return *found[0], np.flatnonzero(crowded)
    salts = [(kind.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)]
    salts.append(salts[0] + ends[1] if size else salts[0])
    for same in ((True, False) if size else (True,)):
        index = Index(y.letters, y.lengths, salts[1 if same else 0], used)
        for length, rows, c, ys, n, of in plans:
            if of is not same:
                continue
            start, pieces, _ = chosen[length, n, same]
            keep = np.flatnonzero(~crowded[rows])
            if not len(keep):
                continue
            own = rows[keep]
            salt = np.full(len(keep), c + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            if same and size:
                salt += ends[0][own]
            codes = {g: piece_codes(x.letters[own, :length], g) for g in used}
            bounds = [rule.shifts(length, k, n) if not size or same or not rule.edits else _looser(rule, length, k, n) for k in ys]
            least, most = np.min([b[0] for b in bounds], axis=0), np.max([b[1] for b in bounds], axis=0)
            for p in range(n):
                at, g = start[p][keep], pieces[p][keep]
                code = np.zeros(len(keep), dtype=np.uint32)
                for s in used:
                    has = g == s
                    code[has] = codes[s][np.flatnonzero(has), at[has]]
                for shift in range(int(least[p]), int(most[p]) + 1):
                    ok = np.flatnonzero((at + shift >= 0) & (at + shift + g <= ys[-1]))
                    place = _place(code[ok], g[ok].astype(np.uint64), (at[ok] + shift).astype(np.uint64), salt[ok])
                    for i, j in _met(index, own[ok], place):
                        i, j = _near_bits(rule, x, y, i, j, length)
                        fits = later(i, j)
                        if size:
                            fits &= (ends[0][i] == ends[1][j]) == same
                        if fits.any():
                            found.append((i[fits].astype(np.int64), j[fits].astype(np.int64)))
    pair = np.unique(np.concatenate([i * len(y) + j for i, j in found]))
    return pair // len(y), pair % len(y), np.flatnonzero(crowded)


def _looser(rule: Rule, x: int, y: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shifts where the last edit is behind all pieces: of n pieces and n - 1 edits before it one is left."""
    d, i = y - x, np.arange(n)
    return np.maximum(-i, d - (n - i)), np.minimum(i, d + (n - i))
