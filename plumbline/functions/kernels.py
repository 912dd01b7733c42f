"""String similarity of value pairs, computed on whole Arrow batches with NumPy.

Spark has no built-in for these five. Each function takes two string columns and returns 0..100.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import LEGAL_SUFFIXES, NAME_STOPWORDS

COLUMNS = 256  # letters of one matrix product
STRIP = 512  # rows of one strip of a tile
CELLS = 4_000_000  # cells of one matrix of texts; longer batches are cut, longer texts first
PAIRS = 1_000_000  # pairs of blocks that are ranked at once
AFFINE_RATIO = 0.25  # fixed value: shorter/longer length below which the score is 0
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0  # fixed values of both alignments
GAP_EXTEND = -0.1


def _codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Character codes as a matrix (rows padded with ``pad``) and the text lengths."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    width = max(int(lengths.max()) if len(texts) else 0, 1)
    matrix = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).astype(np.int64)
    matrix[np.arange(width)[None, :] >= lengths[:, None]] = pad
    return matrix, lengths


def jaro_batch(left: list[str], right: list[str], winkler: bool) -> np.ndarray:
    a, la = _codes(left, -1)
    b, lb = _codes(right, -2)
    rows, columns = np.arange(len(left)), np.arange(b.shape[1])
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used = np.zeros(b.shape, dtype=bool)
    matched = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        free = (b == a[:, i : i + 1]) & ~used & (np.abs(columns[None, :] - i) <= window[:, None])
        hit = free.any(axis=1)
        first = free.argmax(axis=1)
        used[rows[hit], first[hit]] = True
        matched[hit, i] = True
    m = matched.sum(axis=1)
    in_a = np.take_along_axis(a, np.argsort(~matched, axis=1, kind="stable"), axis=1)
    in_b = np.take_along_axis(b, np.argsort(~used, axis=1, kind="stable"), axis=1)
    width = min(a.shape[1], b.shape[1])
    moved = ((in_a[:, :width] != in_b[:, :width]) & (np.arange(width)[None, :] < m[:, None])).sum(axis=1) // 2
    safe = np.maximum(m, 1)
    score = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved) / safe) / 3, 0.0)
    if winkler:
        reach = min(4, width)
        same = np.cumprod(a[:, :reach] == b[:, :reach], axis=1).sum(axis=1)
        score = np.where(score > 0.7, score + same * 0.1 * (1 - score), score)
    return score


def smith_waterman_batch(left: list[str], right: list[str]) -> np.ndarray:
    a, la = _codes(left, -1)
    b, lb = _codes(right, -2)
    offset = np.arange(b.shape[1] + 1, dtype=float)
    row = np.zeros((len(left), b.shape[1] + 1))
    best = np.zeros(len(left))
    for i in range(a.shape[1]):
        gain = np.where(b == a[:, i : i + 1], MATCH, MISMATCH)
        start = np.zeros_like(row)
        start[:, 1:] = np.maximum(0.0, np.maximum(row[:, :-1] + gain, row[:, 1:] + GAP))
        # A gap along the row costs one per step, so the best source is a running maximum.
        row = np.maximum.accumulate(start + offset, axis=1) - offset
        best = np.maximum(best, row.max(axis=1))
    return best / np.maximum(MATCH * np.minimum(la, lb), 1.0)


def affine_gap_batch(left: list[str], right: list[str], compared: int | None = None) -> np.ndarray:
    """``compared``: only that many first characters are aligned; None aligns whole texts."""
    full = np.array([(len(x), len(y)) for x, y in zip(left, right)], dtype=float).reshape(-1, 2)
    a, la = _codes([t[:compared] for t in left], -1)
    b, lb = _codes([t[:compared] for t in right], -2)
    size, width = len(left), b.shape[1]
    rows, step = np.arange(size), np.arange(width + 1, dtype=float)
    pair = np.full((size, width + 1), -np.inf)
    pair[:, 0] = 0.0
    down = np.full((size, width + 1), -np.inf)
    along = np.full((size, width + 1), -np.inf)
    along[:, 1:] = GAP + step[:-1] * GAP_EXTEND
    out = np.zeros(size)
    for i in range(a.shape[1]):
        gain = np.where(b == a[:, i : i + 1], MATCH, MISMATCH)
        new_pair = np.full_like(pair, -np.inf)
        new_pair[:, 1:] = gain + np.maximum(pair, np.maximum(down, along))[:, :-1]
        down = np.maximum(pair + GAP, down + GAP_EXTEND)
        down[:, 0] = GAP + i * GAP_EXTEND
        along = np.full_like(pair, -np.inf)
        opened = np.maximum.accumulate(new_pair - step * GAP_EXTEND, axis=1)
        along[:, 1:] = opened[:, :-1] + GAP + step[:-1] * GAP_EXTEND
        pair = new_pair
        done = la == i + 1
        final = np.maximum(pair, np.maximum(down, along))[rows, lb]
        out = np.where(done, np.maximum(final, 0.0), out)
    shortest, longest = full.min(axis=1), full.max(axis=1)
    score = np.minimum(out / np.maximum(MATCH * np.minimum(la, lb), 1.0), 1.0)
    return np.where(shortest / np.maximum(longest, 1) < AFFINE_RATIO, 0.0, score)


_IGNORED = frozenset(LEGAL_SUFFIXES + NAME_STOPWORDS)


def _name_tokens(text: str) -> list[str]:
    every = text.lower().split()
    return [t for t in every if t not in _IGNORED and len(t) >= 3] or every


def monge_elkan_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Mean of the best token similarity in both directions; each distinct token pair is scored once per batch."""
    pairs = [(_name_tokens(x), _name_tokens(y)) for x, y in zip(left, right)]
    position: dict[tuple[str, str], int] = {}
    for s, t in pairs:
        for x in s:
            for y in t:
                position.setdefault((x, y), len(position))
    if not position:
        return np.zeros(len(pairs))
    score = jaro_batch([x for x, _ in position], [y for _, y in position], winkler=True)
    out = np.zeros(len(pairs))
    for i, (s, t) in enumerate(pairs):
        if s and t:
            grid = score[[position[x, y] for x in s for y in t]].reshape(len(s), len(t))
            out[i] = (grid.max(axis=1).mean() + grid.max(axis=0).mean()) / 2
    return out


def numbered_letters(text: str) -> list[tuple[str, int]]:
    """Letters numbered by occurrence, so that a set overlap counts repeated letters."""
    return [(c, k) for c, n in Counter(text).items() for k in range(n)]


def shared_counts(left: list, right: list, strip: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(start, counts): how many tokens each of ``strip`` sets (all by default) from ``start`` shares with each set of ``right``."""
    columns: dict = {}
    held = np.array(sorted((columns.setdefault(t, len(columns)), row) for row, tokens in enumerate(left) for t in tokens), dtype=np.int64).reshape(-1, 2)
    other = np.array(sorted((columns[t], row) for row, tokens in enumerate(right) for t in tokens if t in columns), dtype=np.int64).reshape(-1, 2)
    strip = strip or max(len(left), 1)
    for start in range(0, len(left), strip):
        rows = min(strip, len(left) - start)
        mine = held[(held[:, 1] >= start) & (held[:, 1] < start + rows)] - [0, start]
        shared = np.zeros((rows, len(right)), dtype=np.float32)
        for low in range(0, len(columns), COLUMNS):
            blocks = []
            for size, entries in ((rows, mine), (len(right), other)):
                first, last = np.searchsorted(entries[:, 0], [low, low + COLUMNS])
                block = np.zeros((size, COLUMNS), dtype=np.float32)
                block[entries[first:last, 1], entries[first:last, 0] - low] = 1
                blocks.append(block)
            shared += blocks[0] @ blocks[1].T
        yield start, shared


def letters_allow(left: list[str], right: list[str], floor: float) -> np.ndarray:
    """For each pair whether its common letters, all matched in order, reach a Jaro similarity of ``floor``."""
    counts = shared_counts([numbered_letters(t) for t in left], [numbered_letters(t) for t in right])
    _, shared = next(counts, (0, np.zeros((len(left), len(right)), dtype=np.float32)))
    la = np.array([max(len(t), 1) for t in left], dtype=float).reshape(-1, 1)
    lb = np.array([max(len(t), 1) for t in right], dtype=float).reshape(1, -1)
    return (shared > 0) & ((shared / la + shared / lb + 1) / 3 >= floor)


def edits_allow(
    left: list[str], right: list[str], threshold: float, algorithm: str, compared: int | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """(start, allowed) for strips of ``left``: whether the common letters and pairs of letters let a pair reach ``threshold``.

    An edit takes one letter and two pairs of letters from either text. An alignment may lose 2 (1 - threshold) points for
    each letter of the shorter text: a letter unmatched costs two, a pair of letters that is no longer one a point at least.
    """
    cut = compared if algorithm == "affine_gap" else None
    texts = [[t[:cut] for t in side] for side in (left, right)]
    letters = [[numbered_letters(t) for t in side] for side in texts]
    pairs = [[{t[i : i + 2] for i in range(len(t) - 1)} for t in side] for side in texts]

    def sizes(items: tuple | list) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.array([len(t) for t in side], dtype=np.float32) for side in items)
        return a.reshape(-1, 1), b.reshape(1, -1)

    (fa, fb), (la, lb), (pa, pb) = sizes((left, right)), sizes(texts), sizes(pairs)
    strips = zip(shared_counts(letters[0], letters[1], STRIP), shared_counts(pairs[0], pairs[1], STRIP))
    for (start, one), (_, two) in strips:
        fx, lx, px = (side[start : start + STRIP] for side in (fa, la, pa))
        if algorithm == "levenshtein":
            edits = np.floor(np.maximum(fx, fb) * (1 - threshold) + 1e-4)
            allowed = (one >= np.maximum(lx, lb) - edits) & (two >= np.maximum(px, pb) - 2 * edits)
        else:
            budget = np.minimum(lx, lb) * (2 * (1 - threshold))
            allowed = (one >= np.minimum(lx, lb) - np.floor(budget / 2 + 1e-4)) & (two >= np.where(fx <= fb, px, pb) - np.floor(budget + 1e-4))
            if algorithm == "affine_gap":
                allowed &= np.minimum(fx, fb) >= np.maximum(fx, fb) * AFFINE_RATIO - 1e-4
        yield start, allowed & (one > 0)


def trigram_entries(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct padded trigrams of every text; a code holds three code points of 21 bits."""
    padded = [f"##{t}##" for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    code = points[:-2] | points[1:-1] << 21 | points[2:] << 42
    inside = row[:-2] == row[2:]
    row, code = row[:-2][inside], code[inside]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def best_contained(block: np.ndarray, texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, rank, containment): the k best pairs i < j of every block by trigram containment, ties by position.

    ``block`` numbers the texts from 0 and ascends. Shared trigrams are counted from the texts of a block that have them.
    """
    rows = np.arange(len(texts))
    later = np.searchsorted(block, block, side="right") - 1 - rows  # texts of the block that follow
    first = np.cumsum(later) - later  # the pairs of a text are numbered from here
    row, code = trigram_entries(texts)
    size = np.bincount(row, minlength=len(texts))
    order = np.lexsort((row, code, block[row]))
    row, code = row[order], code[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (block[row[1:]] != block[row[:-1]])
    group = np.cumsum(new) - 1
    left = np.cumsum(np.bincount(group))[group] - 1 - np.arange(len(row))  # that follow with the same trigram
    shared = np.zeros(int(later.sum()), dtype=np.int64)
    found, held, at, step = [], 0, np.flatnonzero(left > 0), 1
    while len(at):
        i, j = row[at], row[at + step]
        found.append(first[i] + j - i - 1)
        held, step = held + len(at), step + 1
        at = at[left[at] >= step]
        if held >= CELLS or not len(at):
            shared += np.bincount(np.concatenate(found), minlength=len(shared))
            found, held = [], 0
    i = np.repeat(rows, later)
    j = i + 1 + np.arange(len(i)) - first[i]
    containment = shared / np.minimum(size[i], size[j])
    best = np.lexsort((-containment, block[i]))
    rank = np.arange(len(i)) - np.searchsorted(block[i], block[i])
    best, rank = best[rank < k], rank[rank < k]
    return i[best], j[best], rank + 1, containment[best]


def ranked_blocks(k: int):
    """For mapInPandas over (block, v) in that order, whole blocks to a task: (block, rank, a, b, containment) of the k best pairs."""

    def ranked(members: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(np.r_[True, (members.block.to_numpy()[1:] != members.block.to_numpy()[:-1])])
        n = np.diff(np.r_[starts, len(members)])
        pairs = n * (n - 1) // 2
        part = (np.cumsum(pairs) - pairs) // PAIRS
        ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True])
        for low, high in zip(np.r_[0, ends[:-1] + 1], ends):
            own = members.iloc[starts[low] : starts[high] + n[high]]
            block, v = own.block.to_numpy(), own.v.to_numpy()
            i, j, rank, containment = best_contained(np.repeat(np.arange(high - low + 1), n[low : high + 1]), list(v), k)
            yield pd.DataFrame({"block": block[i], "rank": rank.astype(np.int32), "a": v[i], "b": v[j], "containment": containment})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for members in batches:
            if not len(members):
                continue
            members = members if rest is None else pd.concat([rest, members], ignore_index=True)
            whole = (members.block != members.block.iloc[-1]).sum()  # the last block may go on
            rest = members.iloc[whole:]
            if whole:
                yield from ranked(members.iloc[:whole])
        if rest is not None:
            yield from ranked(rest)

    return run


def in_parts(batch, left: list[str], right: list[str]) -> np.ndarray:
    """The kernel over rows of like length, few enough at once that no matrix exceeds CELLS (one pair can)."""
    size = np.array([max(len(x), len(y), 1) for x, y in zip(left, right)])
    out, order, start = np.zeros(len(left)), np.argsort(-size, kind="stable"), 0
    while start < len(order):
        part = order[start : start + max(1, CELLS // int(size[order[start]]))]
        out[part] = batch([left[i] for i in part], [right[i] for i in part])
        start += len(part)
    return out


def _pair_udf(batch):
    @F.pandas_udf(T.DoubleType())
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(in_parts(batch, a.tolist(), b.tolist()) * 100 if len(a) else [], dtype="float64")

    return kernel


jaro = _pair_udf(lambda a, b: jaro_batch(a, b, winkler=False))
jaro_winkler = _pair_udf(lambda a, b: jaro_batch(a, b, winkler=True))
monge_elkan = _pair_udf(monge_elkan_batch)
smith_waterman = _pair_udf(smith_waterman_batch)


def affine_gap(a: Column, b: Column, compared: int | None = None) -> Column:
    return _pair_udf(lambda x, y: affine_gap_batch(x, y, compared))(a, b)
