"""Tiles in which near pairs are sought by pieces or letters: none is lost, few are looked at."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import chunks, kernels
from plumbline.operators.similarity import candidates as cand
from plumbline.operators.similarity import pipeline as pl


def company_names(n, seed):
    """Names whose last words are common, as of one trade, with near copies of some."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abeilmnorstudcgp") for _ in range(k))
    out = set()
    while len(out) < n:
        name = f"{word(rng.randint(5, 8))} {word(rng.randint(6, 9))} {rng.choice(['hot', 'cold', 'small'])} {rng.choice(['ring', 'bolt', 'widget'])} sac"
        out.add(name)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            letters = list(name)
            for _ in range(rng.randint(1, 6)):
                i = rng.randrange(len(letters))
                letters[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "e", "x", "ss", " "])
            out.add(" ".join("".join(letters).split()))
    return sorted(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def scores(algorithm, left, right):
    if algorithm == "levenshtein":
        return np.array([1 - distance(a, b) / max(len(a), len(b)) for a, b in zip(left, right)])
    kernel = {"smith_waterman": kernels.smith_waterman_batch, "affine_gap": kernels.affine_gap_batch}[algorithm]
    return kernels.in_parts(kernel, left, right)


def pieces_lose_no_pair(monkeypatch, algorithm, threshold, most):
    values = company_names(500, 7)
    random.Random(1).shuffle(values)
    every = list(itertools.combinations(sorted(values), 2))
    want = {p for p, s in zip(every, scores(algorithm, *map(list, zip(*every)))) if s >= threshold}
    looked, met = [], chunks._met
    monkeypatch.setattr(chunks, "_met", lambda *a: (looked.append(len(i)) or (i, j) for i, j in met(*a)))
    rule, half = chunks.Rule(algorithm, threshold), len(values) // 3
    whole = chunks.Side(values)
    i, j, crowded = chunks.meeting(rule, whole, whole, lambda i, j: (whole.lengths[j] > whole.lengths[i]) | ((whole.lengths[j] == whole.lengths[i]) & (j > i)))
    missed = want - {tuple(sorted((values[a], values[b]))) for a, b in zip(i, j)}
    assert not len(crowded) and len(want) > 20
    assert not missed
    assert sum(looked) < most * len(every) and len(i) < 0.02 * len(every) + 2 * len(want)  # before, all pairs of a tile were compared
    x, y = chunks.Side(values[:half]), chunks.Side(values[half:])
    i, j, plain = chunks.meeting(rule, x, y, lambda i, j: y.lengths[j] >= x.lengths[i])
    found = {tuple(sorted((values[a], values[half + b]))) for a, b in zip(i, j)}
    j, i, common = chunks.meeting(rule, y, x, lambda j, i: x.lengths[i] > y.lengths[j])
    found |= {tuple(sorted((values[a], values[half + b]))) for a, b in zip(i, j)}
    one, left_out = set(values[:half]), {values[k] for k in plain} | {values[half + k] for k in common}  # compared with all
    assert {p for p in want if (p[0] in one) != (p[1] in one) and not left_out & set(p)} <= found


def test_affine_gap_at_90_looks_at_few_pairs(monkeypatch):
    pieces_lose_no_pair(monkeypatch, "affine_gap", 0.9, 0.1)


def test_affine_gap_at_88_looks_at_few_pairs(monkeypatch):
    pieces_lose_no_pair(monkeypatch, "affine_gap", 0.88, 0.15)


def test_edit_distance_looks_at_few_pairs(monkeypatch):
    pieces_lose_no_pair(monkeypatch, "levenshtein", 0.8, 0.3)


def test_smith_waterman_looks_at_few_pairs(monkeypatch):
    pieces_lose_no_pair(monkeypatch, "smith_waterman", 0.86, 0.2)


@pytest.mark.parametrize("algorithm,threshold", [("affine_gap", 88), ("levenshtein", 80), ("smith_waterman", 86), ("jaro_winkler", 88)])
def test_long_texts_and_many_letters_are_compared_too(spark, algorithm, threshold):
    """Texts beyond a word of places, and more different letters than are told apart."""
    base = company_names(12, 3)
    long = [" ".join(base[k : k + 4]) for k in range(4)]
    odd = ["".join(chr(0x4E00 + (7 * k + n) % 90) for n in range(12)) for k in range(6)]
    values = sorted({*base, *long, *(v + "s" for v in long), *(v.replace("a", "o", 1) for v in base), *odd, *(v[:-1] for v in odd), "a", "ab"})
    table = spark.createDataFrame([(v,) for v in values], "v string")
    found = {(r.a, r.b) for r in pl.scored_pairs(table, algorithm, threshold).collect()}
    every = spark.createDataFrame(list(itertools.combinations(values, 2)), "a string, b string").withColumn("s", pl.score_of(algorithm, F.col("a"), F.col("b")))
    assert found == {(r.a, r.b) for r in every.where(F.col("s") >= threshold).collect()} and any(len(a) > 64 for a, _ in found)


def test_cosine_does_not_join_on_one_common_word(spark):
    values = [f"{v.split()[0]}{k} {v.split()[1]}{k} hot bolt sac" for k, v in enumerate(company_names(60, 5))]
    values += [v.replace("hot", "cold") for v in values[:10]] + ["hot bolt sac", "hot bolt", "lima lima lima hot", "lima lima"]
    table = spark.createDataFrame([(v,) for v in sorted(set(values))], "v string")
    found = {(r.a, r.b) for r in cand.cosine_pairs(table, 0.6).collect()}
    every = spark.createDataFrame(list(itertools.combinations(sorted(set(values)), 2)), "a string, b string").withColumn("s", pl.score_of("cosine", F.col("a"), F.col("b")))
    want = {(r.a, r.b) for r in every.where("s >= 60").collect()}
    assert want <= found and len(want) > 10
    assert len(found) < len(want) + 200  # before, all pairs with the same trade


def test_monge_elkan_does_not_probe_common_words(spark, monkeypatch):
    """At a threshold of 90 less than half of the words may go without a near one, so the common words of a name are not probed."""
    values = [f"{v.split()[0]} {v.split()[1]} hot bolt sac" for v in company_names(60, 6)]
    values = sorted({*values, *(v[:4] + v[5:] for v in values[:8])})
    table = spark.createDataFrame([(v,) for v in values], "v string")
    found = {(r.a, r.b) for r in cand.monge_elkan_pairs(table, 0.9).collect()}
    every = spark.createDataFrame(list(itertools.combinations(values, 2)), "a string, b string").withColumn("s", pl.score_of("monge_elkan", F.col("a"), F.col("b")))
    want = {(r.a, r.b) for r in every.where("s >= 90").collect()}
    assert want <= found and len(want) > 4
    assert len(found) < 0.5 * len(values) * (len(values) - 1) / 2  # before, all pairs with the same trade


def letters_lose_no_pair(monkeypatch, threshold, winkler, most):
    from plumbline.functions import letters

    values = company_names(400, 11)
    random.Random(2).shuffle(values)
    every = list(itertools.combinations(sorted(values), 2))
    score = kernels.in_parts(lambda a, b: kernels.jaro_batch(a, b, winkler), *map(list, zip(*every)))
    want = {p for p, s in zip(every, score) if s >= threshold}
    matched, reaches = [], letters.jaro_reaches
    monkeypatch.setattr(letters, "jaro_reaches", lambda t, i, j, f: matched.append(len(i)) or reaches(t, i, j, f))
    floors, texts = cand.jaro_floors(threshold, winkler), letters.Texts(values)
    for half in (0, 130):
        matched.clear()
        found = [letters.similar(texts, half, floors, beginning) for beginning in ((False, True) if winkler else (False,))]
        pairs = [tuple(sorted((values[a], values[b]))) for i, j in found for a, b in zip(i, j)]
        one = set(values[:half])
        assert len(pairs) == len(set(pairs)) and {p for p in want if not half or (p[0] in one) != (p[1] in one)} <= set(pairs)
        assert sum(matched) < most * len(every) and len(want) > 10  # before, far more pairs passed the count of letters
    return letters


def test_jaro_winkler_at_92_matches_few_pairs(monkeypatch):
    letters_lose_no_pair(monkeypatch, 0.92, True, 0.01)


def test_jaro_matches_few_pairs(monkeypatch):
    letters_lose_no_pair(monkeypatch, 0.85, False, 0.2)


def test_jaro_winkler_at_88_matches_few_pairs(monkeypatch):
    letters_lose_no_pair(monkeypatch, 0.88, True, 0.05)
