import random
import re

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash_pivots
from plumbline.llm.components import star_forest


def plain_print(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, distance=4):
    group = list(range(len(prints)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                group[root(i)] = root(j)
    lowest = {}
    for k, i in enumerate(ids):
        if i is not None:
            lowest[root(k)] = min(lowest.get(root(k), i), i)
    return [lowest.get(root(k)) for k in range(len(prints))]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        base = [f"{rng.choice('aBcDé')}{rng.randint(0, 500)}" for _ in range(rng.choice([rng.randint(1, 40), rng.randint(200, 400)]))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 3])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 500)}"
            rows.append(rng.choice([" ", "\t", " \x0b\n"]).join(copy))
    return rows


@pytest.mark.parametrize(("limit", "small", "segments"), [(16384, 24, None), (3, 2, 6), (2, 3, 8)])
def test_components_equal_brute_force(spark, monkeypatch, limit, small, segments):
    monkeypatch.setattr(simhash_pivots, "LIMIT", limit)
    monkeypatch.setattr(simhash_pivots, "SMALL", small)
    if segments:
        monkeypatch.setattr(simhash_pivots, "segments_for", lambda n, distance: segments)
    texts = corpus(3, 60) + [None, "", " \t", "one", "One", "one two three", "a b c d", "   ", "a\u0085b c", "Ä ä A a"]
    rows = list(enumerate(texts, 10)) + [(None, "one"), (None, "nobody else has this text here"), (3, texts[5]), (3, texts[5])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fingerprint int, component string").repartition(5)
    got = [(r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in simhash_pivots.simhash_components(docs).collect()]
    prints = [plain_print(t) for _, t in rows]
    want = [(i, p, c) for (i, _), p, c in zip(rows, prints, plain_components(prints, [i for i, _ in rows]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({c for _, _, c in want}) < len(set(prints)) - 20


def test_a_long_text_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash_pivots, "COUNTED", 1000)
    rng = random.Random(1)
    long = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(200_000))
    rows = [(0, long), *((k, "the same few words again and again") for k in range(1, 400))]
    got = {r.doc_id: r for r in simhash_pivots.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].fingerprint & (1 << 64) - 1 == plain_print(long)
    assert {got[k].component_id for k in range(1, 400)} == {1} and got[0].component_id == 0


def test_an_empty_table(spark):
    assert simhash_pivots.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("segments", [5, 6, 7, 8, 10])
def test_near_fingerprints_meet_in_a_bucket_and_far_ones_are_discarded(segments):
    rng = np.random.default_rng(segments)
    prints = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    turned = prints.copy()
    for k in range(len(prints)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            turned[k] ^= np.uint64(1) << np.uint64(b)
    both = np.concatenate([prints, turned])
    table = simhash_pivots.distance_table(both, segments)
    keys = simhash_pivots.buckets(table, segments, 4)
    assert (keys[:400] == keys[400:]).any(axis=1).all()
    a, b = np.arange(400), np.arange(400, 800)
    assert len(simhash_pivots.near(table, both, a, b, 4)) == 400
    assert len(simhash_pivots.near(table, both, a, np.roll(b, 1), 4)) == 0


def test_links_of_a_dense_bucket_stay_fewer_than_its_members():
    rng = np.random.default_rng(2)
    prints = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))
    x, y = simhash_pivots.bucket_links(np.zeros(len(prints), np.int64), prints, 6, 4)
    assert len(x) == len(prints) - 1 and set(y.tolist()) == {int(prints.min())}


def test_star_forest_joins_what_the_links_join():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    x, y = star_forest(a, b)
    seen = {k: k for k in range(300)}
    for _ in range(300):
        for i, j in zip(a.tolist(), b.tolist()):
            seen[i] = seen[j] = min(seen[i], seen[j])
    want = {k: c for k, c in seen.items() if c != k}
    assert dict(zip(x.tolist(), y.tolist())) == want
