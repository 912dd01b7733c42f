import random
import re

import numpy as np
import pytest

from plumbline.llm import jaccard_join
from plumbline.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def sets_of(texts, width=5):
    parts = [words(t) for t in texts]
    return [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in parts]


def brute(rows, width=5, percent=75):
    sets, parent = sets_of([t for _, t in rows], width), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    lowest = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[k]:
            lowest[root(k)] = min(lowest.get(root(k), doc_id), doc_id)
    return [(d, len(sets[k]), lowest.get(root(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)]


def corpus(seed, groups, members, length):
    """Groups of edited copies whose similarities lie around the threshold, chains among them, and shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(6, length))] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, members)):
            copy = list(base) if len(base) > 6 else [word() for _ in range(8)]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, 4) :]
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "stars"), [(1, 1), (2, 0), (3, 2)])
def test_components_equal_brute_force(spark, monkeypatch, seed, stars):
    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", 1 << 12)  # many blocks and tiles
    rows = corpus(seed, 40, 25, 60) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one TWO"), (1005, "two one"), (7, "again and again and again"), (None, "one two")]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, name string, component int").repartition(5)
    got = [tuple(r) for r in jaccard_join.jaccard_components(docs, stars=stars).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty_tables_and_tables_without_links(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "g h")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == [(1, 2, 1), (2, 0, 2), (3, 1, 3)]


def test_one_row_of_each_component_stays(spark):
    rows = corpus(5, 20, 10, 40) + [(500, None), (501, ""), (501, ""), (2, "same id other text here it is"), (None, "nobody knows this one at all")]
    rows += [(4, rows[4][1])] * 2
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long")
    left = jaccard_join.deduplicated(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    sets, plain = sets_of([t for _, t in rows]), [(k, t) for k, (_, t) in enumerate(rows)]
    group = [c for _, _, c in brute(plain)]
    want = set()
    for k, (doc_id, text) in enumerate(rows):
        if not sets[k]:
            want.add((doc_id, text))
        else:
            mates = [rows[j] for j in range(len(rows)) if group[j] == group[k]]
            ids = [m[0] for m in mates if m[0] is not None]
            if doc_id == (min(ids) if ids else None):
                want.add((doc_id, text))
    # of rows that share the smallest doc_id but not the text one stays
    assert sum(t == rows[4][1] and d == 4 for d, t in got) <= 1
    assert len({t for _, t in got}) == len(got) or all(not (t or "").strip() for _, t in got if [x for _, x in got].count(t) > 1)
    assert set(got) <= want and {d for d, _ in got} == {d for d, _ in want}


def test_a_star_and_a_chain_become_components(spark):
    links = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "x long, y long")).collect()))
    assert {got[k] for k in range(300)} == {0} and {got[1000 + k] for k in range(41)} == {1000}


def test_block_product(monkeypatch):
    rng = np.random.default_rng(1)
    rows, columns = ([np.unique(rng.integers(0, 50, rng.integers(1, 30))).astype(np.uint64) for _ in range(n)] for n in (7, 9))
    want = [[len(set(a) & set(b)) for b in columns] for a in rows]
    monkeypatch.setattr(jaccard_join, "CELLS", 150)
    bands = list(jaccard_join.overlaps(rows, columns))
    assert [k for k, _ in bands] == sorted({k for k, _ in bands}) and len(bands) > 1
    assert np.concatenate([part for _, part in bands], axis=1).tolist() == want


@pytest.mark.parametrize("stars", [0, 1])
def test_a_group_of_near_copies_gives_few_links(spark, monkeypatch, stars):
    """400 edited copies of one text: links stay linear in the rows however little the star joins."""
    rng, counted = random.Random(8), []
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(400):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
        rows.append((k, " ".join(copy)))
    real = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda links: counted.append(links.count()) or real(links))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in jaccard_join.jaccard_components(docs, stars=stars).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert counted and max(counted) <= 4 * len(rows)
