import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import decontamination
from plumbline.llm.decontamination import Items, Shard
from plumbline.llm.words import NON_WORDS, hashed_words

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            x = words(item)
            k = min(window, len(x))
            grams = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if k else set()
            for a in range(len(w) - k + 1 if k else 0):
                if tuple(w[a : a + k]) in grams:
                    hit |= set(range(a, a + k))
                    names.add("null" if name is None else str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    return out


@pytest.mark.parametrize("trial", range(40))
def test_windows_and_longest_matches_in_a_shard(trial):
    rng = random.Random(trial)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 3, 6]))]
    texts = [" ".join(rng.choice([*vocabulary, "z"]) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 80]))) for _ in range(rng.randint(0, 5))]
    if items:
        texts.append(f"x {items[-1]} y {items[0]}")
    window = rng.choice([3, 10, 70])
    block = Items.of([str(i) for i in range(len(items))], items, window)
    shard = Shard(block, *hashed_words(pa.array(texts), NON_WORDS))
    which, place = shard.occurrences()
    got = set()
    for w, p in zip(which, place):
        text = int(shard.text_of[p])
        for i in block.window_items[block.item_bounds[w] : block.item_bounds[w + 1]]:
            got.add((text, int(p - shard.begins[text]), int(block.windows[w, -1]), int(i)))
    want, parts = set(), [words(t) for t in texts]
    for i, item in enumerate(items):
        x = item.split()
        k = min(window, len(x))
        for j in range(len(x) - k + 1 if k else 0):
            for d, y in enumerate(parts):
                want |= {(d, a, k, i) for a in range(len(y) - k + 1) if y[a : a + k] == x[j : j + k]}
    assert got == want
    lengths, _ = shard.longest()
    for q in range(len(block.words)):
        x = items[block.item[q]].split()
        x, best = x[block.inner[q] :], 0
        for y in parts:
            for a in range(len(y)):
                n = 0
                while n < len(x) and a + n < len(y) and x[n] == y[a + n]:
                    n += 1
                best = max(best, n)
        assert lengths[q] == best or best < block.lead


def rows_of(spark, docs, items, window=10):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return d, b, sorted(map(tuple, decontamination.contamination(d, b, window).drop("items", "places").collect()), key=str)


def test_contamination_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 200)  # several blocks of items
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 50)
    rng = random.Random(9)
    base = [f"Tok{i}" for i in range(40)] + ["é", "naïve"]
    items = [(i % 7 if i else None, " ".join(rng.choice(base) for _ in range(rng.choice([0, 2, 9, 10, 25])))) for i in range(14)] + [(3, None), (4, "")]
    docs = [(i, " ".join(rng.choice(base) for _ in range(rng.randint(0, 60))) + "; " + (items[i % 14][1] or "").upper().replace("É", "é").replace("Ï", "ï")) for i in range(30)]
    docs += [(None, "x"), (5, None), (6, ""), docs[3], docs[3], (99, " ".join(t or "" for _, t in items) * 30)]
    d, b, got = rows_of(spark, docs, items)
    assert got == sorted(brute(docs, items, 10), key=str)
    left = decontamination.decontaminated(d, b, 10)
    assert left.columns == d.columns
    clean = [(i, t) for (i, t), row in zip(docs, brute(docs, items, 10)) if not row[-1]]
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame(clean, "doc_id long, text string").collect()))


def test_empty_tables(spark):
    assert rows_of(spark, [], [(1, "a b")])[2] == []
    assert rows_of(spark, [(1, "a b")], [])[2] == brute([(1, "a b")], [], 10)


def test_longest_match_across_shards(spark):
    item = " ".join(f"q{i}" for i in range(100))
    docs = [(1, "x " + " ".join(f"q{i}" for i in range(20, 90))), (2, item), (3, "q5 q6")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = {r.first_word: r for r in decontamination.longest_matches(d.repartition(3), b).collect()}
    assert (rows[0].length, rows[0].doc_id, rows[0].at_word) == (100, 2, 0)
    assert (rows[30].length, rows[30].doc_id) == (70, 2)
    assert np.all([rows[k].length == 100 - k for k in range(90)])


def test_long_windows_places_and_ends_of_items(spark):
    item = [f"q{i}" for i in range(100)]
    docs = [(1, " ".join(["x", *item[:85], "y", *item[10:95]])), (2, " ".join(item[91:])), (3, " ".join(item[:79]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))] * 3, "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(d, b, 80).collect()}
    assert [tuple(p) for p in rows[1].places] == [(1, 85), (87, 85)] and rows[1].n_hit == 170
    assert rows[2].places == [] and not rows[2].contaminated and not rows[3].contaminated
    found = {r.first_word: r for r in decontamination.longest_matches(d.where("doc_id = 2"), b).collect()}
    assert {k: r.length for k, r in found.items()} == {k: 100 - k for k in range(91, 97)}  # from four words


def test_many_copies_of_a_long_match(spark):
    item = " ".join(f"q{i}" for i in range(200))
    d = spark.createDataFrame([(i, item + f" q{i}") for i in range(300)] + [(300, item)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item + " q42")], "item_id long, text string")
    rows = {r.first_word: r for r in decontamination.longest_matches(d, b).collect()}
    assert (rows[0].length, rows[0].doc_id, rows[0].at_word) == (201, 42, 0)
    assert (rows[150].length, rows[150].doc_id) == (51, 42)
