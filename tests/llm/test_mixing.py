import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows, weights=(5, 2, 1), epochs=3):
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, free, target = sum(sizes.values()), set(names), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: epochs * sizes[s] for s in over}
        free -= over
    taken = []
    for s in names:
        whole = min(epochs, math.floor(target[s] / sizes[s] + 1e-12)) if sizes[s] else 0
        rest = math.floor(target[s] + 1e-9) - whole * sizes[s]
        key = lambda r: (int(hashlib.md5(f"17:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:6], 16), r[0] or 0, size(r[1]))
        for doc_id, text, _ in sorted((r for r in rows if r[2] == s), key=key):
            n = size(text)
            part = max(0, min(n, rest))
            rest -= part
            taken.append((doc_id, n, sizes[s], round(target[s], 6), whole * n + part))
    return sorted(taken, key=str)


ROWS = [(i, " ".join(["w"] * (1 + i * 7 % 40)), f"s{i % 5}") for i in range(200)]
ROWS += [(300 + i, "a b\tc\n\x85 d", None) for i in range(20)] + [(400, None, "s1"), (401, "", "only"), (402, "  \n", "S9"), (403, "x", "Z"), ROWS[3], (None, "q q", "s2")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, size string, n_chars int")


def test_equals_water_filling_by_hand(spark):
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(frame(spark, ROWS)).collect()]
    assert sorted(got, key=str) == brute(ROWS)


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "x y z", "a")], [(1, "x", "a"), (2, "y " * 500, "b"), (3, "z", "c"), (4, "u", None)]])
def test_small_and_empty(spark, rows):
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == (brute(rows) if rows else [])


def test_repeated_rows_have_the_words_that_the_mix_takes(spark):
    docs = frame(spark, ROWS)
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    want = {}
    for doc_id, _, _, _, taken in brute(ROWS):
        if taken:
            want[doc_id] = want.get(doc_id, 0) + taken
    assert words == want


def test_reruns_and_partitions_agree(spark):
    docs = frame(spark, ROWS)
    first, second = (sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (docs, docs.repartition(7, F.rand(1))))
    assert first == second
