import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import periodic_runs
from plumbline.llm.queries import op11_periodic_runs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w, exponent=4, least=6):
    """Every period by itself; a stretch counts if no smaller period holds for it."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, exponent * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, q, e - s))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(w, runs):
    drop = {k for s, q, n in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in drop)


def texts(seed, n):
    rng = random.Random(seed)
    out = ["a " * 40, "a", "a a a a a", "a a a a a a", "ab ab ab ba", "x y " * 9 + "x", "x y " * 9 + "y", ("p q r " * 5 + "p q s ") * 6, "A a " * 7]
    for _ in range(n):
        w = []
        for _ in range(rng.randint(1, 5)):
            base = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            w += base * rng.randint(1, 8)
            w += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        if rng.random() < 0.3:
            w = w * rng.randint(2, 5)
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return out


@pytest.mark.parametrize(("block", "exponent"), [(1 << 20, 4), (16, 4), (8, 3), (64, 5)])
def test_runs_equal_brute_force(spark, monkeypatch, block, exponent):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)  # small blocks: fragments are stitched after the shuffle
    monkeypatch.setattr(periodic_runs, "STEP", 64)
    rows = [*enumerate(texts(block, 60), 1), (None, None), (0, ""), (0, " \n"), (7, "a b " * 6), (7, "a b " * 6), (None, "z " * 9), (8, "é ü " * 5)]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n int, ref string").repartition(4)
    got = [(r.doc_id, r.n, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs, exponent).collect()]
    want = []
    for i, t in rows:
        w = words(t)
        runs = plain_runs(w, exponent)
        want.append((i, len(w), runs, collapsed(w, runs)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(len(r[2]) for r in want) > 40


def test_an_empty_table_and_a_long_text(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(30_011)]
    text = " ".join([*base, *(base[:20_011] * 5), *["same"] * 50_000])
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [tuple(r) for r in row.runs] == [(30_011, 20_011, 100_055), (130_066, 1, 50_000)] and row.n == 180_066
    assert row.collapsed == " ".join([*base, *base[:20_011], "same"])


def plain_row(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    top = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    head = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *head, digest("".join(f"{s},{n},{q}\n" for s, q, n in runs)), digest(collapsed(w, runs)))


def test_the_query_equals_brute_force(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts(9, 150))] + [(k, None if k % 20 == 0 else "one two three four five six " * (k % 4)) for k in range(200, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_periodic_runs(spark, str(tmp_path))
    assert out.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert sorted(map(tuple, out.collect())) == sorted(plain_row(*r) for r in rows)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 20


def test_fragments_of_two_documents_do_not_touch():
    flat = np.array([5] * 12 + [6] * 12, np.uint64)
    doc, period, lo, hi = periodic_runs.fragments(flat, np.array([0, 12, 24]), 4)
    assert sorted(zip(doc.tolist(), period.tolist(), lo.tolist(), hi.tolist())) == [(0, 1, 0, 11), (1, 1, 0, 11)]
