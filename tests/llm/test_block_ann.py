import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import block_ann

SCHEMA = "vec_id long, embedding array<float>, rank int, distance string"


def brute(rows, k):
    ok = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = min(ok.get(i, v), v)
    out = set()
    for q, a in ok.items():
        if q % 100:
            continue
        near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))), i) for i, b in ok.items() if i != q and len(a) == len(b))
        out |= {(q, n, i, round(d, 9)) for n, (d, i) in enumerate(near[:k], 1)}
    return out


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(block_ann, "QUERY_ROWS", 4)
    monkeypatch.setattr(block_ann, "TILE_ROWS", 64)


def got(spark, rows, k=10):
    df = spark.createDataFrame(rows, SCHEMA)
    found = block_ann.nearest(df, df.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", k)
    assert found.columns == ["query_id", "rank", "id", "distance"]
    return {(r[0], r[1], r[2], round(r[3], 9)) for r in found.collect()}


def test_equals_brute_force_with_ties_and_copies(spark):
    rng = random.Random(1)
    vector = lambda: [float(rng.randint(-3, 3)) / 4 for _ in range(6)]
    same = [0.5] * 6
    rows = [(i, same if i % 3 == 0 else vector(), 1, "x") for i in range(450)]
    rows += rows[:5] + [(451, None, 1, "x"), (452, [0.0] * 6, 1, "x"), (453, [1.0, None] * 3, 1, "x"), (500, [float("nan")] * 6, 1, "x")]
    rows += [(None, same, 1, None), (600, [float("inf")] + [1.0] * 5, 1, "x"), (700, [1.0, 2.0], None, "x"), (701, [1.0, 2.5], None, "x"), (100, [9.0] * 6, 1, "x")]
    assert got(spark, rows) == brute(rows, 10)


def test_few_vectors_and_empty_table(spark):
    assert got(spark, []) == set()
    rows = [(0, [1.0, 0.0], 1, ""), (100, [1.0, 1.0], 1, ""), (7, [3.0, 3.0], 1, "")]
    assert got(spark, rows) == brute(rows, 10)


def test_bounds_hold_for_wide_and_large_numbers(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 10 ** rng.randint(-3, 4)) for _ in range(1200)], 1, "") for i in range(101)]
    df = spark.createDataFrame(rows, SCHEMA)
    rows = [tuple(r) for r in df.collect()]
    found = block_ann.nearest(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding", 3).collect()
    assert {(r[0], r[1], r[2]) for r in found} == {x[:3] for x in brute(rows, 3)}
