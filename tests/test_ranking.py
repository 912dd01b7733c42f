import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels
from plumbline.operators import evaluate as ev
from plumbline.operators import remediate as rm
from plumbline.operators.similarity import pipeline as pl
from plumbline.operators.uniqueness import uniqueness_issues


def trigrams(v):
    s = f"##{v}##"
    return {s[i : i + 3] for i in range(len(s) - 2)}


def containment(a, b):
    x, y = trigrams(a), trigrams(b)
    return len(x & y) / min(len(x), len(y))


def blocks_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdxyz") for _ in range(rng.randint(2, 8)))
    values = sorted({f"{word()} {word()}"[: rng.randint(2, 14)].strip() for _ in range(60)} | {"q", "jjj", "kkk", "mmm", "nnn"})
    members = [(v, f"b{rng.randint(0, 5)}") for v in values for _ in range(2)] + [(v, "apart") for v in ("jjj", "kkk", "mmm", "nnn")] + [("q", "alone")]
    return values, sorted(set(members))


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_pairs_of_every_block_without_a_floor(spark, k):
    values, members = blocks_of(k)
    want = []
    for block in sorted({b for _, b in members}):
        own = sorted(v for v, b in members if b == block)
        pairs = sorted(itertools.combinations(own, 2), key=lambda p: (-containment(*p), p))
        want += [(block, n, *p, round(containment(*p), 9)) for n, p in enumerate(pairs[:k], 1)]
    found = pl.ranked_in_blocks(spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame(members, "v string, block string"), k)
    got = sorted((r.block, r.rank, r.a, r.b, round(r.containment, 9)) for r in found.collect())
    assert got == sorted(want)
    assert any(r[0] == "apart" and r[4] == 0 for r in got)


def test_best_pairs_of_a_table_are_filled_with_pairs_without_a_trigram(spark):
    values = ["aaaa", "aaab", "ccc", "ddd", "eee"]
    got = [(r.a, r.b) for r in pl.best_pairs(spark.createDataFrame([(v,) for v in values], "v string"), 4).collect()]
    assert got == [("aaaa", "aaab"), ("aaaa", "ccc"), ("aaaa", "ddd"), ("aaaa", "eee")]


def test_a_cap_lowers_score_and_reliability(spark):
    names = [f"{w} {k}{t}" for k, w in enumerate(["alpha company", "beta company", "gamma company", "delta company"] * 6) for t in ("", "x")]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    whole = pl.near_duplicates(rows, "id", "name", algorithm="qgrams", threshold=70)
    capped = pl.near_duplicates(rows, "id", "name", algorithm="qgrams", threshold=70, cap=3, per_block=5)
    report = capped.report.first()
    sizes = capped.block_members.groupBy("block").count().collect()
    assert report.generated == sum(r["count"] * (r["count"] - 1) // 2 for r in sizes) and report.evaluated == 3 and report.partial
    meta = capped.meta().first()
    assert meta.reliability == "unreliable" and meta.score <= max(50.0, 100 - report.discarded_pct)
    assert not whole.meta().first().partial and capped.pairs.count() <= 3


def test_elections_do_not_depend_on_positions(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "a", None), (3, "b", "y"), (4, "c", "z"), (4, "c", "z"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, other string")
    want = None
    for part in (df, df.repartition(7), df.repartition(3, "other")):
        got = sorted(map(str, uniqueness_issues(part, "id", "name").select("record_id", "value", "is_principal").collect()))
        want = want or got
        assert got == want
    kept = uniqueness_issues(df, "id", "name").where("is_principal").groupBy("value").count().collect()
    assert {(r.value, r["count"]) for r in kept} == {("a", 1), ("c", 1), (None, 1)}
    same = spark.createDataFrame([(7, "Juan Perez", "p"), (7, "Juan Perez", "p"), (8, "Juan Peres", None)], "id long, name string, other string")
    groups = pl.near_duplicates(same.repartition(3), "id", "name", threshold=80).groups()
    assert sorted((r.record_id, r.is_principal) for r in groups.collect()) == [(7, False), (7, True), (8, False)]


def test_fingerprint_is_of_a_multiset(spark):
    meta = spark.createDataFrame([(90.0, 3)], "score double, n long")
    table = lambda *xs: spark.createDataFrame([(x,) for x in xs], "v string")
    of = lambda df, m=meta: tuple(ev.fingerprint(df, m).first())
    assert of(table("A", "A")) != of(table("B", "B")) and of(table("A", "A", "B", "B")) != of(table("C", "C", "D", "D"))
    assert of(table("A", "B", "C").repartition(3)) == of(table("C", "A", "B"))
    assert of(table("A"), meta.withColumn("score", F.lit(80.0))) != of(table("A"))
    assert of(table("A").where("false"))[0] == 0


def test_one_row_an_id_from_the_reported_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, "y"), (3, "z"), (3, "w"), (4, "v"), (None, "n"), (None, "m")], "id long, name string")
    columns = "record_id long, column string, dimension string, is_principal boolean"
    issues = [(1, "id", "uniqueness", False), (1, "id", "uniqueness", True), (3, "id", "uniqueness", False), (3, "id", "uniqueness", False),
              (4, "name", "uniqueness", False), (4, "id", "validity", False), (2, "id", "uniqueness", None)]
    got = rm.drop_duplicate_ids(df, "id", spark.createDataFrame(issues, columns)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "x"), (2, "y"), (4, "v"), (None, "m")], key=str)


def plain_flags(forms, values, ratio, limit):
    tokens = {v: {t for t in v.split(" ") if len(t) >= 3} for v in values}
    common = {t for ts in tokens.values() for t in ts if sum(t in x for x in tokens.values()) <= limit}
    out = []
    for e in sorted({e for e, _ in forms}):
        for a, b in itertools.combinations(sorted(v for x, v in forms if x == e), 2):
            shared = bool(tokens[a] & tokens[b] & common)
            out.append((e, a, b, a[:3] == b[:3], shared, min(len(a), len(b)) / max(len(a), len(b)) >= ratio))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_coverage_and_orphans_over_all_true_pairs(spark, seed):
    rng = random.Random(seed)
    forms = sorted({(rng.randint(0, 4) if rng.random() < 0.6 else 0, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4)))) for _ in range(90)})
    values = sorted({v for _, v in forms})
    f = spark.createDataFrame([*forms, (None, "orphaned form")], "entity long, v string")
    v = spark.createDataFrame([(x,) for x in values], "v string")
    got = {r.strategy: (r.proposed, r.covered, r.links) for r in ev.blocking_coverage(f, v, (0.25, 0.7), 6).collect()}
    for ratio in (0.25, 0.7):
        flags = plain_flags(forms, values, ratio, 6)
        assert got["prefix"][1:] == (sum(x[3] for x in flags), len(flags)) and got["token"][1] == sum(x[4] for x in flags)
        assert got[f"length_{ratio:g}"][1] == sum(x[5] for x in flags) and got[f"union_{ratio:g}"][1] == sum(any(x[3:]) for x in flags)
        pairs = [(a, b) for a, b in itertools.combinations(values, 2) if min(len(a), len(b)) / max(len(a), len(b)) >= ratio]
        assert got[f"length_{ratio:g}"][0] == len(pairs)
        lost = sorted(x[:3] for x in flags if not any(x[3:]))
        assert sorted(map(tuple, ev.orphans(f, v, ratio, 6).collect())) == lost and (ratio < 0.7 or lost)


@pytest.mark.parametrize("limit", [1, 12, 1024])
def test_small_blocks_are_ranked_without_a_join_of_trigrams(spark, monkeypatch, limit):
    values, members = blocks_of(5)
    values, members = [*values, "ñandú €", "ñandú 😀"], [*members, ("ñandú €", "b1"), ("ñandú 😀", "b1"), ("ñandú €", "pair"), ("ñandú 😀", "pair")]
    monkeypatch.setattr(kernels, "PAIRS", 50)
    if limit == 1024:  # before, the trigrams of every block were joined, which is many times the pairs of small blocks
        monkeypatch.setattr(pl.cand, "contained_in_blocks", None)
    want = []
    for block in sorted({b for _, b in members}):
        own = sorted(v for v, b in members if b == block)
        pairs = sorted(itertools.combinations(own, 2), key=lambda p: (-containment(*p), p))
        want += [(block, n, *p, containment(*p)) for n, p in enumerate(pairs[:7], 1)]
    table = spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame(members, "v string, block string")
    assert sorted(map(tuple, pl.ranked_in_blocks(*table, 7, limit).collect())) == sorted(want)


def test_blocks_go_on_from_batch_to_batch():
    rows = sorted((f"b{n % 5}", f"name {n * n % 97:02d}") for n in range(60))
    table = pd.DataFrame(sorted(set(rows)), columns=["block", "v"])
    run = kernels.ranked_blocks(4)
    whole = pd.concat(run(iter([table])), ignore_index=True)
    for step in (1, 7, 20):
        cut = [table.iloc[a : a + step] for a in range(0, len(table), step)]
        pd.testing.assert_frame_equal(pd.concat(run(iter([table.iloc[:0], *cut])), ignore_index=True), whole)
    assert whole.groupby("block").size().eq(4).all() and not list(run(iter([])))


def test_spellings_are_not_broadcast(spark, tmp_path):
    import catalog.queries  # noqa: F401  registers everything
    from catalog.base import QUERIES

    rows = [(n, f"hot ring {n}", f"Brand#{n % 4 + 1}") for n in range(12)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["sim_threshold"](spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("similarity = 100").count() > 0
