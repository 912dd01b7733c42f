import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels
from plumbline.operators.similarity import candidates as cand
from plumbline.operators.similarity import pipeline as pl
from plumbline.operators.similarity import values as val
from plumbline.operators.similarity.components import connected_components


def names(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, name string")


def run(spark, values, **params):
    return pl.near_duplicates(names(spark, values), "id", "name", **params)


COMPANY = [
    "Representaciones Valle Grande SAC", "Repres. Valle Grande S.A.C.", "Representaciones Valle Grande", "Minera Los Andes SA", "Textil Pacifico EIRL",
]


def test_company_group(spark):
    found = run(spark, COMPANY, algorithm="monge_elkan", threshold=80).meta().first()
    assert (found.groups, found.involved, found.surplus, found.score) == (1, 3, 2, 60.0)


def test_exact_repeats_alone_are_no_group(spark):
    found = run(spark, ["Juan Perez", "Juan Perez", "Maria Lopez"]).meta().first()
    assert (found.score, found.exact_duplicates, found.groups) == (100.0, 2, 0)


def test_placeholders_are_left_out(spark):
    found = run(spark, ["N/A", "  ", "-", "Sin dato", "Juan Perez"]).meta().first()
    assert (found.score, found.placeholders, found.evaluated) == (100.0, 4, 1)


def test_spellings_of_one_form_are_a_group(spark):
    found = run(spark, ["ACME S.A.C.", "acme sac", "Acme SAC", "Otra Cosa"]).groups().collect()
    assert len(found) == 3 and {r.similarity_pct for r in found} == {100.0} and {r.density for r in found} == {1.0}


def test_chain_is_dispersed(spark):
    chain = ["xyzabcd", "xyzabce", "xyzabde", "xyzacde", "qqqqqqqq"]
    found = run(spark, chain, algorithm="levenshtein", threshold=80, normalise=False).meta().first()
    assert found.groups == 0 and found.dispersed_groups >= 1 and found.score < 100 and found.reliability == "unreliable"


def test_unknown_algorithm_is_an_error(spark):
    with pytest.raises(ValueError):
        run(spark, COMPANY, algorithm="tfidf")


def random_names(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 9)))
    out = []
    for _ in range(n):
        base = " ".join(word() for _ in range(rng.randint(1, 4)))
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            letters = list(base)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(letters))
                kind = rng.random()
                if kind < 0.4:
                    letters[i] = rng.choice("abcdeilmnorst")
                elif kind < 0.7 and len(letters) > 2:
                    del letters[i]
                else:
                    letters.insert(i, rng.choice("aeio "))
            out.append("".join(letters).strip())
    return sorted({" ".join(v.split()) for v in out if v.strip()})


@pytest.mark.parametrize(
    "algorithm,threshold",
    [("jaro", 82), ("jaro_winkler", 86), ("jaro_winkler", 92), ("levenshtein", 70), ("qgrams", 50), ("soundex", 60), ("cosine", 55),
     ("monge_elkan", 84), ("monge_elkan", 92), ("smith_waterman", 80), ("affine_gap", 78), ("affine_gap", 88),
     ("jaro", 60), ("jaro", 30), ("jaro_winkler", 70), ("jaro_winkler", 60), ("monge_elkan", 70), ("monge_elkan", 55),
     ("levenshtein", 86), ("levenshtein", 45), ("smith_waterman", 55), ("affine_gap", 50)],
)
def test_candidate_joins_lose_no_pair(spark, algorithm, threshold):
    """Every pair of the brute-force comparison is found, by the same score."""
    values = random_names(45, 11)
    table = spark.createDataFrame([(v,) for v in values], "v string")
    found = {(r.a, r.b) for r in pl.scored_pairs(table, algorithm, threshold).collect()}
    every = spark.createDataFrame(list(itertools.combinations(values, 2)), "a string, b string")
    scored = every.withColumn("s", pl.score_of(algorithm, F.col("a"), F.col("b")))
    assert found == {(r.a, r.b) for r in scored.where(F.col("s") >= threshold).collect()}


def test_blocked_run_equals_walking_through_all_blocks(spark):
    values = random_names(60, 3)
    table = spark.createDataFrame([(v, 1) for v in values], "v string, spellings bigint")
    blocks = val.with_blocks(table, 20)
    members = {}
    for r in val.split_blocks(table, 20).collect():
        members.setdefault(r.block, set()).add(r.v)
    near = {p for m in members.values() for p in itertools.combinations(sorted(m), 2)}
    for algorithm, threshold in (("qgrams", 50), ("jaro_winkler", 88), ("levenshtein", 75)):
        found = {(r.a, r.b) for r in pl.scored_pairs(table, algorithm, threshold, blocks).collect()}
        free = {(r.a, r.b) for r in pl.scored_pairs(table, algorithm, threshold).collect()}
        assert found == free & near
    assert val.visited_pairs(val.split_blocks(table, 20)).first()[0] == sum(len(m) * (len(m) - 1) // 2 for m in members.values())


def test_hot_token_and_repeated_value(spark):
    """A third of the rows hold one value and every value shares a word; results stay whole."""
    values = ["comercial andina norte"] * 300 + [f"comercial {w}" for w in random_names(120, 5)] + ["comercial andina nortE."]
    made = run(spark, values, algorithm="qgrams", threshold=86)
    metrics = made.record_metrics().first()
    assert metrics.pairs_over_threshold >= 300
    group = made.groups().where("value like 'comercial andina%'").select("group_id", "members").distinct().collect()
    assert len(group) == 1 and group[0].members >= 301


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(180)} | {(i, i + 1) for i in range(400, 460)}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    found = connected_components(spark.createDataFrame(list(edges), "a bigint, b bigint")).collect()
    assert {r.v: r.component for r in found} == {x: root(x) for x in parent}


def test_raising_the_threshold_never_adds_pairs(spark):
    values = random_names(40, 9)
    low = run(spark, values, algorithm="jaro_winkler", threshold=85).record_metrics().first()
    high = run(spark, values, algorithm="jaro_winkler", threshold=94).record_metrics().first()
    assert high.pairs_over_threshold <= low.pairs_over_threshold and high.records_with_pair <= low.records_with_pair


def test_row_order_does_not_matter(spark):
    from plumbline.operators.evaluate import fingerprint

    values = random_names(30, 4)
    df = names(spark, values)
    prints = {
        tuple(fingerprint(pl.near_duplicates(t, "id", "name", algorithm="qgrams", threshold=70).groups()).first())
        for t in (df, df.orderBy(F.desc("id")), df.repartition(3))
    }
    assert len(prints) == 1


def test_alignment_kernels():
    assert kernels.smith_waterman_batch(["abc"], ["zzabczz"])[0] == 1.0
    assert kernels.affine_gap_batch(["abcdefgh"], ["abcdefgh"])[0] == 1.0
    assert kernels.affine_gap_batch(["ab"], ["abcdefghijk"])[0] == 0.0
    assert abs(kernels.affine_gap_batch(["abef"], ["abcdef"])[0] - (8 - 1.1) / 8) < 1e-9
    assert kernels.jaro_batch(["abc"], ["xyz"], True)[0] == 0.0


def test_sweep_marks_one_best_row_per_algorithm(spark):
    from plumbline.operators.evaluate import threshold_sweep

    df = spark.createDataFrame([(1, "valle grande"), (1, "valle grandes"), (2, "otra cosa"), (3, "nada igual")], "e bigint, name string")
    rows = threshold_sweep(df, "name", "e", ["levenshtein", "qgrams"], [60, 80]).collect()
    assert sum(r.best for r in rows) == len({r.algorithm for r in rows}) == 2
    assert any(r.f1 == 1.0 for r in rows)


def test_sweep_has_a_row_for_every_threshold(spark):
    from plumbline.operators.evaluate import threshold_sweep

    df = spark.createDataFrame([(1, "gamma delta one", 1), (2, "gamma delta two", 1), (3, "unlike", 2)], "id int, name string, entity int")
    rows = {r.threshold: r for r in threshold_sweep(df, "name", "entity", ["qgrams"], [30, 60, 99]).collect()}
    assert set(rows) == {30, 60, 99} and rows[99].detected == 0 and rows[99].f1 == 0.0


def test_default_run_does_not_depend_on_other_rows(spark):
    few = [(1, "comercial andina norte"), (2, "comercial andina nort"), (3, "servicios del sur")]
    more = few + [(100 + i, f"comercial distinta numero {i} {i * 7919 % 1000}") for i in range(300)]
    found = [
        {(r.a, r.b) for r in pl.near_duplicates(spark.createDataFrame(rows, "id int, name string"), "id", "name", threshold=97).pairs.collect()} for rows in (few, more)
    ]
    assert found[0] <= found[1] and found[0]


def test_edits_leave_their_tiles_only_when_similar(spark):
    """Names with common words: a pair below the threshold is no candidate, so it is neither shuffled nor counted."""
    values = [f"{w} comercial andina" for w in random_names(40, 21)]
    table = spark.createDataFrame([(v,) for v in values], "v string")
    for algorithm, threshold in (("levenshtein", 80), ("smith_waterman", 86), ("affine_gap", 90)):
        found = [(r.a, r.b) for r in pl.candidate_pairs(table, algorithm, threshold).collect()]
        scored = spark.createDataFrame(list(itertools.combinations(sorted(values), 2)), "a string, b string").withColumn("s", pl.score_of(algorithm, F.col("a"), F.col("b")))
        assert sorted(found) == sorted((r.a, r.b) for r in scored.where(F.col("s") >= threshold - 1e-6).collect())


def test_strips_of_a_tile_miss_no_pair(monkeypatch):
    values = random_names(40, 8)
    whole = list(kernels.edits_allow(values, values, 0.7, "levenshtein"))[0][1]
    monkeypatch.setattr(kernels, "STRIP", 7)
    assert (whole == np.concatenate([a for _, a in kernels.edits_allow(values, values, 0.7, "levenshtein")])).all()


def test_exploded_keys_are_not_broadcast(spark):
    """Spark takes an exploded table to be as small as before; only the frequent tokens, which are bounded, are broadcast."""
    table = spark.createDataFrame([(v,) for v in random_names(30, 2)], "v string")
    for pairs in (cand.trigram_pairs(table, 0.5), cand.trigram_pairs(table, 0.65, "containment"), pl.scored_pairs(table, "qgrams", 70), pl.scored_pairs(table, "cosine", 60)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert joins and all("SortMergeJoin" in j or "LeftOuter, BuildRight" in j for j in joins), joins


def test_parities_differ_in_no_more_bits_than_sets_in_tokens(spark):
    values = random_names(40, 6)
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", cand.padded_trigrams(F.col("v")).alias("t"))
    rows = rows.withColumn("bits", cand.parity(F.col("t")))
    both = rows.alias("x").crossJoin(rows.alias("y")).select(
        cand.differing("x.bits", "y.bits").alias("bits"), (F.size("x.t") + F.size("y.t") - 2 * F.size(F.array_intersect("x.t", "y.t"))).alias("tokens")
    )
    assert both.where("bits > tokens").isEmpty() and not both.where("bits > 20").isEmpty()


def test_contained_pairs_leave_the_join_only_when_their_parities_allow(spark):
    starts = [f"{w}{n:02d}" for n, w in enumerate(random_names(30, 4))]
    values = [f"{w} {tail}" for w in (x.replace(" ", "")[:7] + x[-2:] for x in starts) for tail in ("qwertyuiopaslk", "dfghjklzxcvbnm")]
    values = sorted({*values, *(v + "x" for v in values[:6]), "", "a", "#", "####", *random_names(20, 9)})
    table = spark.createDataFrame([(v,) for v in values], "v string")
    every = spark.createDataFrame(list(itertools.combinations(values, 2)), "a string, b string")
    ta, tb = cand.padded_trigrams(F.col("a")), cand.padded_trigrams(F.col("b"))
    for floor in (0.65, 0.3, 1e-6):
        want = {(r.a, r.b) for r in every.where(cand.containment(ta, tb) >= floor).collect()}
        found = {(r.a, r.b) for r in cand.containment_pairs(cand.trigram_sets(table), floor).collect()}
        assert want <= found
        if floor == 0.65:  # before, all pairs with the same first word left the join
            assert want and len(found) < len(want) + 15, (len(found), len(want))


def test_soundex_pairs_leave_the_join_once_and_only_when_similar(spark):
    values = [f"{w} comercial andina" for w in random_names(40, 23)] + ["lima", "lima lima", "callao"]
    table = spark.createDataFrame([(v,) for v in values], "v string")
    every = spark.createDataFrame(list(itertools.combinations(sorted(values), 2)), "a string, b string").withColumn("s", pl.score_of("soundex", F.col("a"), F.col("b")))
    for threshold in (75, 50, 25):
        pairs = pl.candidate_pairs(table, "soundex", threshold)
        assert sorted((r.a, r.b) for r in pairs.collect()) == sorted((r.a, r.b) for r in every.where(F.col("s") >= threshold).collect())
        assert "Exchange hashpartitioning(a" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_coverage_normalises_names_once(spark):
    """Its tables are counted in many ways; the plan reads stored forms, not the raw names."""
    from plumbline.operators import evaluate as ev

    df = spark.createDataFrame([(1, "valle grande"), (1, "valle grandes"), (2, "otra cosa")], "e bigint, name string")
    out = ev.blocking_coverage(ev.value_entities(df, "name", "e"), val.nodes(val.raw_values(df, "name")).select("v"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and {r.links for r in out.collect()} == {1}


def broadcast_joins(*frames):
    """Joins that send a table through the driver, but for the most frequent tokens (joined on t), which are bounded."""
    joins = [line for df in frames for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins
    return [j for j in joins if "SortMergeJoin" not in j and not re.search(r"BroadcastHashJoin \[t#\d+L?\], \[t#\d+L?\], LeftOuter, BuildRight", j)]


@pytest.mark.parametrize("name", ["sim_candidate_pairs", "eval_exhaustive", "sim_trigram_jaccard", "sim_components"])
def test_tables_of_a_query_are_merged(spark, tmp_path, monkeypatch, name):
    """Also those joined in steps that are stored before the query returns."""
    from catalog.base import QUERIES
    import catalog.queries  # noqa: F401
    from plumbline.operators import evaluate as ev
    from plumbline.operators.similarity import components

    spark.range(60).selectExpr("id AS p_partkey", "concat('ruedas ', id % 7) AS p_name", "concat('Brand#', 1 + id % 5) AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    stored = []
    for module in (pl, ev, components):
        kept = module.checkpointed
        monkeypatch.setattr(module, "checkpointed", lambda df, kept=kept: stored.append(df) or kept(df))
    out = QUERIES[name](spark, str(tmp_path))
    assert broadcast_joins(out, *[df for df in stored if "Join" in df._jdf.queryExecution().executedPlan().toString()]) == []


@pytest.fixture(scope="module")
def small_run(spark, tmp_path_factory):
    rows = [(i, i % 9, v) for i, v in enumerate([*COMPANY, *(v + tail for v in random_names(12, 31) for tail in ("", "s", " SAC"))])]
    folder = f"{tmp_path_factory.mktemp('run')}/rows"
    spark.createDataFrame(rows, "id bigint, entity bigint, name string").write.parquet(folder)  # Spark takes rows of its own to be many
    return pl.near_duplicates(spark.read.parquet(folder), "id", "name", algorithm="qgrams", threshold=80)


@pytest.mark.parametrize("step", ["record_metrics", "score", "detected_pairs", "fingerprint", "precision_recall", "drop_surplus", "density", "groups"])
def test_tables_of_a_run_are_merged(small_run, step):
    """Values, links, groups, members and records to drop all grow with the data, whatever Spark takes their size to be."""
    from plumbline.operators import evaluate as ev
    from plumbline.operators import remediate as rm

    run_ = small_run
    out = {
        "record_metrics": lambda: run_.record_metrics(),
        "score": lambda: run_.meta(),
        "detected_pairs": lambda: ev.group_pairs(run_.groups(), "group_id"),
        "fingerprint": lambda: ev.fingerprint(run_.groups().select("record_id", "group_id", "similarity_pct", "is_principal"), run_.meta().select("evaluated", "groups", "surplus", "score", "reliability")),
        "precision_recall": lambda: ev.precision_recall(run_.df, "id", "entity", run_.groups().select("record_id", "group_id")),
        "drop_surplus": lambda: rm.drop_surplus(run_.df, "id", run_.issues(), "name"),
        "density": lambda: run_.group_stats,
        "groups": lambda: run_.groups(),
    }[step]()
    assert broadcast_joins(out) == []


def test_surplus_of_a_stored_report_is_merged(spark, small_run, tmp_path):
    """Its file is small, its records are not."""
    from plumbline.operators import remediate as rm

    small_run.issues().write.parquet(f"{tmp_path}/issues")
    left = rm.drop_surplus(small_run.df, "id", spark.read.parquet(f"{tmp_path}/issues"), "name")
    assert broadcast_joins(left) == []
    assert sorted(left.collect()) == sorted(rm.drop_surplus(small_run.df, "id", small_run.issues(), "name").collect())
    assert 0 < left.count() < small_run.df.count()
