import pytest
from pyspark.sql import functions as F

from plumbline.operators import consistency, outliers, uniqueness
from plumbline.operators.rules import Rule, compile_rule, row_issues, row_scores
from plumbline.plans.analysis import Analysis


def table(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id bigint, x {kind}")


def score(spark, values, rule, kind="string"):
    df = table(spark, values, kind)
    return Analysis(df, "id", [rule]).scores().first()


def test_completeness(spark):
    row = score(spark, [None, "b", None, "d"], Rule.of("x", "completeness"))
    assert (row.score, row.n_bad) == (50.0, 2)
    assert score(spark, [float("nan"), 1.0], Rule.of("x", "completeness"), "double").n_bad == 1


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        Rule.of("x", "beauty")
    with pytest.raises(ValueError):
        Rule.of("x", "accuracy", minimum=3)
    with pytest.raises(ValueError):
        Analysis(table(spark, ["a"]), "id", [Rule.of("y", "completeness")])


def test_rules_without_parameters_and_empty_tables_score_100(spark):
    assert score(spark, ["a"], Rule.of("x", "validity")).score == 100.0
    assert score(spark, [], Rule.of("x", "completeness")).score == 100.0
    assert score(spark, ["a"], Rule.of("x", "referential_integrity")).score == 100.0


def test_row_rules(spark):
    assert score(spark, ["a", "b", None], Rule.of("x", "validity", allowed_values=["a"])).n_bad == 1
    assert score(spark, ["12", "12\n", "x"], Rule.of("x", "validity", pattern=r"\d+")).n_bad == 2
    assert score(spark, ["5", "-1", "abc", None], Rule.of("x", "accuracy", min_value=0)).n_bad == 1
    assert score(spark, ["1.5", "1.55", "word", None], Rule.of("x", "precision", decimals=1)).n_bad == 2
    assert score(spark, ["ab", "abcdef"], Rule.of("x", "precision", max_length=3)).n_bad == 1
    dates = ["2024-01-05", "31/12/2019", "soon", None]
    assert score(spark, dates, Rule.of("x", "validity_period", date_from="2020-01-01")).n_bad == 1
    assert score(spark, dates, Rule.of("x", "timeliness", max_age_days=365, as_of="2024-06-01")).n_bad == 1


def test_long_lists_become_joins(spark):
    values = [str(i) for i in range(3000)]
    rule = Rule.of("x", "validity", allowed_values=values[:2000])
    run = Analysis(table(spark, values + [None]), "id", [rule])
    assert run.scores().first().n_bad == 1000
    assert run.issues().count() == 1000


def test_rules_share_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, ["1", "2", None]).write.parquet(path)
    df = spark.read.parquet(path)
    rules = [Rule.of("x", "completeness"), Rule.of("x", "accuracy", min_value=2), Rule.of("x", "precision", max_length=1)]
    checks = [compile_rule(df, r) for r in rules]
    for frame in (row_issues(df, "id", checks), row_scores(df, checks)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Python" not in plan


def test_uniqueness(spark):
    assert uniqueness.uniqueness_scores(table(spark, ["x", "x", "a", "b", "c"]), "x").first().score == 60.0
    assert uniqueness.uniqueness_scores(table(spark, [None, None]), "x").first().score == 0.0


def test_one_principal_per_group_even_for_equal_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (10, "b")], "id bigint, x string")
    kept = uniqueness.uniqueness_issues(df, "id", "x").where("is_principal").groupBy("value").count().collect()
    assert {r.value: r["count"] for r in kept} == {"a": 1, "b": 1}


def test_consistency_cases(spark):
    dates = ["2024-01-15"] * 90 + ["15/01/2024"] * 10
    found = consistency.consistency_scores(table(spark, dates), "id", "x").first()
    assert (found.n_bad, found.score) == (10, 90.0)
    phones = ["987654321"] * 85 + ["+51 987654321"] * 5 + ["51-987-654321"] * 5 + ["(01) 4567890"] * 5
    found = consistency.consistency_scores(table(spark, phones), "id", "x").first()
    assert (found.n_bad, found.score) == (15, 85.0)
    assert consistency.consistency_scores(table(spark, ["O'Brien"] * 3 + ["JO"]), "id", "x").first().n_bad == 1
    assert consistency.consistency_scores(table(spark, ["$5", "7"]), "id", "x").first().n_bad == 1


def test_iqr(spark):
    df = table(spark, [10.0] * 8 + [10000.0], "double")
    assert outliers.iqr_scores(df, "x", outliers.fences(df, "x")).first().n_bad == 1
    flat = table(spark, [1.0, 1.0], "double")
    assert outliers.iqr_scores(flat, "x", outliers.fences(flat, "x")).first().score == 100.0


@pytest.mark.parametrize("shape", ["spread", "ties", "two"])
def test_exact_quantiles_by_narrowing(spark, shape):
    import numpy as np

    rng = np.random.default_rng(5)
    data = {
        "spread": rng.normal(size=3000),
        "ties": rng.integers(0, 4, size=3000).astype(float),
        "two": np.array([1.0] * 1000 + [2.0] * 2000),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    found = outliers.exact_quantiles(df, ["x"], probabilities, held=50)["x"]
    assert np.allclose(found, np.quantile(data, probabilities))


def test_forest_flags_planted_extremes_in_any_row_order(spark):
    from plumbline.operators.forest import forest_run

    rows = [(i, float(i % 10), float(i % 7), float(i % 5)) for i in range(100)] + [(900, 500.0, -400.0, 300.0), (901, -300.0, 900.0, -80.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    first = forest_run(df, "id", "a", ["a", "b", "c"]).flagged().select("record_id").collect()
    again = forest_run(df.orderBy(F.desc("id")).repartition(3), "id", "a", ["a", "b", "c"]).flagged().select("record_id").collect()
    ids = {r.record_id for r in first}
    assert {900, 901} <= ids and ids == {r.record_id for r in again} and len(ids) <= 7
    assert forest_run(df, "id", "a", ["a"]) is None


def test_stream_rules(spark, tmp_path):
    from plumbline.streaming.rules_stream import stream_issues, write_stream_issues

    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    table(spark, ["1", None, "-4"]).write.parquet(source)
    stream = spark.readStream.schema("id bigint, x string").parquet(source)
    rules = [Rule.of("x", "completeness"), Rule.of("x", "accuracy", min_value=0)]
    write_stream_issues(stream_issues(stream, "id", rules), sink, state).awaitTermination()
    assert spark.read.parquet(sink).count() == 2
    with pytest.raises(ValueError):
        stream_issues(stream, "id", [Rule.of("x", "uniqueness")])


def test_text_nan_is_no_number(spark):
    from plumbline.operators import outliers, remediate

    df = spark.createDataFrame([(i, str(i)) for i in range(10)] + [(10, "NaN"), (11, "nan"), (12, "50")], "id int, a string")
    run = Analysis(df, "id", [Rule.of("a", "accuracy", min_value=0, max_value=20)])
    assert [r.value for r in run.issues().collect()] == ["50"]
    q = outliers.exact_quantiles(df, ["a"], [0.5, 1.0])["a"]
    assert q == [5.0, 50.0]
    kept = {r.id: r.a for r in df.withColumn("a", remediate.null_out_of_range(df["a"], 0, 20)).collect()}
    assert kept[10] == "NaN" and kept[12] is None


def test_long_and_short_lists_give_one_text(spark):
    df = spark.createDataFrame([(1, "x")], "id int, a string")
    reasons = {
        n: Analysis(df, "id", [Rule.of("a", "validity", allowed_values=[f"v{i}" for i in range(n)])]).issues().first().reason for n in (1000, 1001)
    }
    assert reasons[1000].replace("990", "991") == reasons[1001]


def test_forest_draws_from_the_whole_table(spark):
    from plumbline.operators.forest import SAMPLE, TREES, _samples

    rows = spark.range(60_000).select(F.col("id").alias("record_id"), F.array(F.col("id").cast("double")).alias("x"))
    drawn = _samples(rows, 60_000)
    assert drawn.count() == TREES * SAMPLE
    assert drawn.select("x").distinct().count() > 15_000
    assert sorted(map(tuple, _samples(rows.repartition(7), 60_000).select("tree", "h").collect())) == sorted(map(tuple, drawn.select("tree", "h").collect()))
