"""From scores and issues to the weighted verdict. All inputs here are small score tables or the issue table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rules import DIMENSIONS

# Weight of each level, best first.
LEVELS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
DEFAULT_PROFILE = "diagnostico_general"
AI_PURPOSE = "iniciativa_ia"

# Level of each dimension, by purpose and by kind of AI project.
PURPOSES = {
    "diagnostico_general": {d: "medium" for d in DIMENSIONS},
    "reporteria_bi": {
        "completeness": "critical", "uniqueness": "critical", "validity": "high", "consistency": "high",
        "similarity": "high", "accuracy": "medium", "validity_period": "medium", "referential_integrity": "medium",
        "reasonableness": "medium", "precision": "low", "timeliness": "low",
    },
    "migracion": {
        "completeness": "critical", "validity": "critical", "referential_integrity": "critical", "uniqueness": "high",
        "consistency": "high", "precision": "high", "accuracy": "medium", "validity_period": "medium",
        "similarity": "medium", "timeliness": "low", "reasonableness": "low",
    },
    "integracion": {
        "validity": "critical", "consistency": "critical", "precision": "critical", "completeness": "high",
        "referential_integrity": "high", "uniqueness": "medium", "accuracy": "medium", "validity_period": "medium",
        "timeliness": "medium", "reasonableness": "low", "similarity": "low",
    },
    "auditoria": {
        "completeness": "critical", "accuracy": "critical", "validity_period": "critical", "uniqueness": "high",
        "validity": "high", "timeliness": "high", "referential_integrity": "high", "consistency": "medium",
        "precision": "medium", "reasonableness": "medium", "similarity": "medium",
    },
    "depuracion_duplicados": {
        "uniqueness": "critical", "similarity": "critical", "completeness": "high", "consistency": "high",
        "validity": "medium", "precision": "medium", "accuracy": "low", "validity_period": "low", "timeliness": "low",
        "referential_integrity": "low", "reasonableness": "low",
    },
    "campanas": {
        "completeness": "critical", "validity": "critical", "similarity": "critical", "uniqueness": "high",
        "consistency": "high", "validity_period": "high", "precision": "medium", "timeliness": "medium",
        "referential_integrity": "medium", "accuracy": "low", "reasonableness": "low",
    },
}
AI_TYPES = {
    "ml_supervisado": {
        "completeness": "critical", "accuracy": "critical", "similarity": "critical", "uniqueness": "high",
        "validity": "high", "consistency": "high", "reasonableness": "high", "validity_period": "medium",
        "precision": "medium", "referential_integrity": "medium", "timeliness": "low",
    },
    "deteccion_anomalias": {
        "accuracy": "critical", "precision": "critical", "timeliness": "critical", "completeness": "high",
        "validity_period": "high", "reasonableness": "high", "similarity": "high", "uniqueness": "medium",
        "validity": "medium", "consistency": "medium", "referential_integrity": "low",
    },
    "series_tiempo": {
        "completeness": "critical", "validity_period": "critical", "timeliness": "critical", "consistency": "high",
        "accuracy": "high", "reasonableness": "high", "uniqueness": "medium", "validity": "medium",
        "precision": "medium", "referential_integrity": "low", "similarity": "low",
    },
    "segmentacion": {
        "completeness": "critical", "consistency": "critical", "uniqueness": "high", "validity": "high",
        "reasonableness": "high", "similarity": "high", "accuracy": "medium", "precision": "medium",
        "referential_integrity": "medium", "validity_period": "low", "timeliness": "low",
    },
    "agente_generativo": {
        "consistency": "critical", "validity_period": "critical", "similarity": "critical", "completeness": "high",
        "validity": "high", "timeliness": "high", "uniqueness": "medium", "accuracy": "medium",
        "referential_integrity": "medium", "precision": "low", "reasonableness": "low",
    },
    "recomendacion": {
        "uniqueness": "critical", "similarity": "critical", "completeness": "high", "consistency": "high",
        "referential_integrity": "high", "validity": "medium", "accuracy": "medium", "validity_period": "medium",
        "timeliness": "medium", "precision": "low", "reasonableness": "low",
    },
}


def published_levels(profile: str) -> dict[str, str]:
    return {**PURPOSES, **AI_TYPES}.get(profile, PURPOSES[DEFAULT_PROFILE])


def weight_matrix(spark: SparkSession) -> DataFrame:
    """(profile, dimension, level): 13 profiles by 11 dimensions."""
    rows = [(p, d, lv) for p in chain(PURPOSES, AI_TYPES) for d, lv in published_levels(p).items()]
    return spark.createDataFrame(rows, "profile string, dimension string, level string")


def _level_weight(level: Column) -> Column:
    pairs = [F.lit(x) for kv in LEVELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit(LEVELS["medium"]))


def resolve_weights(
    spark: SparkSession,
    purpose: str | None = None,
    ai_type: str | None = None,
    overrides: DataFrame | None = None,
    manual: dict[str, str] | None = None,
    equal: bool = False,
) -> DataFrame:
    """(dimension, level, weight) for a purpose; ``overrides``: (purpose, ai_type, dimension, level)."""
    purpose = purpose or DEFAULT_PROFILE
    if equal:
        levels = spark.createDataFrame([(d, "medium") for d in DIMENSIONS], "dimension string, level string")
    else:
        name = ai_type if purpose == AI_PURPOSE and ai_type else purpose
        base = spark.createDataFrame(list(published_levels(name).items()), "dimension string, published string")
        mine = overrides if overrides is not None else spark.createDataFrame(
            [], "purpose string, ai_type string, dimension string, level string"
        )
        mine = mine.where((F.col("purpose") == purpose) & F.col("ai_type").eqNullSafe(F.lit(ai_type))).groupBy(
            "dimension"
        ).agg(F.max("level").alias("override"))
        chosen = [(d, lv) for d, lv in (manual or {}).items() if lv in LEVELS]
        hand = spark.createDataFrame(chosen, "dimension string, by_hand string")
        levels = (
            base.join(mine, "dimension", "left")
            .join(hand, "dimension", "left")
            .select("dimension", F.coalesce("by_hand", "override", "published").alias("level"))
        )
    return levels.withColumn("weight", _level_weight(F.col("level")))


def overrides_count(spark: SparkSession, levels: DataFrame, purpose: str, ai_type: str | None = None) -> DataFrame:
    """How many dimensions differ from the published matrix."""
    name = ai_type if purpose == AI_PURPOSE and ai_type else purpose
    base = spark.createDataFrame(list(published_levels(name).items()), "dimension string, published string")
    return levels.join(base, "dimension", "left").agg(
        F.count_if(~F.col("level").eqNullSafe(F.col("published"))).alias("overrides")
    )


def issue_union(parts: list[DataFrame]) -> DataFrame:
    """All issues under one schema; columns a part does not have are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def simple_mean(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.round(F.avg("score"), 1), F.lit(100.0)).alias("simple_mean"))


def by_dimension(scores: DataFrame) -> DataFrame:
    return scores.groupBy("dimension").agg(F.avg("score").alias("score"))


def levelled(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(dimension, score, level, weight) of the dimensions that ran; unlisted ones are medium."""
    return (
        by_dimension(scores)
        .join(weights, "dimension", "left")
        .select(
            "dimension",
            "score",
            F.coalesce("level", F.lit("medium")).alias("level"),
            F.coalesce("weight", F.lit(LEVELS["medium"])).alias("weight"),
        )
    )


def weighted_score(scores: DataFrame, weights: DataFrame) -> DataFrame:
    rows = levelled(scores, weights)
    return rows.agg(
        F.coalesce(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 1), F.lit(100.0)).alias(
            "weighted_score"
        )
    )


def threshold_dimensions(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """The dimensions at the highest level that ran."""
    rows = levelled(scores, weights)
    top = rows.agg(F.max("weight").alias("w"))
    return rows.where(F.col("weight") == top.scalar())


def records_with_problems(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_distinct("record_id").alias("records_with_problems"))


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def usable_records(df: DataFrame, issues: DataFrame, scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Records without an issue in a threshold dimension; records to keep of a duplicate group are fine."""
    dims = threshold_dimensions(scores, weights).select("dimension")
    counted = issues.join(F.broadcast(dims), "dimension", "left_semi")  # at most eleven dimensions
    if "is_principal" in issues.columns:
        counted = counted.where(~F.coalesce("is_principal", F.lit(False)))
    spoiled = counted.agg(F.count_distinct("record_id").alias("n"))
    total = _total(df)
    return total.select(F.col("n").alias("total"), (F.col("n") - spoiled.scalar()).alias("usable")).withColumn(
        "usable_pct",
        F.when(F.col("total") > 0, F.round(F.col("usable") / F.col("total") * 100, 1)).otherwise(F.lit(100.0)),
    )


def worst_critical(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Lowest threshold dimension; ties by name."""
    rows = threshold_dimensions(scores, weights)
    worst = rows.agg(F.min(F.struct("score", "dimension")).alias("w"))
    return worst.select(F.col("w.dimension").alias("dimension"), F.round("w.score", 1).alias("score"))


def verdict_of(score: Column) -> Column:
    return F.when(score < 60, "not_ready").when(score < 80, "at_risk").otherwise("ready")


def verdict(scores: DataFrame, weights: DataFrame) -> DataFrame:
    worst = worst_critical(scores, weights)
    return worst.select(
        "dimension", "score", verdict_of(F.coalesce("score", F.lit(100.0))).alias("verdict")
    )


def summary(df: DataFrame, issues: DataFrame, scores: DataFrame) -> DataFrame:
    problems = records_with_problems(issues)
    worst = by_dimension(scores).agg(F.min(F.struct("score", "dimension")).getField("dimension").alias("d"))
    n = F.col("total_records")
    return (
        _total(df)
        .select(F.col("n").alias("total_records"), problems.scalar().alias("records_with_problems"))
        .withColumn(
            "clean_pct", F.when(n > 0, F.round((n - F.col("records_with_problems")) / n * 100, 2)).otherwise(F.lit(100.0))
        )
        .withColumn("worst_dimension", worst.scalar())
    )


assert set(DIMENSIONS) == set(DIMENSIONS)
