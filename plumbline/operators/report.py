"""Report tables built from issues and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rules import DIMENSIONS

FEATURES = "array<struct<field:string,value:double,unusual:boolean>>"


def issue_detail(issues: DataFrame) -> DataFrame:
    """Issues by column, dimension and group (ungrouped last) with a keep flag."""
    have = set(issues.columns)
    group = F.col("group_id") if "group_id" in have else F.lit(None).cast("string")
    keep = F.coalesce("is_principal", F.lit(False)) if "is_principal" in have else F.lit(False)
    return (
        issues.select(
            "column", "dimension", group.alias("group_id"), "record_id", "reason", "value", F.when(keep, "yes").otherwise("").alias("keep")
        )
        .orderBy("column", "dimension", F.asc_nulls_last("group_id"), "record_id")
    )


def rating(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("critical")


def score_matrix(scores: DataFrame) -> DataFrame:
    """One row per column, one field per dimension (NULL where not applied) and the row mean."""
    return scores.groupBy("column").agg(
        *[F.round(F.max(F.when(F.col("dimension") == d, F.col("score"))), 1).alias(d) for d in DIMENSIONS],
        F.round(F.avg("score"), 1).alias("mean_score"),
    )


def issues_by_dimension(issues: DataFrame, total_rows: DataFrame) -> DataFrame:
    """Issues and records per dimension, share of the largest count, share of all rows."""
    counts = issues.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("issues"), F.count_distinct("record_id").alias("records")
    )
    top = counts.agg(F.max("issues").alias("m"))
    return counts.select(
        "dimension",
        "issues",
        "records",
        F.round(F.col("issues") / top.scalar() * 100, 1).alias("share_of_largest"),
        F.round(F.col("records") / total_rows.scalar() * 100, 4).alias("pct_of_rows"),
    )


def broad_rules(issues: DataFrame, total_rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Rules whose issues touch more than half of the rows: question the rule itself."""
    counts = issues.groupBy("column", "dimension").agg(F.count_distinct("record_id").alias("records"))
    return counts.where(F.col("records") > total_rows.scalar() * share)


def dimension_ranking(scores: DataFrame, issues: DataFrame, limit: int | None = None) -> DataFrame:
    """Dimension means, worst first, with their issue counts."""
    means = scores.groupBy("dimension").agg(F.round(F.avg("score"), 1).alias("score"))
    counts = issues.groupBy("dimension").agg(F.count(F.lit(1)).alias("issues"))
    ranked = (
        means.join(counts, "dimension", "left")
        .select("dimension", "score", F.coalesce("issues", F.lit(0)).alias("issues"))
        .orderBy("score", "dimension")
    )
    return ranked if limit is None else ranked.limit(limit)


def column_ranking(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("column")
        .agg(F.round(F.avg("score"), 1).alias("mean_score"), F.min("score").alias("worst_score"))
        .orderBy("mean_score", "column")
    )


def visible_whitespace(values: DataFrame, column: str) -> DataFrame:
    """Values with leading or trailing space, tabs, line breaks or control characters, made visible, with counts."""
    v = F.col(column)
    leads, trails = v.rlike(r"^[\s ]"), v.rlike(r"[\s ]$")
    kind = (
        F.when(leads & trails, "leading and trailing space")
        .when(leads, "leading space")
        .when(trails, "trailing space")
        .when(v.rlike(r"[\t\n\r]"), "tab or line break")
        .when(v.rlike(r"[\x00-\x1f ]"), "invisible characters")
    )
    shown = (
        F.when(leads | trails, F.translate(v, "  ", "␣·"))
        .when(v.rlike(r"[\t\n\r]"), F.translate(v, "\t\n\r", "→¶"))
        .otherwise(v)
    )
    return (
        values.select(kind.alias("kind"), F.concat(F.lit('"'), shown, F.lit('"')).alias("shown"))
        .where(F.col("kind").isNotNull())
        .groupBy("kind", "shown")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def outlier_fields(issues: DataFrame) -> DataFrame:
    """Feature flags of multivariate anomalies, one row per record and field."""
    return issues.select("record_id", F.explode(F.from_json("value", FEATURES)).alias("f")).select("record_id", "f.*")


def outlier_text(issues: DataFrame) -> DataFrame:
    """`field: value (!)` joined per record."""
    parts = F.transform(
        F.from_json("value", FEATURES),
        lambda f: F.concat(
            f["field"],
            F.lit(": "),
            F.coalesce(f["value"].cast("string"), F.lit("null")),
            F.when(f["unusual"], " (!)").otherwise(" (ok)"),
        ),
    )
    return issues.select("record_id", F.array_join(parts, " | ").alias("shown"))


def similarity_detail(meta: DataFrame) -> DataFrame:
    """Counters of one near-duplicate run with a warning text by reliability."""
    return meta.withColumn(
        "warning",
        F.when(F.col("partial"), "partial analysis: candidate pairs were discarded")
        .when(
            F.col("reliability") != "reliable",
            F.concat(F.col("dispersed_records").cast("string"), F.lit(" records in dispersed groups not interpreted")),
        )
        .otherwise(""),
    )
