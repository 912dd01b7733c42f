"""Sinks for issues, scores, profiles and the run log. Every writer is a distributed Spark write."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_issues(issues: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per dimension, so that a reader of one dimension scans only its files."""
    issues.write.mode(mode).partitionBy("dimension").parquet(path)


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite", file_format: str = "parquet") -> None:
    scores.write.mode(mode).format(file_format).option("header", True).save(path)


def write_profile(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """The tables of a profile (summary, columns, top values), one folder each."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(os.path.join(path, name))


def run_record(scorecard: DataFrame, scores: DataFrame, weights: DataFrame, **facts: str) -> DataFrame:
    """One row of the run log: counts, scores, dimensions that ran and the weights as they were used."""
    dimensions = scores.agg(F.array_join(F.array_sort(F.collect_set("dimension")), ",").alias("d"))
    frozen = weights.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "level"))))).alias("w")
    )
    columns = scores.agg(F.count_distinct("column").alias("c"))
    return scorecard.select(
        *[F.lit(v).alias(k) for k, v in facts.items()],
        F.col("total_records").alias("n_rows"),
        F.col("weighted_score").alias("score"),
        F.col("records_with_problems").alias("problems"),
        columns.scalar().alias("n_columns"),
        dimensions.scalar().alias("dimensions"),
        frozen.scalar().alias("weights"),
    )


def append_run_log(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)
