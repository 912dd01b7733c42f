"""Exact duplicates: repeated values, the record to keep, repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_missing
from plumbline.operators.rules import percent_ok

ID_WORDS = ["id", "codigo", "code", "clave", "key", "nit", "dni", "rut"]  # fixed values


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) with NULL as a value of its own; combined map-side, so a hot value is one row per task."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def uniqueness_scores(df: DataFrame, column: str) -> DataFrame:
    totals = value_counts(df, column).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_bad"),
    )
    return totals.select(
        F.lit(column).alias("column"),
        F.lit("uniqueness").alias("dimension"),
        "n_total",
        "n_bad",
        percent_ok(F.col("n_total"), F.col("n_bad")).alias("score"),
    )


def null_count(df: DataFrame):
    """Number of missing fields of a row (reads every column)."""
    parts = [F.when(is_missing(F.col(f"`{n}`"), t), 1).otherwise(0) for n, t in df.dtypes]
    return sum(parts[1:], parts[0])


def uniqueness_issues(df: DataFrame, id_col: str, column: str, principals: bool = True) -> DataFrame:
    """All members of repeated values; the record to keep has the fewest missing fields, then the smallest id text."""
    rows = df.select(
        F.col(id_col).alias("record_id"),
        F.col(column).alias("value"),
        *(
            [
                F.struct(
                    null_count(df).alias("nulls"),
                    F.col(id_col).cast("string").alias("id"),
                    # Rows equal in both only differ by their content; equal rows are counted.
                    F.xxhash64(*[F.col(f"`{n}`") for n in df.columns]).alias("content"),
                ).alias("rank")
            ]
            if principals
            else []
        ),
    )
    best = [F.min("rank").alias("best")] if principals else []
    repeated = (
        rows.groupBy(F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("n"), *best).where(F.col("n") > 1).drop("n")
    )
    joined = rows.join(repeated, F.col("value").eqNullSafe(F.col("v")))
    keep = F.lit(None).cast("boolean")
    if principals:
        # rows that tie in everything are one with copies, of which the first is the one to keep
        joined = joined.groupBy("record_id", "value", "rank", "best").agg(F.count(F.lit(1)).alias("copies"))
        joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        keep = (F.col("rank") == F.col("best")) & (F.col("copy") == 1)
    return joined.select(
        "record_id",
        F.lit(column).alias("column"),
        F.lit("uniqueness").alias("dimension"),
        F.when(keep, "repeated value: keep this record").otherwise("repeated value").alias("reason"),
        F.col("value").cast("string").alias("value"),
        keep.alias("is_principal"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row in every column."""
    groups = df.groupBy(*[F.col(f"`{n}`") for n in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def looks_like_id(name: str) -> bool:
    return any(word in name.lower() for word in ID_WORDS)


def id_duplicates(df: DataFrame) -> DataFrame:
    """Columns named like an identifier and the number of their rows with a repeated value."""
    names = [n for n in df.columns if looks_like_id(n)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, involved bigint")
    cells = df.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in names]))
    ).select("col.*")
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return counts.groupBy("column").agg(F.sum("n").alias("involved"))

