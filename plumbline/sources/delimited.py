"""Delimited text files: separator detection, missing-value tokens, tidy header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = [",", "\t", ";"]  # fixed values, ties go to the first

# Texts read as a missing value.
NULL_TOKENS = [
    "", "NA", "N/A", "n/a", "null", "NULL", "None", "nan", "NaN", "<NA>", "#N/A", "#NA", "#N/A N/A",
    "-nan", "-NaN", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
]


def null_tokens(df: DataFrame) -> DataFrame:
    """Text columns with every missing-value token turned into NULL."""
    return df.select(
        *[
            F.when(F.col(f"`{n}`").isin(NULL_TOKENS), None).otherwise(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def trim_header(df: DataFrame) -> DataFrame:
    """Column names without surrounding white space."""
    return df.toDF(*[n.strip() for n in df.columns])


def detect_separator(spark: SparkSession, path: str) -> str:
    """Most frequent of comma, tab and semicolon in the header line; comma when there is none."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(SEPARATORS, key=line.count)


def _read(spark: SparkSession, path: str, sep: str) -> DataFrame:
    # Every token but one is replaced after the read: the reader knows a single null text.
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=False, escape='"')


def _typed(df: DataFrame) -> DataFrame:
    """Whole-number and decimal columns get a number type; decided by one aggregate over all columns."""
    integer, decimal = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    checks = []
    for i, n in enumerate(df.columns):
        c = F.trim(F.col(f"`{n}`"))
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.rlike(integer)).alias(f"i{i}"),
            F.count_if(c.rlike(decimal)).alias(f"d{i}"),
        ]
    seen = df.agg(*checks).first()
    out = []
    for i, n in enumerate(df.columns):
        c = F.col(f"`{n}`")
        filled = seen[f"n{i}"] > 0
        kind = "bigint" if filled and seen[f"i{i}"] == seen[f"n{i}"] else "double" if filled and seen[f"d{i}"] == seen[f"n{i}"] else None
        out.append(F.trim(c).cast(kind).alias(n) if kind else c)
    return df.select(*out)


def read_delimited(spark: SparkSession, path: str, schema=None, infer: bool = True) -> DataFrame:
    """Read csv or txt files (a file, a folder or a glob). Give a ``schema`` at scale to skip the typing pass."""
    sep = detect_separator(spark, path)
    if schema is not None:
        return null_tokens(trim_header(spark.read.csv(path, sep=sep, header=True, schema=schema, escape='"')))
    df = _read(spark, path, sep)
    if len(df.columns) == 1:
        for other in (s for s in SEPARATORS if s != sep):
            again = _read(spark, path, other)
            if len(again.columns) > 1:
                df = again
                break
    df = null_tokens(trim_header(df))
    if df.isEmpty():
        raise ValueError(f"no data in {path}")
    return _typed(df) if infer else df
