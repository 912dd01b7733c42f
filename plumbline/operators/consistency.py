"""Majority patterns: rows whose written format differs from the rest of the column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.patterns import (
    MONEY,
    NO_LETTERS,
    PHONE_CHARACTERS,
    PLAIN_NUMBER,
    casing,
    date_label,
    phone_shape,
)
from plumbline.functions.text import strip
from plumbline.operators.rules import percent_ok

# Share of dates that makes a date column, share that rules dates out, phone and casing gates.
DATE_SHARE = 0.30
NO_DATE_SHARE = 0.05
PHONE_SHARE = 0.70
PHONE_ROWS = 5
CASING_ROWS = 3


def _labelled(df: DataFrame, id_col: str, column: str) -> DataFrame:
    value = strip(F.col(column).cast("string"))
    rows = df.select(
        F.col(id_col).alias("record_id"), F.col(column).cast("string").alias("value"), value.alias("v")
    )
    return rows.select(
        "record_id",
        "value",
        date_label(F.col("v")).alias("date"),
        F.when(F.col("v").rlike(MONEY), "symbol").when(F.col("v").rlike(PLAIN_NUMBER), "plain").alias("money"),
        F.when(F.col("v").rlike(PHONE_CHARACTERS), phone_shape(F.col("v"))).alias("phone"),
        F.when(F.col("v").isNotNull() & ~F.col("v").rlike(NO_LETTERS), casing(F.col("v"))).alias("case"),
    )


def _majority(labels: DataFrame, kind: str) -> list[Column]:
    """Distinct labels of one kind, the most frequent one (ties: smallest text) and its row total."""
    return [
        F.count_if(F.col("kind") == kind).alias(f"{kind}_kinds"),
        F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"{kind}_rows"),
        F.min(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("n"), "label")))
        .getField("label")
        .alias(f"{kind}_top"),
    ]


def column_patterns(df: DataFrame, column: str) -> DataFrame:
    """One row with the pattern counts of a column: the gates and majorities of all four detectors."""
    labels = _labelled(df, column, column)
    counts = labels.groupBy("date", "money", "phone", "case", F.col("value").isNotNull().alias("filled")).agg(
        F.count(F.lit(1)).alias("n")
    )
    long = (
        counts.select(
            "n",
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(F.col("filled"), F.struct(F.lit("any").alias("kind"), F.lit("").alias("label"))),
                        *[
                            F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")))
                            for k in ("date", "money", "phone", "case")
                        ],
                    )
                )
            ).alias("l"),
        )
        .select("n", "l.*")
        .groupBy("kind", "label")
        .agg(F.sum("n").alias("n"))
    )
    money = [
        F.coalesce(F.sum(F.when((F.col("kind") == "money") & (F.col("label") == x), F.col("n"))), F.lit(0)).alias(x)
        for x in ("symbol", "plain")
    ]
    kinds = [c for k in ("any", "date", "phone", "case") for c in _majority(long, k)]
    return long.agg(*kinds, *money)


def _detectors(s: Column) -> dict[str, Column]:
    """Reason per detector, NULL when the row is fine. ``s`` holds the column patterns."""
    filled = s.getField("any_rows")
    no_dates = s.getField("date_rows") < filled * NO_DATE_SHARE
    symbol, plain = s.getField("symbol"), s.getField("plain")
    few = F.when(symbol <= plain, "symbol").otherwise("plain")
    date_on = (s.getField("date_rows") >= filled * DATE_SHARE) & (s.getField("date_kinds") > 1)
    phone_on = (
        no_dates
        & (s.getField("phone_rows") >= filled * PHONE_SHARE)
        & (s.getField("phone_rows") >= PHONE_ROWS)
        & (s.getField("phone_kinds") > 1)
    )
    case_on = (s.getField("case_rows") >= CASING_ROWS) & (s.getField("case_kinds") > 1)
    return {
        "date_format": F.when(
            date_on & (F.col("date") != s.getField("date_top")),
            F.concat(F.lit("date format differs from "), s.getField("date_top")),
        ),
        "currency": F.when(
            no_dates & (symbol > 0) & (plain > 0) & (F.col("money") == few),
            F.when(few == "symbol", "currency symbol among plain numbers").otherwise("plain number among currency"),
        ),
        "phone_shape": F.when(
            phone_on & (F.col("phone") != s.getField("phone_top")),
            F.concat(F.lit("phone shape differs from "), s.getField("phone_top")),
        ),
        "casing": F.when(
            case_on & (F.col("case") != s.getField("case_top")),
            F.concat(F.lit("casing differs from "), s.getField("case_top")),
        ),
    }


def consistency_findings(df: DataFrame, id_col: str, column: str, detector: str | None = None) -> DataFrame:
    """Minority rows (record_id, value, reason) of one detector, or of the first that fires on each row."""
    # one row of statistics, found first and then a literal beside every row
    stats = column_patterns(df, column)
    found = stats.first()
    literals = F.struct(*[F.lit(found[f.name]).cast(f.dataType).alias(f.name) for f in stats.schema.fields])
    rows = _labelled(df, id_col, column).withColumn("s", literals)
    reasons = _detectors(F.col("s"))
    reason = reasons[detector] if detector else F.coalesce(*reasons.values())
    return rows.select("record_id", "value", reason.alias("reason")).where(F.col("reason").isNotNull())


def consistency_issues(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """One issue per record id; among several rows of an id the smallest reason and value stay."""
    found = consistency_findings(df, id_col, column)
    one = found.groupBy("record_id").agg(F.min(F.struct("reason", "value")).alias("f"))
    return one.select(
        "record_id",
        F.lit(column).alias("column"),
        F.lit("consistency").alias("dimension"),
        F.col("f.reason").alias("reason"),
        F.col("f.value").alias("value"),
    )


def consistency_scores(df: DataFrame, id_col: str, column: str) -> DataFrame:
    bad = consistency_findings(df, id_col, column).agg(F.count_distinct("record_id").alias("n_bad"))
    return df.agg(F.count(F.lit(1)).alias("n_total")).select(
        F.lit(column).alias("column"),
        F.lit("consistency").alias("dimension"),
        "n_total",
        bad.scalar().alias("n_bad"),
    ).withColumn("score", percent_ok(F.col("n_total"), F.col("n_bad")))
