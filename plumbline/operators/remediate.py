"""Corrections applied from the issue table, and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import number, strip, strip_accents
from plumbline.operators.similarity import candidates as cand


def drop_surplus(df: DataFrame, id_col: str, issues: DataFrame, column: str) -> DataFrame:
    """Drop the members of similarity groups that are not the kept record; groups without one stay untouched."""
    mine = issues.where((F.col("column") == column) & (F.col("dimension") == "similarity"))
    led = mine.where(F.coalesce("is_principal", F.lit(False))).select("group_id").distinct()
    kept = mine.where(F.coalesce("is_principal", F.lit(False))).select("record_id").distinct()
    surplus = mine.where(~F.coalesce("is_principal", F.lit(False))).join(cand.shuffled(led), "group_id", "left_semi").select("record_id").distinct()
    surplus = surplus.join(cand.shuffled(kept), "record_id", "left_anti")
    return df.join(cand.shuffled(surplus.withColumnRenamed("record_id", id_col)), id_col, "left_anti")


def drop_duplicate_ids(df: DataFrame, id_col: str, issues: DataFrame) -> DataFrame:
    """One row per id. Rows reported as not to keep go first, then all but the best of what is left.

    ``issues``: the issue table, where uniqueness of ``id_col`` names a row to keep and others. Rows of an id are ranked
    by fewest missing fields, then smallest content; as many as are reported leave from the end, so an id whose rows are
    all reported goes. Ids that nobody reported keep their best row. Combined map-side, so a hot id is one row per task.
    """
    from plumbline.operators.uniqueness import null_count

    others = [c for c in df.columns if c != id_col]
    rank = F.struct(null_count(df).alias("nulls"), *[F.col(f"`{c}`") for c in others])
    best = df.groupBy(id_col).agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("_n"))
    mine = issues.where((F.col("column") == id_col) & (F.col("dimension") == "uniqueness") & (F.col("is_principal") == F.lit(False)))
    reported = mine.groupBy(F.col("record_id").alias("_id")).agg(F.count(F.lit(1)).alias("_m"))
    left = best.join(reported, F.col(id_col).eqNullSafe(F.col("_id")), "left").where(F.col("_n") > F.coalesce("_m", F.lit(0)))
    return left.select(*[F.col(id_col) if c == id_col else F.col("r").getField(c).alias(c) for c in df.columns])


def map_values(df: DataFrame, column: str, mapping: dict[str, str | None]) -> DataFrame:
    """Replace exact values (None clears them); the mapping is joined, whatever its length."""
    c = F.col(column)
    table = df.sparkSession.createDataFrame(list(mapping.items()), "__old string, __new string")
    joined = df.join(table, c == F.col("__old"), "left")
    return joined.withColumn(column, F.when(F.col("__old").isNotNull(), F.col("__new")).otherwise(c)).select(*df.columns)


def iso_date(c: Column) -> Column:
    """DD/MM/YYYY becomes YYYY-MM-DD, everything else stays."""
    pattern = r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$"
    trimmed = strip(c)
    return F.when(trimmed.rlike(pattern), F.regexp_replace(trimmed, pattern, "$3-$2-$1")).otherwise(c)


def null_out_of_range(c: Column, low: float = 0, high: float | None = None) -> Column:
    value = number(c)
    outside = (value < low) if high is None else ((value < low) | (value > high))
    return F.when(F.coalesce(outside, F.lit(False)), None).otherwise(c)


def email_without_accents(c: Column) -> Column:
    """Accents removed left of the last @; the domain stays as it is."""
    domain = F.substring_index(c, "@", -1)
    user = F.substring(c, F.lit(1), F.char_length(c) - F.char_length(domain))
    return F.when(F.contains(c, F.lit("@")), F.concat(strip_accents(user), domain)).otherwise(c)


def phone_digits(c: Column) -> Column:
    """Nine digits: the country prefix 51 or anything before the last nine is dropped; shorter ones stay."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    n = F.char_length(digits)
    return (
        F.when((n == 11) & F.startswith(digits, F.lit("51")), F.substring(digits, 3, 9))
        .when(n >= 9, F.right(digits, F.lit(9)))
        .otherwise(c)
    )


def fix_reported(df: DataFrame, id_col: str, column: str, issues: DataFrame, fix) -> DataFrame:
    """Apply ``fix(column)`` only to the records an issue table names for the column."""
    named = issues.where(F.col("column") == column).select(F.col("record_id").alias(id_col), F.lit(True).alias("__hit")).distinct()
    marked = df.join(named, id_col, "left")
    return marked.withColumn(column, F.when(F.col("__hit"), fix(F.col(column))).otherwise(F.col(column))).select(*df.columns)


def change_log(df: DataFrame, fixes: dict[str, tuple[str, Column]]) -> DataFrame:
    """(correction, column, changed): values each correction changes, all counted in one scan."""
    stats = df.agg(*[F.count_if(~F.col(c).eqNullSafe(new)).alias(f"n{i}") for i, (c, new) in enumerate(fixes.values())])
    rows = [
        F.struct(F.lit(name).alias("correction"), F.lit(c).alias("column"), F.col(f"n{i}").alias("changed"))
        for i, (name, (c, _)) in enumerate(fixes.items())
    ]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def compare_scores(before: DataFrame, after: DataFrame) -> DataFrame:
    """Scores of two runs side by side. Pin the fences of outlier rules (``bounds``) to make them comparable."""
    keys = ["column", "dimension"]
    old = before.select(*keys, F.col("score").alias("before"))
    new = after.select(*keys, F.col("score").alias("after"))
    return old.join(new, keys, "full_outer").withColumn("delta", F.round(F.col("after") - F.col("before"), 4))
