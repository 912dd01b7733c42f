"""Questions to the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dates import moment


def _window(runs: DataFrame, start: str | None, end: str | None, as_of: str | None, days: int) -> Column:
    today = moment(as_of).cast("date")
    day = F.col("run_at").cast("date")
    first = F.lit(start).cast("date") if start else F.date_sub(today, days)
    last = F.lit(end).cast("date") if end else today
    return day.between(first, last)


def runs_between(
    runs: DataFrame, owner: int, start: str | None = None, end: str | None = None, purpose: str | None = None,
    search: str | None = None, as_of: str | None = None, days: int = 30,
) -> DataFrame:
    """Runs of one owner in a period (30 days by default), by purpose and text in file name or description, newest first."""
    chosen = runs.where((F.col("owner") == owner) & _window(runs, start, end, as_of, days))
    if purpose:
        chosen = chosen.where(F.col("purpose") == purpose)
    if search:
        text = search.lower()
        found = F.contains(F.lower("file_name"), F.lit(text)) | F.contains(F.lower("description"), F.lit(text))
        chosen = chosen.where(F.coalesce(found, F.lit(False)))
    return chosen.orderBy(F.desc("run_at"), F.desc("run_id"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Runs, mean score (a missing score counts as 0), rows, distinct files."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 1), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.count_distinct("file_name").alias("files"),
    )


def last_runs(runs: DataFrame, owner: int, n: int = 50) -> DataFrame:
    """The owner's last n runs."""
    return runs.where(F.col("owner") == owner).orderBy(F.desc("run_at"), F.desc("run_id")).limit(n)
