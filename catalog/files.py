"""Queries of sources and sinks: tables derived from the supplied ones are written and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from catalog.base import Data, query
from catalog.scores import PURPOSE, SQL_SUMMARY, analysis, scored, weights
from plumbline.operators import profile as pf
from plumbline.session import ensure_checkpoint_dir
from plumbline.sources import delimited, sinks


def scratch(d: Data, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (a local one only for a local session without the setting)."""
    ensure_checkpoint_dir(d.spark)
    return os.path.join(d.spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


@query(
    "read_delimited",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer""",
)
def read_delimited(d: Data):
    """A semicolon-separated export is read with the separator detected, tokens nulled and numbers typed."""
    path = scratch(d, "export")
    out = d.table("customer").select(
        F.col("c_custkey").alias(" id "),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_custkey") % 7 == 0, "N/A").otherwise(F.col("c_mktsegment")).alias("segment "),
    )
    out.write.csv(path, sep=";", header=True)
    return delimited.read_delimited(d.spark, path)


@query(
    "null_tokens",
    "SELECT id, nullif(nullif(segment, 'N/A'), '') AS segment, nullif(name, '') AS name FROM customers",
    ("customers",),
)
def null_tokens(d: Data):
    """Missing-value tokens become NULL in every text column."""
    return delimited.null_tokens(d.view("customers").select("id", "segment", "name"))


@query("trim_header", "SELECT r_regionkey AS key, r_name AS name FROM region")
def trim_header(d: Data):
    """Column names without surrounding white space."""
    return delimited.trim_header(d.table("region").toDF(" key", "name\t"))


@scored("write_issues", 'SELECT record_id, col AS "column", dimension, reason, value, is_principal FROM issues')
def write_issues(d: Data):
    """Issues written by dimension and read back."""
    path = scratch(d, "issues")
    sinks.write_issues(analysis(d).issues(), path)
    return d.spark.read.parquet(path)


@scored("write_scores", 'SELECT col AS "column", dimension, n_total, n_bad, score FROM scores')
def write_scores(d: Data):
    """Scores written and read back."""
    path = scratch(d, "scores")
    sinks.write_scores(analysis(d).scores(), path)
    return d.spark.read.parquet(path)


@query("write_profile")
def write_profile(d: Data):
    """Summary, columns and top values written; the column table is read back."""
    path, table = scratch(d, "profile"), d.view("customers")
    counts = pf.cell_counts(table, pf.string_columns(table))
    sinks.write_profile(
        {
            "summary": pf.table_summary(table),
            "columns": pf.column_info(table).join(pf.text_profile(table, counts=counts), "column", "left"),
            "top_values": pf.top_values(table, counts=counts),
        },
        path,
    )
    return d.spark.read.parquet(os.path.join(path, "columns"))


@scored(
    "append_run_log",
    f"""SELECT '{PURPOSE}' AS purpose, 'orders' AS source, s.total_records AS n_rows, (SELECT round(sum(score * weight) / sum(weight), 1) FROM ranked) AS score,
      s.records_with_problems AS problems, (SELECT count(DISTINCT col) FROM scores) AS n_columns,
      (SELECT string_agg(dimension, ',' ORDER BY dimension) FROM (SELECT DISTINCT dimension FROM scores)) AS dimensions,
      (SELECT '{{' || string_agg('"' || dimension || '":"' || level || '"', ',' ORDER BY dimension) || '}}' FROM levels) AS weights
      FROM ({SQL_SUMMARY}) s, range(2)""",
)
def append_run_log(d: Data):
    """Two runs appended to the run log and read back."""
    path, run = scratch(d, "runs"), analysis(d)
    scores = run.scores().cache()
    record = sinks.run_record(run.scorecard(weights(d), scores=scores), scores, weights(d), purpose=PURPOSE, source="orders")
    for _ in range(2):
        sinks.append_run_log(record, path)
    scores.unpersist()
    return d.spark.read.parquet(path)
