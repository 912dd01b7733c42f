"""Row rules on a stream: they keep no state, so the batch expressions run unchanged on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.rules import Rule, check_columns, compile_rule, row_issues


def stream_issues(stream: DataFrame, id_col: str, rules: list[Rule]) -> DataFrame:
    """Issues of the row rules of a streaming table. Group rules need the whole table and are refused."""
    check_columns(stream, id_col, rules)
    checks = []
    for rule in rules:
        if rule.dimension in ("uniqueness", "consistency", "reasonableness", "similarity"):
            raise ValueError(f"{rule.dimension} needs the whole table and cannot run on a stream")
        if rule.params.get("reference") is not None:
            raise ValueError("lookup rules need the whole table and cannot run on a stream")
        check = compile_rule(stream, rule)
        if check is not None:
            checks.append(check)
    return row_issues(stream, id_col, checks)


def write_stream_issues(issues: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the issues to a folder partitioned by dimension; runs until the available input is used up."""
    return (
        issues.writeStream.format("parquet").partitionBy("dimension").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
