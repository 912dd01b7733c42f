"""Row rules: every rule becomes one predicate; all predicates share one scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dates import DEFAULT_FORMATS, moment, parse_date
from plumbline.functions.reasons import REASONS
from plumbline.functions.text import is_missing, number

ALLOWED_PARAMS = {
    "completeness": set(),
    "uniqueness": set(),
    "validity": {"allowed_values", "pattern", "format"},
    "consistency": set(),
    "accuracy": {"min_value", "max_value", "reference_values"},
    "validity_period": {"date_from", "date_to", "obsolete_values", "formats"},
    "precision": {"decimals", "min_length", "max_length"},
    "timeliness": {"max_age_days", "as_of", "formats"},
    "referential_integrity": {"reference_values", "reference", "reference_column"},
    "reasonableness": {"method", "iqr_factor", "model_columns", "contamination", "bounds"},
    "similarity": {"algorithm", "threshold", "normalise", "blocking"},
}
DIMENSIONS = list(ALLOWED_PARAMS)
JOINED_LIST = 1000  # longer lists are joined instead of written into the plan; the findings are the same


@dataclass(frozen=True)
class Rule:
    """One check of one column. ``params`` are validated, unknown names are an error."""

    column: str
    dimension: str
    params: dict[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.dimension not in ALLOWED_PARAMS:
            raise ValueError(f"unknown dimension {self.dimension!r}; known: {DIMENSIONS}")
        unknown = set(self.params) - ALLOWED_PARAMS[self.dimension]
        if unknown:
            raise ValueError(f"unknown parameters for {self.dimension}: {sorted(unknown)}")

    @classmethod
    def of(cls, column: str, dimension: str, **params: Any) -> "Rule":
        return cls(column, dimension, params)


@dataclass(frozen=True)
class Check:
    """A compiled row rule: which rows are bad and why."""

    rule: Rule
    bad: Column
    reason: Column


def check_columns(df: DataFrame, id_col: str, rules: list[Rule]) -> None:
    for name in [id_col, *(r.column for r in rules)]:
        if name not in df.columns:
            raise ValueError(f"column {name!r} is not in the table: {df.columns}")


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _in_list(value: Column, values) -> Column:
    return value.cast("string").isin([str(v) for v in values])




def _outside(value: Column, low, high) -> Column:
    parts = [value < low] if low is not None else []
    parts += [value > high] if high is not None else []
    return reduce(lambda a, b: a | b, parts)


def _span(low, high) -> str:
    return ", ".join([f"min={low}"] * (low is not None) + [f"max={high}"] * (high is not None))


def list_reason(rule: Rule) -> str:
    """Why a value that a list or reference lacks is bad, whatever the length of the list and the way it is joined."""
    if rule.dimension == "accuracy":
        return "not in the reference list"
    values = rule.params.get("allowed_values")
    if values is None:
        return "not in the reference table"
    shown = ", ".join(str(v) for v in values[:10]) + (f" and {len(values) - 10} more" if len(values) > 10 else "")
    return f"not an allowed value; allowed: {shown}"


def _validity(rule: Rule, c: Column) -> tuple[Column, Column] | None:
    values, pattern = rule.params.get("allowed_values"), rule.params.get("pattern")
    if values is not None:
        return ~_in_list(c, values), F.lit(list_reason(rule))
    if pattern is not None:
        text = c.cast("string")
        why = REASONS.get(rule.params.get("format"))
        reason = F.concat(F.lit(f"invalid {rule.params.get('format')}: "), why(text)) if why else F.lit("invalid format")
        return ~text.rlike(rf"^(?:{pattern})\z"), reason
    return None


def _accuracy(rule: Rule, c: Column) -> tuple[Column, Column] | None:
    p = rule.params
    if p.get("reference_values") is not None:
        return ~_in_list(c, p["reference_values"]), F.lit(list_reason(rule))
    low, high = p.get("min_value"), p.get("max_value")
    if low is None and high is None:
        return None
    return _outside(number(c), low, high), F.lit(f"outside the range ({_span(low, high)})")


def _precision(rule: Rule, c: Column) -> tuple[Column, Column] | None:
    p = rule.params
    if p.get("decimals") is not None:
        exact = c.try_cast("double")
        scaled = exact * float(10 ** p["decimals"])
        return exact.isNull() | ((scaled % 1) != 0), F.lit(f"more than {p['decimals']} decimals")
    low, high = p.get("min_length"), p.get("max_length")
    if low is None and high is None:
        return None
    return (
        _outside(F.char_length(c.cast("string")), low, high),
        F.lit(f"text length outside the range ({_span(low, high)})"),
    )


def _validity_period(rule: Rule, c: Column, data_type: str) -> tuple[Column, Column] | None:
    p = rule.params
    start, end = p.get("date_from"), p.get("date_to")
    if start is not None or end is not None:
        when = parse_date(c, data_type, p.get("formats", DEFAULT_FORMATS))
        low = moment(start) if start is not None else None
        high = moment(end) if end is not None else None
        return _outside(when, low, high), F.lit(f"date outside the period ({_span(start, end)})")
    if p.get("obsolete_values") is not None:
        return _in_list(c, p["obsolete_values"]), F.lit("obsolete value")
    return None


def _timeliness(rule: Rule, c: Column, data_type: str) -> tuple[Column, Column] | None:
    days = rule.params.get("max_age_days")
    if days is None:
        return None
    limit = moment(rule.params.get("as_of")) - F.make_dt_interval(F.lit(int(days)))
    when = parse_date(c, data_type, rule.params.get("formats", DEFAULT_FORMATS))
    return when < limit, F.lit(f"older than {int(days)} days")


def compile_rule(df: DataFrame, rule: Rule) -> Check | None:
    """Predicate of a row rule; None when the parameters ask for nothing (score 100)."""
    c, data_type = F.col(rule.column), _types(df)[rule.column]
    missing = is_missing(c, data_type)
    if rule.dimension == "completeness":
        return Check(rule, missing, F.lit("missing value"))
    if rule.dimension == "referential_integrity":
        made = (~_in_list(c, rule.params["reference_values"]), F.lit("not in the reference table"))
    elif rule.dimension in ("validity_period", "timeliness"):
        maker = _validity_period if rule.dimension == "validity_period" else _timeliness
        made = maker(rule, c, data_type)
    else:
        made = {"validity": _validity, "accuracy": _accuracy, "precision": _precision}[rule.dimension](rule, c)
    if made is None:
        return None
    bad, reason = made
    return Check(rule, F.coalesce(~missing & bad, F.lit(False)), reason)


def reference_values(df: DataFrame, rule: Rule) -> DataFrame | None:
    """Reference side of a lookup rule as a one-column table, or None for an inline list."""
    p = rule.params
    if p.get("reference") is not None:
        name = p.get("reference_column") or p["reference"].columns[0]
        return p["reference"].select(F.col(name).cast("string").alias("value")).distinct()
    for key in ("reference_values", "allowed_values"):
        values = p.get(key)
        if values is not None and len(values) > JOINED_LIST:
            rows = [(str(v),) for v in set(values)]
            return df.sparkSession.createDataFrame(rows, "value string")
    return None


def row_issues(df: DataFrame, id_col: str, checks: list[Check]) -> DataFrame:
    """Issues of all row rules in one pass: an array of findings per row, exploded."""
    if not checks:
        return empty_issues(df, id_col)
    findings = F.array(
        *[
            F.when(
                k.bad,
                F.struct(
                    F.lit(k.rule.column).alias("column"),
                    F.lit(k.rule.dimension).alias("dimension"),
                    k.reason.alias("reason"),
                    F.col(k.rule.column).cast("string").alias("value"),
                ),
            )
            for k in checks
        ]
    )
    return df.select(F.col(id_col).alias("record_id"), F.explode(F.array_compact(findings)).alias("f")).select(
        "record_id", "f.*"
    )


def empty_issues(df: DataFrame, id_col: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.col(id_col).alias("record_id"), *[none.alias(n) for n in ("column", "dimension", "reason", "value")]
    ).where(F.lit(False))


def percent_ok(total: Column, bad: Column) -> Column:
    return F.when(total > 0, F.round((total - bad) / total * 100, 4)).otherwise(F.lit(100.0))


def score_rows(stats: DataFrame, entries: list[tuple[Rule, Column, Column]]) -> DataFrame:
    """Unpivot a one-row aggregate to (column, dimension, n_total, n_bad, score)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(rule.column).alias("column"),
                F.lit(rule.dimension).alias("dimension"),
                total.cast("bigint").alias("n_total"),
                bad.cast("bigint").alias("n_bad"),
            )
            for rule, total, bad in entries
        ]
    )
    return stats.select(F.explode(rows).alias("s")).select("s.*").withColumn(
        "score", percent_ok(F.col("n_total"), F.col("n_bad"))
    )


def row_scores(df: DataFrame, checks: list[Check], idle: list[Rule] = ()) -> DataFrame:
    """Scores of all row rules from one aggregate; ``idle`` rules have nothing to check."""
    bads = [F.count_if(k.bad).alias(f"b{i}") for i, k in enumerate(checks)]
    stats = df.agg(F.count(F.lit(1)).alias("n"), *bads)
    entries = [(k.rule, F.col("n"), F.col(f"b{i}")) for i, k in enumerate(checks)]
    entries += [(rule, F.col("n"), F.lit(0)) for rule in idle]
    return score_rows(stats, entries)


def unknown_values(df: DataFrame, rule: Rule, reference: DataFrame) -> DataFrame:
    """(value, n) of the values absent from the reference; rows are pre-aggregated before any join."""
    c = F.col(rule.column)
    counts = (
        df.where(~is_missing(c, _types(df)[rule.column]))
        .groupBy(c.cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.join(reference, "value", "left_anti")


def lookup_issues(df: DataFrame, id_col: str, rule: Rule, reference: DataFrame) -> DataFrame:
    bad = unknown_values(df, rule, reference).select("value")
    rows = df.select(F.col(id_col).alias("record_id"), F.col(rule.column).cast("string").alias("value"))
    return rows.join(bad, "value", "left_semi").select(
        "record_id",
        F.lit(rule.column).alias("column"),
        F.lit(rule.dimension).alias("dimension"),
        F.lit(list_reason(rule)).alias("reason"),
        "value",
    )


def lookup_scores(df: DataFrame, rule: Rule, reference: DataFrame) -> DataFrame:
    bad = unknown_values(df, rule, reference).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("b"))
    stats = df.agg(F.count(F.lit(1)).alias("n")).select("n", bad.scalar().alias("b"))
    return score_rows(stats, [(rule, F.col("n"), F.col("b"))])
