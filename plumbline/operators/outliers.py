"""Statistical outliers of one column: quartile fences, exact quantiles for any table size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_missing, number
from plumbline.operators.rules import percent_ok

HELD = 1_000_000  # values among which a place is looked up at once; the answer doesn't depend on it


def number_of(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    data_type = dict(df.dtypes)[column]
    return F.when(~is_missing(c, data_type), number(c))


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], held: int = HELD) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns in a few passes, with bounded memory for any table size.

    A sketch of all columns brackets every wanted place, one aggregate counts the values below and inside all brackets,
    and one takes the exact place among the values inside. Counts decide whether a bracket holds its place; one that
    doesn't is widened, and one with more than ``held`` values is bracketed again inside. NULL without values.
    """
    values = df.select(*[number_of(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    points = [_Point(i, p) for i in range(len(columns)) for p in probabilities]
    # the first brackets of a column come from one sketch of it
    whole = [F.percentile_approx(f"v{i}", F.array(*[F.lit(f) for x in points if x.column == i for f in x.fractions()]), 10000) for i in range(len(columns))]
    start = values.agg(*[F.struct(F.count(f"v{i}"), q).alias(f"s{i}") for i, q in enumerate(whole)]).first()
    for k, x in enumerate(points):
        size, ends = start[f"s{x.column}"]
        at = 2 * (k % len(probabilities))
        x.bracket(size, ends and ends[at : at + 2])
    open_ = points
    while open_:
        open_ = [x for x in open_ if x.size]
        if open_:
            counts = values.agg(
                *[F.count_if(x.value() < x.low).alias(f"b{k}") for k, x in enumerate(open_)],
                *[F.count_if((x.value() >= x.low) & (x.value() <= x.high)).alias(f"i{k}") for k, x in enumerate(open_)],
            ).first()
            for k, x in enumerate(open_):
                x.count(counts[f"b{k}"], counts[f"i{k}"])
        open_ = [x for x in points if not x.settled(held)]
        if open_:
            again = values.agg(*[F.percentile_approx(x.inside(), F.array(*map(F.lit, x.fractions())), 10000).alias(f"q{k}") for k, x in enumerate(open_)]).first()
            for k, x in enumerate(open_):
                x.bracket(x.size, again[f"q{k}"])
    found = [x for x in points if x.size and x.low < x.high]
    exact = values.agg(*[F.percentile(x.inside(), F.lit(x.place())).alias(f"q{k}") for k, x in enumerate(found)]).first() if found else None
    answer = {id(x): exact[f"q{k}"] for k, x in enumerate(found)}
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for x in points:
        out[columns[x.column]].append(answer.get(id(x), x.low if x.size else None))
    return out


class _Point:
    """One wanted place of one column, and the values between which it lies."""

    def __init__(self, column: int, probability: float):
        self.column, self.probability = column, probability
        self.low, self.high, self.size = -math.inf, math.inf, None
        self.below, self.within, self.slack, self.stuck = 0, None, 3e-4, False

    def value(self) -> Column:
        return F.col(f"v{self.column}")

    def inside(self) -> Column:
        return F.when((self.value() >= self.low) & (self.value() <= self.high), self.value())

    def position(self) -> float:
        return self.probability * (self.size - 1)

    def place(self) -> float:
        """The place among the values inside, 0 to 1."""
        return min(max((self.position() - self.below) / max(self.within - 1, 1), 0.0), 1.0)

    def fractions(self) -> list[float]:
        at = self.probability if self.within is None else self.place()
        return [max(at - self.slack, 0.0), min(at + self.slack, 1.0)]

    def bracket(self, size: int, ends: list[float] | None) -> None:
        self.size, self.before = size, (self.low, self.high, self.below, self.within)
        if size:
            at = self.fractions()
            self.low = ends[0] if at[0] > 0 else self.low
            self.high = ends[1] if at[1] < 1 else self.high

    def count(self, below: int, within: int) -> None:
        if below <= math.floor(self.position()) and math.ceil(self.position()) < below + within:
            shrunk = self.before[3] is None or within < self.before[3]
            self.below, self.within = below, within
            self.stuck = not shrunk
        else:  # the sketch missed the place
            self.low, self.high, self.below, self.within = self.before
            self.slack *= 4

    def settled(self, held: int) -> bool:
        return not self.size or self.within is not None and (self.low == self.high or self.within <= held or self.stuck)


def fences(df: DataFrame, column: str, factor: float = 1.5, method: str = "exact") -> DataFrame:
    """One row: lower and upper fence, NULL when the column has fewer than two distinct values."""
    v = number_of(df, column)
    spread = F.min(v).alias("lo"), F.max(v).alias("hi")
    if method == "exact":
        quartiles = F.array(*[F.lit(q).cast("double") for q in exact_quantiles(df, [column], [0.25, 0.75])[column]])
    elif method == "approx":
        quartiles = F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.75)), 10000)
    else:
        raise ValueError(f"unknown method {method!r}: exact or approx")
    stats = df.agg(*spread, quartiles.alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    varied = F.col("lo") < F.col("hi")
    return stats.select(
        F.when(varied, q1 - factor * (q3 - q1)).alias("low"), F.when(varied, q3 + factor * (q3 - q1)).alias("high")
    )


def pinned(df: DataFrame, low: float, high: float) -> DataFrame:
    """Fences of an earlier run, so that scores before and after a correction are comparable."""
    return df.sparkSession.createDataFrame([(float(low), float(high))], "low double, high double")


def _flagged(df: DataFrame, column: str, limits: DataFrame) -> Column:
    packed = limits.select(F.struct("low", "high").alias("f")).scalar()
    v = number_of(df, column)
    return F.coalesce((v < packed.getField("low")) | (v > packed.getField("high")), F.lit(False))


def iqr_issues(df: DataFrame, id_col: str, column: str, limits: DataFrame) -> DataFrame:
    return df.where(_flagged(df, column, limits)).select(
        F.col(id_col).alias("record_id"),
        F.lit(column).alias("column"),
        F.lit("reasonableness").alias("dimension"),
        F.lit("outside the quartile fences").alias("reason"),
        F.col(column).cast("string").alias("value"),
    )


def iqr_scores(df: DataFrame, column: str, limits: DataFrame) -> DataFrame:
    return (
        df.select(_flagged(df, column, limits).alias("bad"))
        .agg(F.count(F.lit(1)).alias("n_total"), F.count_if("bad").alias("n_bad"))
        .select(
            F.lit(column).alias("column"),
            F.lit("reasonableness").alias("dimension"),
            "n_total",
            "n_bad",
            percent_ok(F.col("n_total"), F.col("n_bad")).alias("score"),
        )
    )
