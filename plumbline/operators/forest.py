"""Multivariate outliers by an isolation forest (Liu, Ting and Zhou 2008).

The trees are grown on hash-sampled rows, at most 256 each, one Spark group per tree. Their nodes are few
(at most 100 x 511), so they travel to the tasks that score the whole table batch by batch.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.outliers import exact_quantiles, number_of
from plumbline.session import checkpointed

TREES, SAMPLE = 100, 256
MIN_ROWS = 10  # fixed value: fewer complete rows give no anomalies
NODES = "tree int, node int, feature int, split double, low int, high int, depth double"


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tree = int(key[0])
    rng = np.random.default_rng(tree)
    data = np.array(rows.sort_values("h")["x"].tolist(), dtype=float)
    limit = math.ceil(math.log2(max(len(data), 2)))
    out: list[tuple] = []
    todo = [(np.arange(len(data)), 0, None)]
    while todo:
        members, depth, parent = todo.pop()
        node = len(out)
        if parent is not None:
            out[parent[0]][parent[1]] = node
        part = data[members]
        varied = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(members) else []
        if depth >= limit or len(members) <= 1 or len(varied) == 0:
            out.append([tree, node, -1, 0.0, -1, -1, depth + mean_path(len(members))])
            continue
        feature = int(rng.choice(varied))
        split = float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        out.append([tree, node, feature, split, -1, -1, 0.0])
        low = part[:, feature] <= split
        todo.append((members[~low], depth + 1, (node, 5)))
        todo.append((members[low], depth + 1, (node, 4)))
    return pd.DataFrame(out, columns=["tree", "node", "feature", "split", "low", "high", "depth"])


def _samples(rows: DataFrame, n: int) -> DataFrame:
    """(tree, x, h): for each tree SAMPLE rows of the whole table, those with the lowest hashes of record and tree.

    One hash per row picks a pool with some rows to spare for all trees, whatever the table's size; only rows of the pool
    are hashed for each tree, and only the lowest of those are sent. Should a tree lack rows, both parts are widened.
    """
    span = 1 << 40
    share = 2 * SAMPLE / n
    while True:
        pool = min(TREES * share, 1.0)
        low = F.lit(int(min(share / pool, 1.0) * span))
        drawn = rows.where(F.pmod(F.xxhash64("record_id", "x"), F.lit(span)) < F.lit(int(pool * span)))
        hashed = lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64("record_id", "x", t), F.lit(span)).alias("h"))
        trees = F.filter(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), hashed), lambda s: s["h"] < low)
        order = Window.partitionBy("tree").orderBy("h", "x")
        ranked = drawn.select("x", F.explode(trees).alias("s")).select("s.tree", "x", "s.h").withColumn("r", F.row_number().over(order))
        chosen = checkpointed(ranked.where(F.col("r") <= SAMPLE).drop("r"))
        if share >= 1 or chosen.count() == TREES * SAMPLE:
            return chosen
        share *= 8


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores. A table of fewer files than cores is shuffled once, as scoring costs more than that."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _scorer(nodes: pd.DataFrame, sample: int, columns: list[str]) -> Column:
    """Anomaly of the ``columns``, a batch of rows at a time; the leaves are reached level by level in each tree."""
    packed = []
    for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
        leaf, own = g.feature.to_numpy() < 0, g.node.to_numpy()  # a leaf leads to itself, so all rows take equal steps
        ways = np.stack([np.where(leaf, own, g.high), np.where(leaf, own, g.low)], axis=1).ravel()
        steps = math.ceil(math.log2(max(sample, 2)))
        packed.append((np.maximum(g.feature.to_numpy(), 0), g.split.to_numpy(), ways, g.depth.to_numpy(), steps))
    norm = mean_path(sample)

    @F.pandas_udf(T.DoubleType())
    def score(*x: pd.Series) -> pd.Series:
        data = np.column_stack([c.to_numpy(dtype=float) for c in x])
        total, rows = np.zeros(len(data)), np.arange(len(data)) * data.shape[1]
        for feature, split, ways, depth, steps in packed:
            at = np.zeros(len(data), dtype=np.int64)
            for _ in range(steps):
                at = ways.take(2 * at + (data.take(rows + feature.take(at)) <= split.take(at)))
            total += depth[at]
        return pd.Series(np.power(2.0, -total / len(packed) / norm))

    return score(*[F.col(c).cast("double") for c in columns])


class ForestRun:
    """One run over a table: scores of complete rows, flagged rows, issues with feature flags, dimension score."""

    def __init__(self, df: DataFrame, id_col: str, target: str, columns: list[str], contamination: float = 0.05):
        self.df, self.id_col, self.target, self.columns, self.contamination = df, id_col, target, columns, contamination
        self.shown = list(dict.fromkeys([target, *columns]))

    @cached_property
    def complete(self) -> DataFrame:
        values = [number_of(self.df, c).alias(c) for c in self.shown]
        rows = self.df.select(F.col(self.id_col).alias("record_id"), *values)
        return rows.where(~F.greatest(*[F.col(c).isNull() for c in self.columns]))

    @cached_property
    def scored(self) -> DataFrame:
        """(record_id, shown columns, anomaly); empty below the smallest table size."""
        x = F.array(*[F.col(c) for c in self.columns]).alias("x")
        rows = self.complete.select("*", x)
        n = rows.count()
        if n < MIN_ROWS:
            return rows.drop("x").withColumn("anomaly", F.lit(0.0)).where(F.lit(False))
        chosen = _samples(rows, n)
        nodes = chosen.select("tree", "x", "h").groupBy("tree").applyInPandas(_grow, NODES).toPandas()
        size = min(SAMPLE, n)
        return checkpointed(_spread(self.complete).withColumn("anomaly", _scorer(nodes, size, self.columns)))

    @cached_property
    def cut(self) -> float | None:
        return exact_quantiles(self.scored, ["anomaly"], [1 - self.contamination])["anomaly"][0]

    def flagged(self) -> DataFrame:
        return self.scored.where(F.col("anomaly") > F.lit(self.cut)) if self.cut is not None else self.scored

    def issues(self) -> DataFrame:
        flags = feature_flags(self.df, self.shown, self.flagged())
        return flags.select(
            "record_id",
            F.lit(self.target).alias("column"),
            F.lit("reasonableness").alias("dimension"),
            F.lit("unusual combination of values").alias("reason"),
            "value",
        )

    def scores(self) -> DataFrame:
        total = self.df.agg(F.count(number_of(self.df, self.target)).alias("n_total"))
        bad = self.flagged().agg(F.count(F.lit(1)))
        score = F.when(F.col("n_total") > 0, F.round((1 - F.col("n_bad") / F.col("n_total")) * 100, 1)).otherwise(100.0)
        return total.select(
            F.lit(self.target).alias("column"), F.lit("reasonableness").alias("dimension"), "n_total", bad.scalar().alias("n_bad")
        ).withColumn("score", score)


def forest_run(df: DataFrame, id_col: str, target: str, columns: list[str], contamination: float = 0.05) -> ForestRun | None:
    """A forest run, or None when fewer than two of the columns are numeric (quartile fences apply then)."""
    types = dict(df.dtypes)
    numeric = [c for c in columns if types.get(c, "").startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))]
    return ForestRun(df, id_col, target, numeric, contamination) if len(numeric) >= 2 else None


def feature_flags(df: DataFrame, shown: list[str], anomalies: DataFrame, quantiles: str = "exact") -> DataFrame:
    """(record_id, value): JSON list of field, value and whether it lies outside the 10th to 90th percentile."""
    from plumbline.operators.profile import quantile_columns

    points = quantile_columns(df, shown, [0.1, 0.9], quantiles)
    both = [points[c] for c in shown]
    limits = df.agg(F.struct(*[q.alias(c) for q, c in zip(both, shown)]))
    with_limits = anomalies.withColumn("__q", limits.scalar())
    items = []
    for c in shown:
        v, q = F.col(c).cast("double"), F.col("__q").getField(c)
        unusual = F.coalesce((v < q[0]) | (v > q[1]), F.lit(False))
        items.append(F.struct(F.lit(c).alias("field"), F.round(v, 2).alias("value"), unusual.alias("unusual")))
    return with_limits.select("record_id", F.to_json(F.array(*items), {"ignoreNullFields": "false"}).alias("value"))
