"""Registry of queries with their reference SQL, and the dirty views both sides share."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.dirt import DIRT
from plumbline.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Base tables and dirty views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        ship_package(spark)
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        bases, sql = DIRT[name]
        for base in bases:
            (self.view(base) if base in DIRT else self.table(base)).createOrReplaceTempView(base)
        return self.spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """Prefix reference SQL with the dirty views it reads."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for base in DIRT[name][0]:
            if base in DIRT:
                add(base)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = ", ".join(f"{n} AS ({DIRT[n][1]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(data)`` under ``name``; ``oracle`` may read the dirty ``views``."""

    def register(fn: Callable[[Data], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        QUERIES[name].__doc__ = inspect.getdoc(fn)
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views) if views else oracle.strip()
        return fn

    return register
