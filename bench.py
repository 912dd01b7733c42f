"""Time the headline queries: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores). Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from check import session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def headline():
    from catalog.base import Data
    from plumbline.operators import profile as pf
    from plumbline.operators.rules import Rule
    from plumbline.plans.analysis import Analysis

    def lineitem_rules(spark):
        """Nine row rules on lineitem: issues and scores."""
        lines = Data(spark, FOLDER).table("lineitem")
        rules = [
            Rule.of("l_quantity", "completeness"), Rule.of("l_quantity", "accuracy", min_value=1, max_value=45),
            Rule.of("l_extendedprice", "accuracy", min_value=0, max_value=100000), Rule.of("l_discount", "precision", decimals=1),
            Rule.of("l_returnflag", "validity", allowed_values=["A", "N"]), Rule.of("l_linestatus", "validity", pattern="[OF]"),
            Rule.of("l_shipdate", "validity_period", date_from="1996-01-01"), Rule.of("l_shipdate", "timeliness", max_age_days=1000, as_of="2001-12-31"),
            Rule.of("l_tax", "completeness"),
        ]
        run = Analysis(lines, "l_orderkey", rules)
        return run.issues().groupBy("column", "dimension").count().collect() + run.scores().collect()

    def lineitem_profile(spark):
        return pf.numeric_profile(Data(spark, FOLDER).table("lineitem")).collect()

    def lineitem_integrity(spark):
        d = Data(spark, FOLDER)
        rules = [Rule.of("l_partkey", "referential_integrity", reference=d.table("part"), reference_column="p_partkey")]
        return Analysis(d.table("lineitem"), "l_orderkey", rules).scores().collect()

    return {"lineitem_rules": lineitem_rules, "lineitem_profile": lineitem_profile, "lineitem_integrity": lineitem_integrity}


CATALOGUE = [
    "verdict", "scorecard", "uniqueness_principal", "consistency_phone_shape", "outliers_iqr", "profile_text", "profile_top_values",
    "profile_masks", "profile_histogram", "suggest_validity", "sim_join_qgrams", "sim_score", "outliers_isolation_forest",
]


def main() -> None:
    from catalog.base import QUERIES
    import catalog.queries  # noqa: F401

    spark = session(CPUS)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name, fn in headline().items():
        start = time.time()
        fn(spark)
        times[name] = round(time.time() - start, 3)
    for name in CATALOGUE:
        start = time.time()
        QUERIES[name](spark, FOLDER).collect()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": FOLDER.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
