"""Queries of remediation, the run log and multivariate outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Data, query
from catalog.scores import RULES
from catalog.similar import MEMBERS, run_of
from plumbline.operators import forest as fo
from plumbline.operators import history as hi
from plumbline.operators import remediate as rm
from plumbline.operators import report
from plumbline.operators.consistency import consistency_issues
from plumbline.operators.uniqueness import uniqueness_issues
from plumbline.plans.analysis import Analysis


@query(
    "fix_drop_surplus",
    f"""{MEMBERS} SELECT id, entity, name, brand FROM companies WHERE id NOT IN (SELECT r.id FROM recs r JOIN keep USING (component)
      JOIN stats USING (component) WHERE r.id <> keep_id AND NOT (members >= 3 AND density < 0.6))""",
    ("companies",),
)
def fix_drop_surplus(d: Data):
    """Near-duplicates reduced to the kept record of every group."""
    run = run_of(d)
    return rm.drop_surplus(run.df, "id", run.issues(), "name")


@query(
    "fix_drop_duplicate_ids",
    """SELECT id, name, brand, size, price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN id IS NULL THEN 1 ELSE 0 END
      + CASE WHEN name IS NULL THEN 1 ELSE 0 END + CASE WHEN brand IS NULL THEN 1 ELSE 0 END + CASE WHEN size IS NULL THEN 1 ELSE 0 END,
      name NULLS FIRST, brand NULLS FIRST, size NULLS FIRST, price) AS rn, count(*) OVER (PARTITION BY id) AS n FROM parts_d)
    WHERE rn = 1 AND n > CASE WHEN n > 1 THEN n - 1 ELSE 0 END + CASE WHEN id % 150 = 1 THEN 1 ELSE 0 END""",
    ("parts_d",),
)
def fix_drop_duplicate_ids(d: Data):
    """One row per id, from the reported rows to keep; an id whose rows were all marked as not to keep goes."""
    parts = d.view("parts_d")
    issues = uniqueness_issues(parts, "id", "id")
    marked = parts.where("id % 150 = 1").select("id").distinct()
    by_hand = marked.select(
        F.col("id").alias("record_id"), F.lit("id").alias("column"), F.lit("uniqueness").alias("dimension"),
        F.lit("marked in the report").alias("reason"), F.col("id").cast("string").alias("value"), F.lit(False).alias("is_principal"),
    )
    return rm.drop_duplicate_ids(parts, "id", issues.unionByName(by_hand))


SEGMENTS = {"automobile": "AUTOMOBILE", "building": "BUILDING", "furniture": "FURNITURE", "machinery": "MACHINERY",
            "household": "HOUSEHOLD", "N/A": None, "--": None}


@query(
    "fix_map_values",
    f"""SELECT id, CASE {' '.join(f"WHEN segment = '{k}' THEN {('NULL' if v is None else repr(v))}" for k, v in SEGMENTS.items())} ELSE segment END AS segment FROM customers""",
    ("customers",),
)
def fix_map_values(d: Data):
    """Catalogue values remapped, some cleared."""
    return rm.map_values(d.view("customers").select("id", "segment"), "segment", SEGMENTS)


@query(
    "fix_dates_iso",
    r"SELECT id, regexp_replace(joined, '^([0-9]{2})/([0-9]{2})/([0-9]{4})$', '\3-\2-\1') AS joined FROM customers",
    ("customers",),
)
def fix_dates_iso(d: Data):
    """DD/MM/YYYY rewritten as YYYY-MM-DD."""
    return d.view("customers").select("id", rm.iso_date(F.col("joined")).alias("joined"))


@query(
    "fix_null_out_of_range",
    "SELECT id, CASE WHEN balance < 0 OR balance > 10000 THEN NULL ELSE balance END AS balance FROM customers",
    ("customers",),
)
def fix_null_out_of_range(d: Data):
    """Values outside the range cleared."""
    return d.view("customers").select("id", rm.null_out_of_range(F.col("balance"), 0, 10000).alias("balance"))


@query(
    "fix_email_accents",
    """SELECT id, CASE WHEN contains(email, '@') THEN concat(strip_accents(regexp_extract(email, '^(.*)@', 1)), '@', regexp_extract(email, '[^@]*$')) ELSE email END AS email FROM customers""",
    ("customers",),
)
def fix_email_accents(d: Data):
    """Accents removed left of the last @."""
    return d.view("customers").select("id", rm.email_without_accents(F.col("email")).alias("email"))


SQL_PHONE = """CASE WHEN length(dg) = 11 AND dg LIKE '51%' THEN substr(dg, 3) WHEN length(dg) >= 9 THEN right(dg, 9) ELSE phone END"""


@query(
    "fix_phone",
    rf"""WITH p AS (SELECT id, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS dg, regexp_replace(phone, '^\s+|\s+$', '', 'g') AS s FROM customers),
    shapes AS (SELECT *, CASE WHEN regexp_matches(s, '^[0-9\s+\-()]+$') THEN regexp_replace(s, '[0-9]', 'D', 'g') END AS shape FROM p),
    top AS (SELECT shape FROM shapes WHERE shape IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    hit AS (SELECT id FROM shapes WHERE shape <> (SELECT shape FROM top))
    SELECT id, CASE WHEN id IN (SELECT id FROM hit) THEN {SQL_PHONE} ELSE phone END AS phone FROM shapes""",
    ("customers",),
)
def fix_phone(d: Data):
    """Phones reported for their shape reduced to nine digits."""
    customers = d.view("customers")
    found = consistency_issues(customers, "id", "phone").where(F.col("reason").startswith("phone shape"))
    return rm.fix_reported(customers.select("id", "phone"), "id", "phone", found, rm.phone_digits)


@query(
    "fix_log",
    """SELECT 'dates' AS correction, 'joined' AS "column", count(CASE WHEN regexp_matches(joined, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') THEN 1 END) AS changed FROM customers
    UNION ALL SELECT 'accents', 'email', count(CASE WHEN email LIKE '%@%' AND strip_accents(email) <> email THEN 1 END) FROM customers
    UNION ALL SELECT 'range', 'balance', count(CASE WHEN balance < 0 OR balance > 10000 THEN 1 END) FROM customers""",
    ("customers",),
)
def fix_log(d: Data):
    """Values changed per correction."""
    return rm.change_log(
        d.view("customers"),
        {
            "dates": ("joined", rm.iso_date(F.col("joined"))),
            "accents": ("email", rm.email_without_accents(F.col("email"))),
            "range": ("balance", rm.null_out_of_range(F.col("balance"), 0, 10000)),
        },
    )


@query(
    "fix_compare",
    """WITH t AS (SELECT count(*) AS n, count(CASE WHEN price < 0 OR price > 400000 THEN 1 END) AS bad, count(*) - count(price) AS gone FROM orders_d)
    SELECT 'price' AS "column", 'accuracy' AS dimension, round((n - bad) / n * 100.0, 4) AS "before", 100.0 AS "after",
      round(100.0 - round((n - bad) / n * 100.0, 4), 4) AS delta FROM t
    UNION ALL SELECT 'price', 'completeness', round((n - gone) / n * 100.0, 4), round((n - gone - bad) / n * 100.0, 4),
      round(round((n - gone - bad) / n * 100.0, 4) - round((n - gone) / n * 100.0, 4), 4) FROM t""",
    ("orders_d",),
)
def fix_compare(d: Data):
    """Scores before and after clearing out-of-range prices."""
    orders = d.view("orders_d").select("id", "price")
    rules = [r for r in RULES if r.column == "price"]
    fixed = orders.withColumn("price", rm.null_out_of_range(F.col("price"), 0, 400000))
    return rm.compare_scores(Analysis(orders, "id", rules).scores(), Analysis(fixed, "id", rules).scores())


@query(
    "history_filter",
    """SELECT run_id, purpose, file_name, score FROM runs WHERE owner = 3 AND cast(run_at AS date) BETWEEN DATE '1999-05-31' AND DATE '1999-06-30'
    AND (lower(file_name) LIKE '%file_1%' OR lower(description) LIKE '%file_1%')""",
    ("runs",),
)
def history_filter(d: Data):
    """Runs of one owner in the last 30 days whose file matches, newest first."""
    found = hi.runs_between(d.view("runs"), 3, search="FILE_1", as_of="1999-06-30")
    return found.select("run_id", "purpose", "file_name", "score")


@query(
    "history_stats",
    """SELECT count(*) AS runs, round(avg(coalesce(score, 0.0)), 1) AS mean_score, cast(sum(n_rows) AS bigint) AS total_rows, count(DISTINCT file_name) AS files FROM runs""",
    ("runs",),
)
def history_stats(d: Data):
    """Run count, mean score, rows and files."""
    return hi.run_stats(d.view("runs"))


@query(
    "history_last_n",
    "SELECT run_id, file_name, score FROM runs WHERE owner = 3 ORDER BY run_at DESC, run_id DESC LIMIT 50",
    ("runs",),
)
def history_last_n(d: Data):
    """Last 50 runs of one owner."""
    return hi.last_runs(d.view("runs"), 3).select("run_id", "file_name", "score")


MODEL = ["l_quantity", "l_extendedprice", "l_discount"]


@query("outliers_isolation_forest")
def outliers_isolation_forest(d: Data):
    """Unusual combinations of quantity, price and discount, with feature flags."""
    return fo.forest_run(d.table("lineitem"), "l_orderkey", "l_extendedprice", MODEL).issues()


# Lines outside narrow price fences stand in for the anomalies, so that SQL can name the same rows.
FLAGGED = """q AS (SELECT quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.9) AS b, quantile_cont(l_quantity, 0.1) AS c,
    quantile_cont(l_quantity, 0.9) AS e FROM lineitem),
  f AS (SELECT l_orderkey AS record_id, round(l_extendedprice, 2) AS p, l_extendedprice < a OR l_extendedprice > b AS up,
    round(l_quantity, 2) AS n, l_quantity < c OR l_quantity > e AS un FROM lineitem, q WHERE l_extendedprice > 80000)"""


def flags(d: Data):
    lines = d.table("lineitem")
    high = lines.where(F.col("l_extendedprice") > 80000).select(F.col("l_orderkey").alias("record_id"), "l_extendedprice", "l_quantity")
    return fo.feature_flags(lines, ["l_extendedprice", "l_quantity"], high)


@query(
    "outlier_feature_flags",
    f"""WITH {FLAGGED} SELECT record_id, concat('[{{"field":"l_extendedprice","value":', cast(p AS string), ',"unusual":', cast(up AS string),
    '}},{{"field":"l_quantity","value":', cast(n AS string), ',"unusual":', cast(un AS string), '}}]') AS value FROM f""",
)
def outlier_feature_flags(d: Data):
    """Value and unusual flag per field as JSON."""
    return flags(d)


@query(
    "report_outlier_text",
    f"""WITH {FLAGGED} SELECT record_id, concat('l_extendedprice: ', cast(p AS string), CASE WHEN up THEN ' (!)' ELSE ' (ok)' END,
    ' | l_quantity: ', cast(n AS string), CASE WHEN un THEN ' (!)' ELSE ' (ok)' END) AS shown FROM f""",
)
def report_outlier_text(d: Data):
    """Feature flags as readable text."""
    return report.outlier_text(flags(d))


@query(
    "report_outlier_fields",
    f"""WITH {FLAGGED} SELECT record_id, 'l_extendedprice' AS field, p AS value, up AS unusual FROM f
    UNION ALL SELECT record_id, 'l_quantity', n, un FROM f""",
)
def report_outlier_fields(d: Data):
    """Feature flags, one row per record and field."""
    return report.outlier_fields(flags(d))


