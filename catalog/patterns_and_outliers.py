"""Queries of majority-pattern consistency and one-column outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Data, query
from plumbline.operators import consistency as cons
from plumbline.operators import outliers as out

STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
DATE = """CASE WHEN regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'YYYY-MM-DD'
  WHEN regexp_matches({v}, '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$') THEN 'DD-MM-YYYY'
  WHEN regexp_matches({v}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN 'DD/MM/YYYY'
  WHEN regexp_matches({v}, '^[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}$') THEN 'DD.MM.YYYY' END"""
CASE = r"""CASE WHEN {v} IS NULL OR regexp_matches({v}, '^[0-9$€£¥.,\-/\s+()]+$') THEN NULL
  WHEN upper({v}) <> lower({v}) AND upper({v}) = {v} THEN 'UPPER'
  WHEN upper({v}) <> lower({v}) AND lower({v}) = {v} THEN 'lower'
  WHEN upper({v}) <> lower({v}) AND NOT regexp_matches({v}, '[\p{{Lu}}\p{{Ll}}]\p{{Lu}}')
       AND NOT regexp_matches({v}, '(^|[^\p{{Lu}}\p{{Ll}}])\p{{Ll}}') THEN 'Title' ELSE 'mixed' END"""


def labelled(view: str, column: str) -> str:
    v = STRIP.format(c=column)
    return f"""r AS (SELECT id, {column} AS value, {v} AS v, {DATE.format(v=v)} AS d,
      CASE WHEN regexp_matches({v}, '^[$€£¥]\\s*[0-9,]+(\\.[0-9]+)?$') THEN 'symbol'
           WHEN regexp_matches({v}, '^[0-9,]+(\\.[0-9]+)?$') THEN 'plain' END AS m,
      CASE WHEN regexp_matches({v}, '^[0-9\\s+\\-()]+$') THEN regexp_replace({v}, '[0-9]', 'D', 'g') END AS p,
      {CASE.format(v=v)} AS k FROM {view}),
      g AS (SELECT count(value) AS n, count(d) AS nd, count(DISTINCT d) AS kd, count(p) AS np, count(DISTINCT p) AS kp,
        count(k) AS nk, count(DISTINCT k) AS kk, count(CASE WHEN m = 'symbol' THEN 1 END) AS ns,
        count(CASE WHEN m = 'plain' THEN 1 END) AS npl FROM r),
      td AS (SELECT d AS top FROM r WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1),
      tp AS (SELECT p AS top FROM r WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1),
      tk AS (SELECT k AS top FROM r WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1),
      f AS (SELECT id AS record_id, value,
        CASE WHEN g.nd >= 0.3 * g.n AND g.kd > 1 AND d <> (SELECT top FROM td) THEN concat('date format differs from ', (SELECT top FROM td)) END AS r1,
        CASE WHEN g.nd < 0.05 * g.n AND ns > 0 AND npl > 0 AND ns <= npl AND m = 'symbol' THEN 'currency symbol among plain numbers'
             WHEN g.nd < 0.05 * g.n AND ns > 0 AND npl > 0 AND ns > npl AND m = 'plain' THEN 'plain number among currency' END AS r2,
        CASE WHEN g.nd < 0.05 * g.n AND np >= 0.7 * g.n AND np >= 5 AND kp > 1 AND p <> (SELECT top FROM tp)
             THEN concat('phone shape differs from ', (SELECT top FROM tp)) END AS r3,
        CASE WHEN nk >= 3 AND kk > 1 AND k <> (SELECT top FROM tk) THEN concat('casing differs from ', (SELECT top FROM tk)) END AS r4
        FROM r, g)"""


def detector(name: str, column: str, kind: str, field: str):
    sql = f"WITH {labelled('customers', column)} SELECT record_id, value, {field} AS reason FROM f WHERE {field} IS NOT NULL"

    @query(name, sql, ("customers",))
    def run(d: Data):
        return cons.consistency_findings(d.view("customers"), "id", column, kind)


detector("consistency_date_format", "joined", "date_format", "r1")
detector("consistency_currency", "credit", "currency", "r2")
detector("consistency_phone_shape", "phone", "phone_shape", "r3")
detector("consistency_casing", "segment", "casing", "r4")


@query(
    "consistency_combined",
    f"""WITH {labelled('customers', 'credit')}, a AS (SELECT record_id, value, coalesce(r1, r2, r3, r4) AS reason FROM f),
      b AS (SELECT 'credit' AS c, count(DISTINCT record_id) AS n_bad FROM a WHERE reason IS NOT NULL)
      SELECT c AS "column", 'consistency' AS dimension, n AS n_total, n_bad, round((n - n_bad) / n * 100.0, 4) AS score
      FROM b, (SELECT count(*) AS n FROM customers)""",
    ("customers",),
)
def consistency_combined(d: Data):
    """Score of a column over all four detectors, one issue per record."""
    return cons.consistency_scores(d.view("customers"), "id", "credit")


IQR = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
  SELECT event_id AS record_id, 'value' AS "column", 'reasonableness' AS dimension, 'outside the quartile fences' AS reason,
  cast(value AS string) AS value FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""


@query("outliers_iqr", IQR)
def outliers_iqr(d: Data):
    """Events outside the quartile fences, exact quartiles."""
    events = d.table("events")
    return out.iqr_issues(events, "event_id", "value", out.fences(events, "value"))


@query(
    "outliers_iqr_at_scale",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
    SELECT 'l_extendedprice' AS "column", 'reasonableness' AS dimension, count(*) AS n_total,
      count(CASE WHEN l_extendedprice < q1 - 0.3 * (q3 - q1) OR l_extendedprice > q3 + 0.3 * (q3 - q1) THEN 1 END) AS n_bad,
      round((count(*) - count(CASE WHEN l_extendedprice < q1 - 0.3 * (q3 - q1) OR l_extendedprice > q3 + 0.3 * (q3 - q1) THEN 1 END))
        / count(*) * 100.0, 4) AS score FROM lineitem, q""",
)
def outliers_iqr_at_scale(d: Data):
    """Exact fences with bounded memory: ranks are found by narrowing value intervals."""
    lineitem = d.table("lineitem")
    q1, q3 = out.exact_quantiles(lineitem, ["l_extendedprice"], [0.25, 0.75], held=5000)["l_extendedprice"]
    limits = out.pinned(lineitem, q1 - 0.3 * (q3 - q1), q3 + 0.3 * (q3 - q1))
    return out.iqr_scores(lineitem, "l_extendedprice", limits)
