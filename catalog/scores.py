"""Queries from rules to scores, verdict and report tables.

All of them use the same five rules on orders. The reference SQL builds the same issue and score tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Data, query
from plumbline.operators import report, scoring
from plumbline.operators.rules import Rule
from plumbline.plans.analysis import Analysis

RULES = [
    Rule.of("priority", "completeness"),
    Rule.of("price", "completeness"),
    Rule.of("price", "accuracy", min_value=0, max_value=400000),
    Rule.of("status", "validity", allowed_values=["O", "F", "P"]),
    Rule.of("placed", "validity_period", date_from="1996-01-01"),
    Rule.of("custkey", "uniqueness"),
]
SQL_ISSUES = """issues AS (
  SELECT id AS record_id, 'priority' AS col, 'completeness' AS dimension, 'missing value' AS reason, cast(NULL AS string) AS value, cast(NULL AS boolean) AS is_principal FROM orders_d WHERE priority IS NULL
  UNION ALL SELECT id, 'price', 'completeness', 'missing value', NULL, NULL FROM orders_d WHERE price IS NULL
  UNION ALL SELECT id, 'price', 'accuracy', 'outside the range (min=0, max=400000)', cast(price AS string), NULL FROM orders_d WHERE price < 0 OR price > 400000
  UNION ALL SELECT id, 'status', 'validity', 'not an allowed value; allowed: O, F, P', status, NULL FROM orders_d WHERE status NOT IN ('O','F','P')
  UNION ALL SELECT id, 'placed', 'validity_period', 'date outside the period (min=1996-01-01)', strftime(placed, '%Y-%m-%d %H:%M:%S'), NULL FROM orders_d WHERE placed < TIMESTAMP '1996-01-01'
  UNION ALL SELECT id, 'custkey', 'uniqueness', CASE WHEN rn = 1 THEN 'repeated value: keep this record' ELSE 'repeated value' END, cast(custkey AS string), rn = 1
    FROM (SELECT id, custkey, count(*) OVER (PARTITION BY custkey) AS n, row_number() OVER (PARTITION BY custkey ORDER BY
      (CASE WHEN id IS NULL THEN 1 ELSE 0 END + CASE WHEN priority IS NULL THEN 1 ELSE 0 END + CASE WHEN price IS NULL THEN 1 ELSE 0 END + CASE WHEN status IS NULL THEN 1 ELSE 0 END
       + CASE WHEN placed IS NULL THEN 1 ELSE 0 END + CASE WHEN custkey IS NULL THEN 1 ELSE 0 END), cast(id AS string)) AS rn FROM orders_d) WHERE n > 1)"""
SQL_SCORES = """applied AS (SELECT * FROM (VALUES ('priority','completeness'), ('price','completeness'), ('price','accuracy'),
    ('status','validity'), ('placed','validity_period'), ('custkey','uniqueness')) t(col, dimension)),
  total AS (SELECT count(*) AS n FROM orders_d),
  scores AS (SELECT a.col, a.dimension, (SELECT n FROM total) AS n_total, count(i.col) AS n_bad,
    round(((SELECT n FROM total) - count(i.col)) / (SELECT n FROM total) * 100.0, 4) AS score
    FROM applied a LEFT JOIN issues i ON a.col = i.col AND a.dimension = i.dimension GROUP BY 1, 2)"""
SQL_LEVELS = """levels AS (SELECT * FROM (VALUES ('completeness','critical',4), ('uniqueness','high',3), ('validity','critical',4),
    ('consistency','high',3), ('accuracy','medium',2), ('validity_period','medium',2), ('precision','high',3),
    ('timeliness','low',1), ('referential_integrity','critical',4), ('reasonableness','low',1), ('similarity','medium',2))
    t(dimension, level, weight)),
  dims AS (SELECT dimension, avg(score) AS score FROM scores GROUP BY 1),
  ranked AS (SELECT d.dimension, d.score, l.level, l.weight FROM dims d JOIN levels l USING (dimension))"""
BASE = f"WITH {SQL_ISSUES}, {SQL_SCORES}, {SQL_LEVELS} "
PURPOSE = "migracion"


def analysis(d: Data) -> Analysis:
    return Analysis(d.view("orders_d"), "id", RULES)


def weights(d: Data):
    return scoring.resolve_weights(d.spark, PURPOSE)


def scored(name: str, sql: str):
    return query(name, BASE + sql, ("orders_d",))


@scored("issue_union", 'SELECT record_id, col AS "column", dimension, reason, value, is_principal FROM issues')
def issue_union(d: Data):
    """Issues of all rules under one schema."""
    return analysis(d).issues()


@scored("rule_scores", 'SELECT col AS "column", dimension, n_total, n_bad, score FROM scores')
def rule_scores(d: Data):
    """Score per column and dimension."""
    return analysis(d).scores()


@scored("score_simple_mean", "SELECT round(avg(score), 1) AS simple_mean FROM scores")
def score_simple_mean(d: Data):
    return scoring.simple_mean(analysis(d).scores())


@scored("score_by_dimension", "SELECT dimension, round(score, 4) AS score FROM dims")
def score_by_dimension(d: Data):
    return scoring.by_dimension(analysis(d).scores()).withColumn("score", F.round("score", 4))


@scored("weighted_score", "SELECT round(sum(score * weight) / sum(weight), 1) AS weighted_score FROM ranked")
def weighted_score(d: Data):
    return scoring.weighted_score(analysis(d).scores(), weights(d))


@scored("threshold_level", "SELECT dimension, level, weight FROM ranked WHERE weight = (SELECT max(weight) FROM ranked)")
def threshold_level(d: Data):
    """Dimensions at the highest level that ran."""
    return scoring.threshold_dimensions(analysis(d).scores(), weights(d)).drop("score")


@scored("records_with_problems", "SELECT count(DISTINCT record_id) AS records_with_problems FROM issues")
def records_with_problems(d: Data):
    return scoring.records_with_problems(analysis(d).issues())


@scored(
    "usable_records",
    """, u AS (SELECT count(*) AS total, count(*) - (SELECT count(DISTINCT record_id) FROM issues WHERE dimension IN
      (SELECT dimension FROM ranked WHERE weight = (SELECT max(weight) FROM ranked)) AND NOT coalesce(is_principal, false)) AS usable
      FROM orders_d) SELECT total, usable, round(usable / total * 100.0, 1) AS usable_pct FROM u""",
)
def usable_records(d: Data):
    a = analysis(d)
    return scoring.usable_records(a.df, a.issues(), a.scores(), weights(d))


WORST = "(SELECT * FROM ranked WHERE weight = (SELECT max(weight) FROM ranked) ORDER BY score, dimension LIMIT 1)"


@scored("worst_critical", f"SELECT dimension, round(score, 1) AS score FROM {WORST}")
def worst_critical(d: Data):
    return scoring.worst_critical(analysis(d).scores(), weights(d))


@scored(
    "verdict",
    f"""SELECT dimension, round(score, 1) AS score, CASE WHEN round(score, 1) < 60 THEN 'not_ready'
    WHEN round(score, 1) < 80 THEN 'at_risk' ELSE 'ready' END AS verdict FROM {WORST}""",
)
def verdict(d: Data):
    """Rules on orders, scores, weights of a purpose, verdict on the worst threshold dimension."""
    return scoring.verdict(analysis(d).scores(), weights(d))


SQL_SUMMARY = """SELECT total_records, records_with_problems,
    round((total_records - records_with_problems) / total_records * 100.0, 2) AS clean_pct, worst_dimension
    FROM (SELECT (SELECT n FROM total) AS total_records, (SELECT count(DISTINCT record_id) FROM issues) AS records_with_problems,
    (SELECT dimension FROM dims ORDER BY score, dimension LIMIT 1) AS worst_dimension)"""


@scored("summary", SQL_SUMMARY)
def summary(d: Data):
    a = analysis(d)
    return scoring.summary(a.df, a.issues(), a.scores())


@scored(
    "scorecard",
    f"""SELECT s.*, (SELECT round(avg(score), 1) FROM scores) AS simple_mean,
    (SELECT round(sum(score * weight) / sum(weight), 1) FROM ranked) AS weighted_score, u.usable,
    round(u.usable / s.total_records * 100.0, 1) AS usable_pct, w.dimension AS worst_critical,
    round(w.score, 1) AS worst_critical_score,
    CASE WHEN round(w.score, 1) < 60 THEN 'not_ready' WHEN round(w.score, 1) < 80 THEN 'at_risk' ELSE 'ready' END AS verdict
    FROM (SELECT total_records, records_with_problems, clean_pct FROM ({SQL_SUMMARY})) s,
    (SELECT count(*) - (SELECT count(DISTINCT record_id) FROM issues WHERE dimension IN
      (SELECT dimension FROM ranked WHERE weight = (SELECT max(weight) FROM ranked)) AND NOT coalesce(is_principal, false)) AS usable
      FROM orders_d) u, {WORST} w""",
)
def scorecard(d: Data):
    """One row with everything a user decides on."""
    return analysis(d).scorecard(weights(d))


OVERRIDES = [
    ("migracion", None, "timeliness", "high"),
    ("migracion", None, "similarity", "critical"),
    ("auditoria", None, "precision", "low"),
]


def overrides(d: Data):
    """Overrides of published levels."""
    return d.spark.createDataFrame(OVERRIDES, "purpose string, ai_type string, dimension string, level string")


RESOLVED = """resolved AS (SELECT dimension, CASE dimension WHEN 'timeliness' THEN 'high' WHEN 'similarity' THEN 'critical' ELSE level END AS level,
    CASE dimension WHEN 'timeliness' THEN 3 WHEN 'similarity' THEN 4 ELSE weight END AS weight FROM levels)"""


@scored(
    "resolve_weights",
    f""", {RESOLVED} SELECT r.dimension, r.level, r.weight, s.score FROM resolved r
    LEFT JOIN (SELECT dimension, round(score, 4) AS score FROM dims) s USING (dimension)""",
)
def resolve_weights(d: Data):
    """Levels of a purpose with overrides, beside the dimension scores they will weigh."""
    levels = scoring.resolve_weights(d.spark, PURPOSE, overrides=overrides(d))
    means = scoring.by_dimension(analysis(d).scores()).withColumn("score", F.round("score", 4))
    return levels.join(means, "dimension", "left").select("dimension", "level", "weight", "score")


@scored(
    "overrides_count",
    """SELECT cast(2 AS bigint) AS overrides, (SELECT count(*) FROM scores) AS rules_scored""",
)
def overrides_count(d: Data):
    """Dimensions whose level differs from the published matrix, with the number of rules they apply to."""
    levels = scoring.resolve_weights(d.spark, PURPOSE, overrides=overrides(d))
    rules = analysis(d).scores().agg(F.count(F.lit(1)))
    return scoring.overrides_count(d.spark, levels, PURPOSE).withColumn("rules_scored", rules.scalar())


@scored(
    "report_issue_detail",
    """SELECT col AS "column", dimension, cast(NULL AS string) AS group_id, record_id, reason, value,
    CASE WHEN coalesce(is_principal, false) THEN 'yes' ELSE '' END AS keep FROM issues""",
)
def report_issue_detail(d: Data):
    return report.issue_detail(analysis(d).issues())


ALL_DIMS = scoring.DIMENSIONS


@scored(
    "report_score_matrix",
    "SELECT col AS \"column\", "
    + ", ".join(f"round(max(CASE WHEN dimension = '{x}' THEN score END), 1) AS {x}" for x in ALL_DIMS)
    + ", round(avg(score), 1) AS mean_score FROM scores GROUP BY 1",
)
def report_score_matrix(d: Data):
    return report.score_matrix(analysis(d).scores())


@scored(
    "report_rating",
    """SELECT col AS "column", dimension, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'critical' END AS rating
    FROM scores""",
)
def report_rating(d: Data):
    return analysis(d).scores().select("column", "dimension", "score", report.rating(F.col("score")).alias("rating"))


def rows_of(a: Analysis):
    return a.df.agg(F.count(F.lit(1)))


@scored(
    "report_issues_by_dimension",
    """, c AS (SELECT dimension, count(*) AS issues, count(DISTINCT record_id) AS records FROM issues GROUP BY 1)
    SELECT dimension, issues, records, round(issues / (SELECT max(issues) FROM c) * 100.0, 1) AS share_of_largest,
    round(records / (SELECT n FROM total) * 100.0, 4) AS pct_of_rows FROM c""",
)
def report_issues_by_dimension(d: Data):
    a = analysis(d)
    return report.issues_by_dimension(a.issues(), rows_of(a))


@scored(
    "report_broad_rules",
    """SELECT col AS "column", dimension, count(DISTINCT record_id) AS records FROM issues GROUP BY 1, 2
    HAVING count(DISTINCT record_id) > 0.5 * (SELECT n FROM total)""",
)
def report_broad_rules(d: Data):
    a = analysis(d)
    return report.broad_rules(a.issues(), rows_of(a))


@scored(
    "report_dimension_ranking",
    """SELECT dimension, round(score, 1) AS score, (SELECT count(*) FROM issues i WHERE i.dimension = d.dimension) AS issues
    FROM dims d ORDER BY 2, 1 LIMIT 3""",
)
def report_dimension_ranking(d: Data):
    """The three worst dimensions with their issue counts."""
    a = analysis(d)
    return report.dimension_ranking(a.scores(), a.issues(), 3)


@scored(
    "report_column_ranking",
    """SELECT col AS "column", round(avg(score), 1) AS mean_score, min(score) AS worst_score FROM scores GROUP BY 1""",
)
def report_column_ranking(d: Data):
    return report.column_ranking(analysis(d).scores())


@query(
    "report_visible_whitespace",
    r"""WITH k AS (SELECT name, regexp_matches(name, '^[\s\x{A0}]') AS l, regexp_matches(name, '[\s\x{A0}]$') AS t FROM customers)
    SELECT CASE WHEN l AND t THEN 'leading and trailing space' WHEN l THEN 'leading space' WHEN t THEN 'trailing space' END AS kind,
      concat('"', replace(name, ' ', '␣'), '"') AS shown, count(*) AS n FROM k WHERE l OR t GROUP BY 1, 2""",
    ("customers",),
)
def report_visible_whitespace(d: Data):
    return report.visible_whitespace(d.view("customers"), "name")
