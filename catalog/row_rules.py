"""Queries of the row-rule dimensions and exact duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Data, query
from plumbline.functions.reasons import REASONS
from plumbline.functions.text import is_placeholder, mask
from plumbline.operators import uniqueness as uq
from plumbline.operators.rules import (
    Rule,
    compile_rule,
    lookup_issues,
    reference_values,
    row_issues,
)

STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
ISSUE = "id AS record_id, '{column}' AS \"column\", '{dimension}' AS dimension, {reason} AS reason, cast({column} AS string) AS value"


def issues_of(df, rule: Rule, id_col: str = "id"):
    reference = reference_values(df, rule)
    if reference is not None:
        return lookup_issues(df, id_col, rule, reference)
    return row_issues(df, id_col, [compile_rule(df, rule)])


def row_rule(name: str, view: str, rule: Rule, bad: str, reason: str):
    """Register a row rule on a dirty view: all offending rows with their reason."""
    select = ISSUE.format(column=rule.column, dimension=rule.dimension, reason=reason)

    @query(name, f"SELECT {select} FROM {view} WHERE {bad}", (view,))
    def run(d: Data):
        return issues_of(d.view(view), rule)


EMAIL = r"[a-zA-Z0-9._+\-ñÑ]+@[a-zA-Z0-9\-ñÑ]+(\.[a-zA-Z0-9\-ñÑ]+)+"

row_rule("completeness", "customers", Rule.of("name", "completeness"), "name IS NULL", "'missing value'")
row_rule(
    "validity_allowed_values",
    "customers",
    Rule.of("segment", "validity", allowed_values=["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]),
    "segment NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','MACHINERY','HOUSEHOLD')",
    "'not an allowed value; allowed: AUTOMOBILE, BUILDING, FURNITURE, MACHINERY, HOUSEHOLD'",
)
row_rule(
    "validity_regex",
    "customers",
    Rule.of("email", "validity", pattern=EMAIL),
    f"NOT regexp_full_match(email, '{EMAIL}')",
    "'invalid format'",
)
row_rule(
    "accuracy_range",
    "customers",
    Rule.of("balance", "accuracy", min_value=0, max_value=10000),
    "balance < 0 OR balance > 10000",
    "'outside the range (min=0, max=10000)'",
)
row_rule(
    "accuracy_reference",
    "orders_d",
    Rule.of("status", "accuracy", reference_values=["O", "F", "P"]),
    "status NOT IN ('O','F','P')",
    "'not in the reference list'",
)
row_rule(
    "precision_decimals",
    "customers",
    Rule.of("credit", "precision", decimals=1),
    "credit IS NOT NULL AND (try_cast(credit AS double) IS NULL OR (try_cast(credit AS double) * 10) % 1 <> 0)",
    "'more than 1 decimals'",
)
row_rule(
    "precision_length",
    "parts_d",
    Rule.of("name", "precision", min_length=12, max_length=17),
    "length(name) < 12 OR length(name) > 17",
    "'text length outside the range (min=12, max=17)'",
)
row_rule(
    "validity_period_obsolete",
    "orders_d",
    Rule.of("priority", "validity_period", obsolete_values=["4-NOT SPECIFIED", "5-LOW"]),
    "priority IN ('4-NOT SPECIFIED','5-LOW')",
    "'obsolete value'",
)

# Text dates in three written formats.
PARSED = (
    "coalesce(try_strptime(joined, '%Y-%m-%d'), try_strptime(joined, '%d/%m/%Y'), try_strptime(joined, '%d.%m.%Y'))"
)
row_rule(
    "validity_period_dates",
    "customers",
    Rule.of("joined", "validity_period", date_from="2014-01-01", date_to="2024-06-30"),
    f"{PARSED} < TIMESTAMP '2014-01-01' OR {PARSED} > TIMESTAMP '2024-06-30'",
    "'date outside the period (min=2014-01-01, max=2024-06-30)'",
)
row_rule(
    "timeliness",
    "customers",
    Rule.of("joined", "timeliness", max_age_days=365, as_of="2025-01-01"),
    f"{PARSED} < TIMESTAMP '2025-01-01' - INTERVAL 365 DAY",
    "'older than 365 days'",
)


@query(
    "referential_integrity",
    """SELECT id AS record_id, 'custkey' AS "column", 'referential_integrity' AS dimension,
       'not in the reference table' AS reason, cast(custkey AS string) AS value
       FROM orders_d WHERE custkey IS NOT NULL AND custkey NOT IN (SELECT c_custkey FROM customer)""",
    ("orders_d",),
)
def referential_integrity(d: Data):
    """Orders of customers that do not exist."""
    rule = Rule.of("custkey", "referential_integrity", reference=d.table("customer"), reference_column="c_custkey")
    return issues_of(d.view("orders_d"), rule)


def reason_query(name: str, column: str, kind: str, good: str, sql_case: str):
    """Register the reasons of a failing format, with the number of rows per reason."""
    v = STRIP.format(c=column)
    pattern = good.replace("'", "''")
    oracle = f"""
      SELECT CASE {sql_case.replace('$v', v)} ELSE 'other' END AS reason, count(*) AS n
      FROM customers WHERE {column} IS NOT NULL AND NOT regexp_full_match({column}, '{pattern}') GROUP BY 1"""

    @query(name, oracle, ("customers",))
    def run(d: Data):
        c = F.col(column)
        bad = d.view("customers").where(c.isNotNull() & ~c.rlike(rf"^(?:{good})\z"))
        return bad.groupBy(REASONS[kind](c).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


DOMAIN = "regexp_extract($v, '[^@]*$')"
reason_query(
    "reason_email", "email", "email", EMAIL,
    f"""WHEN $v = '' THEN 'empty' WHEN contains($v, ' ') THEN 'contains spaces' WHEN NOT contains($v, '@') THEN 'no @'
    WHEN length($v) - length(replace($v, '@', '')) > 1 THEN 'more than one @' WHEN $v LIKE '@%' THEN 'no user before the @'
    WHEN $v LIKE '%@' THEN 'no domain after the @' WHEN NOT contains({DOMAIN}, '.') THEN 'no dot in the domain'
    WHEN contains($v, '..') THEN 'two dots in a row'
    WHEN regexp_matches($v, '[áéíóúàèìòùâêîôûäëïöüÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ]') THEN 'accented vowel'""",
)
PHONE = r"\+?[\d\s\-\(\)]{7,15}"
reason_query(
    "reason_phone", "phone", "phone", PHONE,
    r"""WHEN $v = '' THEN 'empty'
    WHEN regexp_matches($v, '\p{L}') THEN concat('letter ', regexp_extract($v, '\p{L}'))
    WHEN regexp_matches($v, '[^0-9 +\-()]') THEN concat('character ', regexp_extract($v, '[^0-9 +\-()]'))
    WHEN length(regexp_replace($v, '[^0-9]', '', 'g')) < 7
      THEN concat('only ', cast(length(regexp_replace($v, '[^0-9]', '', 'g')) AS string), ' digits')
    WHEN length($v) > 15 THEN concat(cast(length($v) AS string), ' characters')""",
)
URL = r"https?://[^\s/$.?#].[^\s]*"
reason_query(
    "reason_url", "website", "url", URL,
    """WHEN $v = '' THEN 'empty' WHEN contains($v, ' ') THEN 'contains spaces'
    WHEN NOT regexp_matches($v, '^https?://') THEN 'no http:// or https://'""",
)
TAX_ID = r"\d+[-]?\d*"
reason_query(
    "reason_tax_id", "tax_id", "tax_id", TAX_ID,
    r"""WHEN $v = '' THEN 'empty'
    WHEN regexp_matches($v, '\p{L}') THEN concat('letter ', regexp_extract($v, '\p{L}'))
    WHEN regexp_matches($v, '[^0-9\-]') THEN concat('character ', regexp_extract($v, '[^0-9\-]'))""",
)


@query(
    "placeholder_filter",
    r"""SELECT id, segment FROM customers WHERE segment IS NULL OR
    lower(regexp_replace(segment, '^\s+|\s+$', '', 'g')) IN ('', 'n/a','na','n.a.','-','--','---','sin dato','sin datos',
    'sin nombre','s/n','s/d','null','none','ninguno','.','0')""",
    ("customers",),
)
def placeholder_filter(d: Data):
    """Rows whose value stands for no value."""
    return d.view("customers").where(is_placeholder(F.col("segment"))).select("id", "segment")


SQL_MASK = (
    r"coalesce(replace(replace(regexp_replace(regexp_replace(regexp_replace({c}, '\p{{Lu}}', chr(1), 'g'), "
    r"'\p{{Ll}}', 'l', 'g'), '\p{{Nd}}', 'D', 'g'), ' ', 's'), chr(1), 'L'), '-null-')"
)


@query(
    "mask_drill_through",
    f"SELECT id, name FROM customers WHERE {SQL_MASK.format(c='name')} = 'LLLLLLLL#DDDDDDDDD'",
    ("customers",),
)
def mask_drill_through(d: Data):
    """Rows whose name has exactly one given shape."""
    return d.view("customers").where(mask(F.col("name")) == "LLLLLLLL#DDDDDDDDD").select("id", "name")


@query(
    "uniqueness",
    """SELECT id AS record_id, 'name' AS "column", 'uniqueness' AS dimension, 'repeated value' AS reason, name AS value
       FROM parts_d WHERE coalesce(name, chr(1)) IN
       (SELECT coalesce(name, chr(1)) FROM parts_d GROUP BY 1 HAVING count(*) > 1)""",
    ("parts_d",),
)
def uniqueness(d: Data):
    """All members of repeated values; missing values count as equal."""
    return uq.uniqueness_issues(d.view("parts_d"), "id", "name", principals=False).drop("is_principal")


@query(
    "uniqueness_principal",
    """WITH r AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY
         (CASE WHEN id IS NULL THEN 1 ELSE 0 END + CASE WHEN name IS NULL THEN 1 ELSE 0 END + CASE WHEN brand IS NULL THEN 1 ELSE 0 END
          + CASE WHEN size IS NULL THEN 1 ELSE 0 END + CASE WHEN price IS NULL THEN 1 ELSE 0 END), cast(id AS string)) AS rn,
         count(*) OVER (PARTITION BY name) AS n FROM parts_d)
       SELECT name AS value, cast(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS bigint) AS kept, count(*) AS members,
         min(CASE WHEN rn = 1 THEN id END) AS keep_id FROM r WHERE n > 1 GROUP BY name""",
    ("parts_d",),
)
def uniqueness_principal(d: Data):
    """Record to keep of every repeated value, with the group size."""
    issues = uq.uniqueness_issues(d.view("parts_d"), "id", "name")
    return issues.groupBy("value").agg(
        F.count_if("is_principal").alias("kept"),
        F.count(F.lit(1)).alias("members"),
        F.min(F.when(F.col("is_principal"), F.col("record_id"))).alias("keep_id"),
    )


@query(
    "duplicate_rows",
    """SELECT cast(coalesce(sum(n - 1), 0) AS bigint) AS duplicate_rows FROM
       (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""",
)
def duplicate_rows(d: Data):
    """Rows that repeat an earlier row in every column."""
    return uq.duplicate_rows(d.table("lineitem"))


@query(
    "id_duplicates_alert",
    """WITH c AS (SELECT 'l_orderkey' AS "column", l_orderkey AS v FROM lineitem UNION ALL SELECT 'l_partkey', l_partkey FROM lineitem
       UNION ALL SELECT 'l_suppkey', l_suppkey FROM lineitem),
       g AS (SELECT "column", v, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) > 1)
       SELECT "column", cast(sum(n) AS bigint) AS involved FROM g GROUP BY 1""",
)
def id_duplicates_alert(d: Data):
    """Identifier-like columns that repeat values."""
    return uq.id_duplicates(d.table("lineitem"))
