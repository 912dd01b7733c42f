"""Queries of the profile, with reference SQL generated column by column."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Data, query
from plumbline.functions.text import COMPANY_ENDINGS, STREET_MARKS
from plumbline.operators import profile as pf

TEXTS = ["name", "email", "phone", "tax_id", "website", "segment", "credit", "joined"]
NUMBERS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def each(columns: list[str], template: str) -> str:
    return " UNION ALL ".join(template.replace("$c", c) for c in columns)


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


CELLS = each(TEXTS, "SELECT '$c' AS col, $c AS v FROM customers")
COUNTS = f"cells AS ({CELLS}), counts AS (SELECT col, v, count(*) AS n FROM cells GROUP BY 1, 2)"


def number_info(columns: list[str], table: str, typed: dict[str, str]) -> str:
    parts = []
    for c in columns:
        if typed[c] in ("bigint", "double"):
            stats = f"""round(min(cast({c} AS double)), 4) AS min_value, round(max(cast({c} AS double)), 4) AS max_value,
              round(quantile_cont(cast({c} AS double), 0.05), 4) AS p5, round(quantile_cont(cast({c} AS double), 0.95), 4) AS p95"""
        else:
            stats = "NULL AS min_value, NULL AS max_value, NULL AS p5, NULL AS p95"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{typed[c]}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, {stats} FROM {table}"
        )
    return " UNION ALL ".join(parts)


CUSTOMER_TYPES = {"id": "bigint", **{t: "string" for t in TEXTS}, "balance": "double", "nation": "bigint"}


@query("column_info", number_info(list(CUSTOMER_TYPES), "customers", CUSTOMER_TYPES), ("customers",))
def column_info(d: Data):
    """Name, type, rows, missing values and range of every column."""
    return pf.column_info(d.view("customers"))


@query(
    "profile_summary",
    f"""SELECT count(*) AS n_rows, cast({len(CUSTOMER_TYPES)} AS bigint) AS n_columns,
      round((1 - ({' + '.join(f'(count(*) - count({c}))' for c in CUSTOMER_TYPES)}) / (count(*) * {len(CUSTOMER_TYPES)}.0)) * 100, 4) AS filled_pct,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customers)) AS duplicate_rows,
      cast({' + '.join(f'coalesce(sum(octet_length(encode({c}))), 0)' for c in TEXTS)} AS bigint) AS text_bytes FROM customers""",
    ("customers",),
)
def profile_summary(d: Data):
    return pf.table_summary(d.view("customers"))


LABEL = r"""CASE WHEN regexp_matches(x, '^[a-zA-Z0-9_.+\-À-ɏ]+@[a-zA-Z0-9\-À-ɏ]+\.[a-zA-Z0-9\-.À-ɏ]+$') THEN 'email'
  WHEN regexp_matches(x, '^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}$') THEN 'date'
  WHEN regexp_matches(x, '^https?://[^\s/$.?#].[^\s]*$') THEN 'url'
  WHEN regexp_matches(x, '^[0-9]{6,12}[-]?[0-9]?$') THEN 'tax_id'
  WHEN regexp_matches(x, '^\+?[0-9\s\-()]{7,15}$') THEN 'phone' END"""
VOTES = f"""{COUNTS}, lab AS (SELECT col, n, {LABEL.replace('x,', STRIP.format(c='v') + ',')} AS k FROM counts WHERE v IS NOT NULL),
  tot AS (SELECT col, sum(n) AS filled FROM lab GROUP BY 1),
  win AS (SELECT col, k, sum(n) AS n, row_number() OVER (PARTITION BY col ORDER BY sum(n) DESC,
    CASE k WHEN 'email' THEN 1 WHEN 'date' THEN 2 WHEN 'tax_id' THEN 3 WHEN 'phone' THEN 4 ELSE 5 END) AS r
    FROM lab WHERE k IS NOT NULL GROUP BY 1, 2),
  vote AS (SELECT t.col, CASE WHEN w.n >= greatest(3, t.filled * 0.5) THEN w.k ELSE 'free_text' END AS format
    FROM tot t LEFT JOIN win w ON t.col = w.col AND w.r = 1)"""


@query("profile_format", f'WITH {VOTES} SELECT col AS "column", format FROM vote', ("customers",))
def profile_format(d: Data):
    """Detected format of every text column."""
    return pf.format_votes(d.view("customers"))


@query(
    "profile_routing",
    f"""WITH {VOTES}, dist AS (SELECT col, count(DISTINCT v) AS u FROM cells GROUP BY 1)
    SELECT d.col AS "column", CASE WHEN format = 'date' THEN 'date' WHEN u <= 20 THEN 'categorical' ELSE 'text' END AS kind
    FROM dist d LEFT JOIN vote USING (col) UNION ALL SELECT * FROM (VALUES ('id', 'numeric'), ('balance', 'numeric'), ('nation', 'numeric'))""",
    ("customers",),
)
def profile_routing(d: Data):
    """Profile kind of every column."""
    return pf.routes(d.view("customers"))


SKEW = "CASE WHEN count(x) >= 3 AND max(x) > min(x) THEN skewness(x) END"
NUMERIC = """SELECT '$c' AS "column", min(x) AS min_value, max(x) AS max_value, round(avg(x), 4) AS mean, round(median(x), 4) AS median,
  round(stddev_samp(x), 4) AS std, round(sum(x), 4) AS total, round(quantile_cont(x, 0.05), 4) AS p5, round(quantile_cont(x, 0.25), 4) AS p25,
  round(quantile_cont(x, 0.75), 4) AS p75, round(quantile_cont(x, 0.95), 4) AS p95,
  round(abs(stddev_samp(x) / nullif(avg(x), 0)) * 100, 4) AS cv_pct, round((count(*) - count(x)) / count(*) * 100.0, 4) AS null_pct,
  round(count(CASE WHEN x = 0 THEN 1 END) / count(*) * 100.0, 4) AS zero_pct,
  round(count(CASE WHEN x < 0 THEN 1 END) / count(*) * 100.0, 4) AS negative_pct $skew
  FROM (SELECT cast($c AS double) AS x FROM $t)"""


def numeric_sql(columns, table, skew=""):
    return each(columns, NUMERIC.replace("$skew", skew).replace("$t", table))


@query("profile_numeric", numeric_sql(["balance", "nation"], "customers"), ("customers",))
def profile_numeric(d: Data):
    """Location, spread and special shares of numeric columns."""
    return pf.numeric_profile(d.view("customers"), ["balance", "nation"]).drop("skew", "skew_label")


@query(
    "profile_skew",
    each(
        NUMBERS,
        f"""SELECT "column", skew, CASE WHEN abs(skew) < 0.5 THEN 'normal' WHEN skew > 0.5 THEN 'right' WHEN skew IS NOT NULL THEN 'left' END AS skew_label
        FROM (SELECT '$c' AS "column", round({SKEW}, 4) AS skew FROM (SELECT cast($c AS double) AS x FROM lineitem))""",
    ),
)
def profile_skew(d: Data):
    """Bias-corrected skewness with its label."""
    return pf.numeric_profile(d.table("lineitem"), NUMBERS).select("column", "skew", "skew_label")


@query(
    "profile_outlier_count",
    each(
        ["id", "balance", "nation"],
        """SELECT '$c' AS "column", (SELECT count(*) FROM customers, (SELECT quantile_cont(cast($c AS double), 0.25) AS a,
        quantile_cont(cast($c AS double), 0.75) AS b FROM customers) WHERE $c < a - 1.5 * (b - a) OR $c > b + 1.5 * (b - a)) AS outliers""",
    ),
    ("customers",),
)
def profile_outlier_count(d: Data):
    """Values outside the quartile fences per numeric column."""
    return pf.outlier_counts(d.view("customers"))


def bins_sql(columns: list[str], source: str, bins: int) -> str:
    return each(
        columns,
        f"""SELECT '$c' AS "column", cast(g.b AS bigint) AS bin, round(lo + g.b * (hi - lo) / {bins}, 4) AS from_value,
        round(lo + (g.b + 1) * (hi - lo) / {bins}, 4) AS to_value,
        count(x) AS n FROM range(0, {bins}) g(b) CROSS JOIN (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
        CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM ({source})) r
        LEFT JOIN ({source}) s ON least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) = g.b GROUP BY g.b, lo, hi""",
    )


@query("profile_histogram", bins_sql(NUMBERS[1:], "SELECT cast($c AS double) AS x FROM lineitem WHERE $c IS NOT NULL", 10))
def profile_histogram(d: Data):
    """Ten equal bins per numeric column."""
    return pf.histogram(d.table("lineitem"), NUMBERS[1:])


@query(
    "profile_length_histogram",
    bins_sql(TEXTS, "SELECT cast(length($c) AS double) AS x FROM customers WHERE $c IS NOT NULL", 5),
    ("customers",),
)
def profile_length_histogram(d: Data):
    """Five equal bins of text length per text column."""
    return pf.length_histogram(d.view("customers"))


@query(
    "profile_text",
    each(
        TEXTS,
        r"""SELECT '$c' AS "column", count(DISTINCT $c) AS n_distinct, min(length($c)) AS length_min, max(length($c)) AS length_max,
        round(avg(length($c)), 4) AS length_mean, round((count(*) - count($c)) / count(*) * 100.0, 4) AS null_pct,
        round(count(CASE WHEN NOT regexp_matches($c, '\S') THEN 1 END) / count(*) * 100.0, 4) AS blank_pct,
        round(count(CASE WHEN NOT regexp_matches($c, '\S') AND $c <> '' THEN 1 END) / count(*) * 100.0, 4) AS space_only_pct FROM customers""",
    ),
    ("customers",),
)
def profile_text(d: Data):
    """Distinct values, lengths, missing and blank shares of text columns."""
    return pf.text_profile(d.view("customers")).drop("cardinality", "is_catalogue", "mixed_case")


@query(
    "profile_cardinality",
    each(
        TEXTS,
        """SELECT '$c' AS "column", CASE WHEN count(DISTINCT $c) / count(*) > 0.5 THEN 'high' WHEN count(DISTINCT $c) / count(*) >= 0.05
        THEN 'medium' ELSE 'low' END AS cardinality, count(DISTINCT $c) <= 20 AS is_catalogue FROM customers""",
    ),
    ("customers",),
)
def profile_cardinality(d: Data):
    return pf.text_profile(d.view("customers")).select("column", "cardinality", "is_catalogue")


@query(
    "profile_mixed_case",
    each(
        ["text", "lang", "source"],
        """SELECT '$c' AS "column", coalesce(bool_or(regexp_matches($c, '[A-Z]') AND regexp_matches($c, '[a-z]')), false) AS mixed_case FROM documents""",
    ),
)
def profile_mixed_case(d: Data):
    """Whether any value mixes upper and lower case."""
    return pf.text_profile(d.table("documents")).select("column", "mixed_case")


@query(
    "profile_top_values",
    f"""WITH {COUNTS}, r AS (SELECT col, v, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rank FROM counts WHERE v IS NOT NULL)
    SELECT col AS "column", rank, v AS value, n, round(n / (SELECT count(*) FROM customers) * 100.0, 4) AS pct FROM r WHERE rank <= 10""",
    ("customers",),
)
def profile_top_values(d: Data):
    """Ten most frequent values per text column."""
    return pf.top_values(d.view("customers"))


@query(
    "profile_case_variants",
    f"""WITH {COUNTS}, f AS (SELECT col, v, lower({STRIP.format(c='v')}) AS form FROM counts WHERE v IS NOT NULL)
    SELECT * FROM (SELECT col AS "column", form, v AS value, count(*) OVER (PARTITION BY col, form) AS spellings FROM f) WHERE spellings > 1""",
    ("customers",),
)
def profile_case_variants(d: Data):
    """Values written in more than one way."""
    return pf.case_variants(d.view("customers"))


SQL_MASK = (
    r"coalesce(replace(replace(regexp_replace(regexp_replace(regexp_replace(v, '\p{Lu}', chr(1), 'g'), "
    r"'\p{Ll}', 'l', 'g'), '\p{Nd}', 'D', 'g'), ' ', 's'), chr(1), 'L'), '-null-')"
)


@query(
    "profile_masks",
    f"""WITH cells AS ({CELLS}) SELECT col AS "column", {SQL_MASK} AS mask, count(*) AS n,
    round(count(*) / (SELECT count(*) FROM customers) * 100.0, 4) AS pct FROM cells GROUP BY 1, 2""",
    ("customers",),
)
def profile_masks(d: Data):
    """Value shapes per text column."""
    return pf.masks(d.view("customers"))


def signals_sql(columns: list[str], table: str) -> str:
    return each(
        columns,
        rf"""SELECT '$c' AS "column",
      round(count(CASE WHEN list_extract(list_filter(string_split_regex(replace(v, ',', ' '), '\s+'), lambda t: t <> ''), -1) IN ({quoted(COMPANY_ENDINGS)}) THEN 1 END) / count(*) * 100.0, 1) AS company_pct,
      round(count(CASE WHEN {' OR '.join(f"contains(v, '{s}')" for s in STREET_MARKS)} THEN 1 END) / count(*) * 100.0, 1) AS street_pct,
      round(count(DISTINCT list_extract(string_split_regex(v, '\s+'), 1)) / count(*), 3) AS first_word_ratio,
      count(DISTINCT list_extract(string_split_regex(v, '\s+'), 1)) AS first_words,
      round(avg(len(string_split_regex(v, '\s+'))), 1) AS mean_tokens,
      round(count(CASE WHEN regexp_matches(v, '[0-9]') THEN 1 END) / count(*) * 100.0, 1) AS digit_pct
      FROM (SELECT lower({STRIP.format(c='$c')}) AS v FROM {table}) WHERE v <> '' HAVING count(*) >= 10""",
    )


@query("profile_name_signals", signals_sql(["name", "brand"], "companies"), ("companies",))
def profile_name_signals(d: Data):
    """Company, street, first-word and digit signals."""
    return pf.name_signals(d.view("companies"), ["name", "brand"])


AS_OF = "2000-06-30"


@query(
    "profile_date",
    f"""WITH v AS (SELECT placed AS x FROM orders_d)
    SELECT 'placed' AS "column", strftime(min(x), '%Y-%m-%d') AS date_min, strftime(max(x), '%Y-%m-%d') AS date_max,
    date_diff('day', min(x), max(x)) AS range_days, round((count(*) - count(x)) / count(*) * 100.0, 4) AS null_pct,
    round(count(CASE WHEN x > TIMESTAMP '{AS_OF}' THEN 1 END) / count(*) * 100.0, 4) AS future_pct,
    round(count(CASE WHEN x < TIMESTAMP '{AS_OF}' - INTERVAL 5 YEAR THEN 1 END) / count(*) * 100.0, 4) AS old_pct,
    (SELECT strftime(x, '%Y-%m-%d') FROM v WHERE x IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS common_day FROM v""",
    ("orders_d",),
)
def profile_date(d: Data):
    """Range, most frequent day, future and old shares of a date column."""
    return pf.date_profile(d.view("orders_d"), ["placed"], as_of=AS_OF)


PY_FORMATS = {
    "YYYY-MM-DD": "%Y-%m-%d", "DD/MM/YYYY": "%d/%m/%Y", "MM/DD/YYYY": "%m/%d/%Y", "DD-MM-YYYY": "%d-%m-%Y", "DD-MM-YY": "%d-%m-%y",
    "YYYY/MM/DD": "%Y/%m/%d", "DD Mon YYYY": "%d %b %Y", "Month DD, YYYY": "%B %d, %Y", "YYYYMMDD": "%Y%m%d", "DD.MM.YYYY": "%d.%m.%Y",
}


@query(
    "profile_date_formats",
    " UNION ALL ".join(
        f"SELECT 'joined' AS \"column\", '{k}' AS format, count(try_strptime(joined, '{p}')) AS n FROM customers HAVING count(try_strptime(joined, '{p}')) > 0"
        for k, p in PY_FORMATS.items()
    ),
    ("customers",),
)
def profile_date_formats(d: Data):
    """Values readable under each written date format."""
    return pf.date_formats(d.view("customers"), ["joined"])


@query(
    "profile_date_distribution",
    """SELECT 'placed' AS "column", 'year' AS part, year(placed) AS value, count(*) AS n FROM orders_d WHERE placed IS NOT NULL GROUP BY 3
    UNION ALL SELECT 'placed', 'month', month(placed), count(*) FROM orders_d WHERE placed IS NOT NULL GROUP BY 3""",
    ("orders_d",),
)
def profile_date_distribution(d: Data):
    """Rows per year and per month of the year."""
    return pf.date_distribution(d.view("orders_d"), ["placed"])


CATS = ["priority", "status"]


@query(
    "profile_categorical",
    each(
        CATS,
        """SELECT '$c' AS "column", $c AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders_d) * 100.0, 4) AS pct
        FROM orders_d WHERE $c IS NOT NULL GROUP BY 2""",
    ),
    ("orders_d",),
)
def profile_categorical(d: Data):
    """Every value of categorical columns."""
    return pf.categorical_values(d.view("orders_d"), CATS)


ENTROPY = each(
    CATS,
    """SELECT '$c' AS "column", round(sum(-p * log2(p + 1e-12)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END, 3) AS entropy
    FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM orders_d WHERE $c IS NOT NULL GROUP BY $c)""",
)


@query(
    "profile_entropy",
    f"""SELECT *, CASE WHEN entropy >= 0.9 THEN 'very balanced' WHEN entropy >= 0.7 THEN 'balanced' WHEN entropy >= 0.4 THEN 'unbalanced'
    ELSE 'extremely unbalanced' END AS entropy_label FROM ({ENTROPY})""",
    ("orders_d",),
)
def profile_entropy(d: Data):
    """Shannon entropy relative to the maximum."""
    return pf.categorical_profile(d.view("orders_d"), CATS).select("column", "entropy", "entropy_label")


@query(
    "profile_imbalance",
    each(
        CATS,
        """SELECT '$c' AS "column", (SELECT count(DISTINCT $c) FROM orders_d) AS n_distinct,
        (SELECT $c FROM orders_d WHERE $c IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_frequent,
        (SELECT $c FROM orders_d WHERE $c IS NOT NULL GROUP BY 1 ORDER BY count(*), 1 DESC LIMIT 1) AS least_frequent,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM orders_d WHERE $c IS NOT NULL GROUP BY $c)) / (SELECT count(*) FROM orders_d) >= 0.95 AS imbalanced""",
    ),
    ("orders_d",),
)
def profile_imbalance(d: Data):
    """Most and least frequent value, and whether one value fills 95 % of the rows."""
    return pf.categorical_profile(d.view("orders_d"), CATS).drop("entropy", "entropy_label")


ALERT_COLUMNS = ["id", "priority", "price", "status", "placed", "custkey"]


@query(
    "profile_alerts",
    each(
        ["id", "name", "brand"],
        """SELECT "column", alert, n FROM (SELECT '$c' AS "column", 'identifier with repeats' AS alert,
          (SELECT cast(coalesce(sum(k), 0) AS bigint) FROM (SELECT count(*) AS k FROM parts_d GROUP BY $c HAVING count(*) > 1)) AS n) WHERE n > 0 AND '$c' = 'id'
        UNION ALL SELECT '$c', 'constant', count(DISTINCT $c) FROM parts_d HAVING count(DISTINCT $c) = 1
        UNION ALL SELECT '$c', 'many missing values', count(*) - count($c) FROM parts_d HAVING (count(*) - count($c)) / count(*) > 0.3""",
    )
    + """ UNION ALL SELECT 'size', 'many missing values', count(*) - count(size) FROM parts_d HAVING (count(*) - count(size)) / count(*) > 0.3""",
    ("parts_d",),
)
def profile_alerts(d: Data):
    """Warnings about whole columns."""
    return pf.alerts(d.view("parts_d"))


@query(
    "profile_uniques",
    each(
        ["segment", "name", "nation"],
        """SELECT '$c' AS "column", n_distinct, CASE WHEN n_distinct <= 15 THEN (SELECT string_agg(v, '|' ORDER BY k DESC, v) FROM
        (SELECT cast($c AS string) AS v, count(*) AS k FROM customers WHERE $c IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) END AS top_values
        FROM (SELECT count(DISTINCT $c) AS n_distinct FROM customers)""",
    ),
    ("customers",),
)
def profile_uniques(d: Data):
    """Distinct values per column and the top values of small columns."""
    out = pf.uniques(d.view("customers"), ["segment", "name", "nation"])
    return out.withColumn("top_values", F.array_join("top_values", "|"))
