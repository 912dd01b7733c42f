"""Queries of rule suggestion on the dirty customers view."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Data, query
from catalog.profiles import SKEW, STRIP, TEXTS, VOTES, each, signals_sql
from plumbline.operators import suggest as sg

AS_OF = "2026-01-01"
NUMERIC = ["id", "balance", "nation"]
PARSED = (
    "coalesce(try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%d/%m/%Y'), try_strptime(x, '%d-%m-%Y'),"
    " try_strptime(x, '%d.%m.%Y'), try_strptime(x, '%Y/%m/%d'))"
)
FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%d-%m-%y", "%Y/%m/%d", "%d %b %Y", "%B %d, %Y", "%Y%m%d", "%d.%m.%Y"]
FORMAT_COUNT = " + ".join(f"CASE WHEN count(try_strptime(x, '{f}')) > 0 THEN 1 ELSE 0 END" for f in FORMATS)

BASE = each(
    TEXTS,
    r"""SELECT '$c' AS col, 'string' AS data_type, count(*) AS n_rows, (count(*) - count($c)) / count(*) * 100.0 AS pct_null,
    count(DISTINCT $c) AS n_distinct, cast(NULL AS double) AS p5, cast(NULL AS double) AS p95, 0.0 AS negative_pct, 0 AS outliers, '' AS skew_label FROM customers""",
) + " UNION ALL " + each(
    NUMERIC,
    f"""SELECT '$c', 'NUM', count(*), (count(*) - count(x)) / count(*) * 100.0, count(DISTINCT x), round(quantile_cont(x, 0.05), 4), round(quantile_cont(x, 0.95), 4),
    count(CASE WHEN x < 0 THEN 1 END) / count(*) * 100.0,
    (SELECT count(*) FROM customers, (SELECT quantile_cont(cast($c AS double), 0.25) AS a, quantile_cont(cast($c AS double), 0.75) AS b FROM customers)
      WHERE $c < a - 1.5 * (b - a) OR $c > b + 1.5 * (b - a)),
    CASE WHEN abs({SKEW}) < 0.5 THEN 'normal' WHEN ({SKEW}) > 0.5 THEN 'right' ELSE 'left' END FROM (SELECT cast($c AS double) AS x FROM customers)""",
)
TEXT = each(
    TEXTS,
    r"""SELECT '$c' AS col, count(CASE WHEN NOT regexp_matches($c, '\S') THEN 1 END) / count(*) * 100.0 AS blank_pct, min(length($c)) AS length_min,
    max(length($c)) AS length_max, coalesce(bool_or(regexp_matches($c, '[A-Z]') AND regexp_matches($c, '[a-z]')), false) AS mixed_case FROM customers""",
)
DATES = each(
    TEXTS,
    f"""SELECT '$c' AS col, count(CASE WHEN {PARSED} > TIMESTAMP '{AS_OF}' THEN 1 END) / count(*) * 100.0 AS future_pct,
    count(CASE WHEN {PARSED} < TIMESTAMP '{AS_OF}' - INTERVAL 5 YEAR THEN 1 END) / count(*) * 100.0 AS old_pct, {FORMAT_COUNT} AS n_formats
    FROM (SELECT $c AS x FROM customers)""",
)
CONTEXT = f"""{VOTES}, kinds AS (SELECT d.col, CASE WHEN format = 'date' THEN 'date' WHEN u <= 20 THEN 'categorical' ELSE 'text' END AS kind
    FROM (SELECT col, count(DISTINCT v) AS u FROM cells GROUP BY 1) d LEFT JOIN vote USING (col)),
  base AS ({BASE}), txt AS ({TEXT}), dts AS ({DATES}), sig AS ({signals_sql(TEXTS, 'customers')}),
  variants AS (SELECT col, count(DISTINCT form) AS n_variants, bool_or(len(list_filter(string_split_regex(form, '\\s+'), lambda w: regexp_full_match(w, '.{{1,5}}\\.'))) > 0) AS abbreviations
    FROM (SELECT col, form FROM (SELECT DISTINCT col, v, lower({STRIP.format(c='v')}) AS form FROM cells WHERE v IS NOT NULL) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
  tops AS (SELECT col, '[' || string_agg('"' || v || '"', ',' ORDER BY n DESC, v) || ']' AS top_values, max(n) AS biggest FROM
    (SELECT col, v, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS r FROM counts WHERE v IS NOT NULL) WHERE r <= 10 GROUP BY 1),
  ctx AS (SELECT b.*, CASE WHEN k.kind IS NULL THEN 'numeric' ELSE k.kind END AS kind,
    CASE WHEN kind = 'text' THEN blank_pct ELSE 0.0 END AS blank_pct, CASE WHEN kind = 'text' THEN length_min END AS length_min,
    CASE WHEN kind = 'text' THEN length_max END AS length_max, coalesce(kind = 'text' AND mixed_case, false) AS mixed_case,
    CASE WHEN kind = 'text' THEN format ELSE '' END AS format, coalesce(kind = 'categorical', false) AS is_catalogue,
    CASE WHEN kind = 'categorical' THEN t.top_values END AS top_values, kind = 'categorical' AND biggest / n_rows >= 0.95 AS imbalanced,
    CASE WHEN kind = 'categorical' THEN coalesce(n_variants, 0) ELSE 0 END AS n_variants, kind = 'categorical' AND coalesce(abbreviations, false) AS abbreviations,
    CASE WHEN kind = 'date' THEN future_pct ELSE 0.0 END AS future_pct, CASE WHEN kind = 'date' THEN old_pct ELSE 0.0 END AS old_pct,
    CASE WHEN kind = 'date' THEN n_formats ELSE 0 END AS n_formats, CASE WHEN kind = 'text' THEN company_pct END AS company_pct,
    CASE WHEN kind = 'text' THEN street_pct END AS street_pct, CASE WHEN kind = 'text' THEN first_word_ratio END AS first_word_ratio,
    CASE WHEN kind = 'text' THEN mean_tokens END AS mean_tokens, CASE WHEN kind = 'text' THEN digit_pct END AS digit_pct
    FROM base b LEFT JOIN kinds k USING (col) LEFT JOIN txt USING (col) LEFT JOIN dts USING (col) LEFT JOIN vote USING (col)
    LEFT JOIN variants USING (col) LEFT JOIN tops t USING (col) LEFT JOIN sig ON sig."column" = b.col)"""


def named(words: list[str]) -> str:
    return f"regexp_matches(col, '{'|'.join(words)}')"


def js(**params: str) -> str:
    """JSON text of parameters in SQL; values are SQL expressions."""
    body = " || ',' || ".join(f"'\"{k}\":\"' || {v} || '\"'" for k, v in params.items())
    return f"('{{' || {body} || '}}')" if params else "'{}'"


def case(*branches: tuple[str, str, str]) -> str:
    """(condition, confidence, params) branches to two CASE columns."""
    confidence = " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in branches)
    params = " ".join(f"WHEN {c} THEN {p}" for c, _, p in branches)
    return f"CASE {confidence} END AS confidence, CASE {params} END AS params"


def lit(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def json_lit(text: str) -> str:
    return lit(text.replace("\\", "\\\\"))


ID = named(sg.ID_NAMES)
PATTERN = {f: js(pattern=json_lit(p), format=lit(f)) for f, p in sg.PATTERNS.items()}
TOP = "('{\"allowed_values\":\"' || replace(top_values, '\"', '\\\"') || '\"}')"
PERIOD = {y: js(date_from=lit(f"{2026 - y}-01-01"), date_to=lit(AS_OF)) for y in (2, 5)}
KIND = """CASE WHEN company_pct IS NULL THEN NULL WHEN company_pct >= 15 THEN 'company' WHEN street_pct >= 15 THEN 'street' WHEN digit_pct >= 40 THEN 'digits'
  WHEN mean_tokens BETWEEN 2 AND 4 AND company_pct < 5 AND digit_pct < 10 THEN 'person' WHEN first_word_ratio < 0.10 THEN 'few_first_words' ELSE 'unclear' END"""
CHOSEN = "CASE {k} " + " ".join(f"WHEN '{k}' THEN '{{\"algorithm\":\"{a}\",\"threshold\":\"{t}\"}}'" for k, (a, t) in sg.CHOICE.items()) + " END"
EVIDENCE = f"CASE WHEN abbreviations THEN 'abbreviations' ELSE coalesce({KIND}, 'unclear') END"
BY_NAME = f"coalesce({KIND}, CASE WHEN {named(sg.PERSON_NAMES)} OR {named(sg.ADDRESS_NAMES)} THEN 'name_only' ELSE 'other_name' END)"
MEASURED = "(length_min IS NOT NULL AND length_max IS NOT NULL AND data_type <> 'NUM')"
NONE = js()

SQL = {
    "completeness": case(("pct_null + blank_pct > 0", "high", NONE), ("true", "medium", NONE)),
    "uniqueness": case((f"{ID} AND n_distinct > 0", "high", NONE), (ID, "medium", NONE)),
    "validity": case(
        *[(f"format = '{f}'", "high", PATTERN[f]) for f in ("email", "phone", "url", "tax_id")],
        ("(is_catalogue OR imbalanced) AND top_values IS NOT NULL", "high", TOP),
        *[(named(n), "medium", PATTERN[f]) for f, n in sg.FORMAT_NAMES.items()],
        (f"{named(sg.CATALOGUE_NAMES)} AND NOT is_catalogue", "medium", NONE),
    ),
    "consistency": case(
        ("mixed_case OR n_formats > 1 OR n_variants > 0", "high", NONE), (f"{named(sg.DATE_NAMES)} AND n_formats = 0", "medium", NONE)
    ),
    "accuracy": case(
        ("negative_pct > 0", "high", js(min_value="'0'")),
        ("outliers > 0 AND p5 IS NOT NULL", "high", js(min_value="cast(round(p5, 2) AS string)", max_value="cast(round(p95, 2) AS string)")),
        (named(sg.AGE_NAMES), "medium", js(min_value="'0'", max_value="'120'")),
        (named(sg.MONEY_NAMES), "medium", js(min_value="'0'")),
        (named(sg.SCORE_NAMES), "medium", js(min_value="'0'", max_value="'100'")),
    ),
    "validity_period": case(
        *[
            (f"{named(sg.PERIOD_NAMES)} AND {c}", k, PERIOD[y])
            for c, k, y in (("future_pct > 0", "high", 5), ("old_pct > 5", "high", 5), ("true", "medium", 2))
        ]
    ),
    "precision": case(
        (f"{MEASURED} AND length_max > 0 AND length_min > 0 AND length_max / greatest(length_min, 1) > 2", "medium",
         js(min_length="cast(length_min AS string)", max_length="cast(length_max AS string)")),
        (f"NOT {MEASURED} AND {named(sg.TEXT_NAMES)}", "low", js(min_length="'2'", max_length="'200'")),
    ),
    "reasonableness": case(
        ("data_type = 'NUM' AND outliers > 0", "high", NONE),
        ("data_type = 'NUM' AND skew_label IN ('left', 'right')", "medium", NONE),
        ("data_type = 'NUM'", "low", NONE),
    ),
    "similarity": case(
        (f"NOT {ID} AND n_variants > 0", "high", CHOSEN.replace("{k}", f"({EVIDENCE})")),
        (f"NOT {ID} AND {named(sg.PARTY_NAMES)}", "medium", CHOSEN.replace("{k}", f"({BY_NAME})")),
    ),
    "timeliness": case((named(sg.UPDATE_NAMES), "medium", js(max_age_days="'365'"))),
}

# The view's columns under names that trigger the name-based rules too.
RENAMED = {"joined": "created_date", "credit": "price_text", "segment": "status_name"}


def profile(d: Data, dimensions: list[str] | None = None):
    return sg.context(d.view("customers"), as_of=AS_OF, dimensions=dimensions).withColumn(
        "column", F.coalesce(*[F.when(F.col("column") == a, F.lit(b)) for a, b in RENAMED.items()], F.col("column"))
    )


RENAME = "CASE col " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMED.items()) + " ELSE col END"


@query(
    "suggest_context",
    f"""WITH {CONTEXT} SELECT {RENAME} AS "column", kind, n_rows, n_distinct, round(pct_null, 4) AS pct_null, round(blank_pct, 4) AS blank_pct, length_min, length_max,
    mixed_case, format, is_catalogue, cast(n_variants AS bigint) AS n_variants, cast(n_formats AS bigint) AS n_formats, cast(outliers AS bigint) AS outliers, company_pct, mean_tokens, digit_pct FROM ctx""",
    ("customers",),
)
def suggest_context(d: Data):
    """Facts the suggestion rules see, one row per column."""
    return profile(d).select(
        "column", "kind", "n_rows", "n_distinct", F.round("pct_null", 4).alias("pct_null"), F.round("blank_pct", 4).alias("blank_pct"),
        "length_min", "length_max", "mixed_case", "format", "is_catalogue", F.col("n_variants").cast("bigint").alias("n_variants"),
        F.col("n_formats").cast("bigint").alias("n_formats"), F.col("outliers").cast("bigint").alias("outliers"), "company_pct", "mean_tokens", "digit_pct",
    )


def suggestion(dimension: str, body: str):
    sql = f"""WITH {CONTEXT}, named AS (SELECT * REPLACE ({RENAME} AS col) FROM ctx)
      SELECT * FROM (SELECT col AS "column", '{dimension}' AS dimension, {body} FROM named) WHERE confidence IS NOT NULL"""

    @query(f"suggest_{dimension}", sql, ("customers",))
    def run(d: Data):
        found = sg.suggestions(profile(d, [dimension]), as_of=AS_OF, dimensions=[dimension])
        return found.select("column", "dimension", "confidence", F.to_json("params").alias("params"))


for _dimension, _body in SQL.items():
    suggestion(_dimension, _body)


@query(
    "suggest_similarity_algorithm",
    f"""SELECT "column", kind, CASE kind {' '.join(f"WHEN '{k}' THEN '{a}@{t}'" for k, (a, t) in sg.CHOICE.items())} END AS choice
    FROM (SELECT "column", {KIND} AS kind FROM ({signals_sql(['name', 'brand'], 'companies')}))""",
    ("companies",),
)
def suggest_similarity_algorithm(d: Data):
    """Algorithm and threshold by the content of name columns."""
    from plumbline.operators.profile import name_signals

    kind = sg.algorithm_case()
    algorithm, threshold = sg._choice(kind)
    return name_signals(d.view("companies"), ["name", "brand"]).select(
        "column", kind.alias("kind"), F.concat_ws("@", algorithm, threshold).alias("choice")
    )


