"""Which rules to apply: a job over the column profiles, one row per column, exploded to suggestions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.functions.dates import moment
from plumbline.functions.text import strip, words
from plumbline.operators import profile as pf
from plumbline.operators.rules import Rule

# Patterns proposed for a detected format.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._+\-ñÑ]+@[a-zA-Z0-9\-ñÑ]+(\.[a-zA-Z0-9\-ñÑ]+)+$",
    "phone": r"^\+?[\d\s\-\(\)]{7,15}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "tax_id": r"^\d+[-]?\d*$",
}

# Words in a column name that point to a rule.
ID_NAMES = ["id", "codigo", "code", "clave", "key", "nit", "cedula", "documento", "rut", "rfc"]
FORMAT_NAMES = {
    "email": ["email", "correo", "mail"],
    "phone": ["telefono", "phone", "celular", "movil", "tel"],
    "url": ["url", "link", "web", "website"],
    "tax_id": ["nit", "rut", "cedula", "documento", "dni", "rfc"],
}
CATALOGUE_NAMES = ["estado", "status", "tipo", "type", "categoria", "category"]
DATE_NAMES = ["fecha", "date"]
AGE_NAMES = ["edad", "age"]
MONEY_NAMES = ["precio", "price", "monto", "amount", "salario", "salary", "sueldo", "costo", "cost", "valor", "value"]
SCORE_NAMES = ["score", "puntaje", "rating", "porcentaje"]
UPDATE_NAMES = ["fecha", "date", "time", "updated", "created", "modificacion", "actualizacion"]
PERIOD_NAMES = [*UPDATE_NAMES, "registro"]
TEXT_NAMES = ["nombre", "name", "apellido", "descripcion", "description"]
PARTY_NAMES = [
    "nombre", "name", "empresa", "razon_social", "proveedor", "cliente", "descripcion", "direccion", "address", "apellido",
]
PERSON_NAMES = ["nombre", "name", "apellido", "persona"]
ADDRESS_NAMES = ["direccion", "address", "domicilio"]

# Calibrated algorithm and threshold per kind of content.
CHOICE = {
    "company": ("qgrams", 86),
    "street": ("monge_elkan", 92),
    "digits": ("affine_gap", 94),
    "person": ("affine_gap", 88),
    "few_first_words": ("qgrams", 86),
    "unclear": ("qgrams", 86),
    "abbreviations": ("affine_gap", 96),
    "name_only": ("affine_gap", 90),
    "other_name": ("qgrams", 86),
}

DEFAULTS = {
    "pct_null": 0.0, "n_distinct": 0, "negative_pct": 0.0, "outliers": 0, "skew_label": "", "is_catalogue": False,
    "mixed_case": False, "format": "", "blank_pct": 0.0, "n_variants": 0, "abbreviations": False, "future_pct": 0.0,
    "old_pct": 0.0, "n_formats": 0, "imbalanced": False,
}


# Facts that the rules of a dimension look at, besides the basic ones of every column.
FACTS = {
    "completeness": {"text"}, "uniqueness": {"distinct"}, "validity": {"text", "catalogue"}, "consistency": {"text", "catalogue", "date"},
    "accuracy": {"numeric"}, "validity_period": {"date"}, "precision": {"text"}, "reasonableness": {"numeric"},
    "similarity": {"text", "names", "catalogue"}, "timeliness": set(),
}


def context(df: DataFrame, as_of: str | None = None, quantiles: str = "exact", dimensions: list[str] | None = None) -> DataFrame:
    """One row per column: basic facts merged with the profile of its kind, gaps filled with defaults.

    With ``dimensions`` only the facts are computed that these dimensions look at. The kind of a column is found first, by
    a sketch where it has many values, so that values are only counted in columns that may be catalogues and dates only
    read in columns that hold dates. Without text, catalogue or date facts the kind of text columns stays NULL.
    """
    wanted = set().union(*[FACTS[d] for d in (FACTS if dimensions is None else dimensions)])
    texts, numbers, dates = pf.string_columns(df), pf.numeric_columns(df), pf.date_columns(df)
    simple = [n for n, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    # One row per text column, added up where the rows are read, decides what is looked at more closely.
    facts = pf.text_facts(df, texts).collect() if texts and wanted & {"text", "catalogue", "date"} else []
    kinds = {**pf.typed_routes(df), **_kinds(df, facts)}
    of_kind = {k: [c for c, kind in kinds.items() if kind == k and c in texts] for k in ("text", "categorical", "date")}
    info = pf.column_info(df, quantiles if "numeric" in wanted else None)
    if "distinct" in wanted:
        info = info.join(pf.distinct_counts(pf.cell_counts(df, simple)), "column", "left")
    listed = df.sparkSession.createDataFrame(list(kinds.items()), "column string, kind string")
    out = info.join(F.broadcast(listed), "column", "left")  # one row per table column
    out = out.withColumn("pct_null", F.col("n_nulls") / F.greatest("n_rows", F.lit(1)) * 100)
    if numbers and "numeric" in wanted:
        shape = pf.numeric_profile(df, numbers, quantiles).select("column", "negative_pct", "skew_label")
        out = out.join(shape, "column", "left").join(pf.outlier_counts(df, numbers, quantiles), "column", "left")
    if of_kind["text"] and "text" in wanted:
        schema = "column string, format string, blank_pct double, length_min long, length_max long, mixed_case boolean"
        text = df.sparkSession.createDataFrame([r[:-1] for r in facts if r["column"] in of_kind["text"]], schema)
        if "names" in wanted:
            rows = pf.cells(df, of_kind["text"]).withColumn("n", F.lit(1))
            text = text.join(pf.name_signals(df, of_kind["text"], rows), "column", "left")
        out = out.join(text, "column", "left")
    if of_kind["categorical"] and "catalogue" in wanted:
        out = out.join(_catalogue(df, of_kind["categorical"], pf.cell_counts(df, of_kind["categorical"])), "column", "left")
    dates = [*dates, *of_kind["date"]]
    if dates and "date" in wanted:
        dated = pf.date_profile(df, dates, as_of).select("column", "future_pct", "old_pct")
        formats = pf.date_formats(df, dates).groupBy("column").agg(F.count(F.lit(1)).alias("n_formats"))
        out = out.join(dated.join(formats, "column", "left"), "column", "left")
    return complete(out)


def complete(profile: DataFrame) -> DataFrame:
    """Fill what a profile does not have with defaults, so that any partial profile table can be used."""
    have = set(profile.columns)
    extra = {"p5": "double", "p95": "double", "length_min": "bigint", "length_max": "bigint", "top_values": "array<string>",
             "company_pct": "double", "street_pct": "double", "first_word_ratio": "double", "mean_tokens": "double",
             "digit_pct": "double", "n_rows": "bigint", "data_type": "string"}
    filled = {n: F.coalesce(F.col(n), F.lit(v)) if n in have else F.lit(v) for n, v in DEFAULTS.items()}
    missing = {n: F.lit(None).cast(t) for n, t in extra.items() if n not in have}
    return profile.withColumns({**filled, **missing})


def _kinds(df: DataFrame, facts: list[Row]) -> dict[str, str]:
    """Profile kind of the text columns; only columns whose sketch is small are counted exactly."""
    maybe = [r["column"] for r in facts if r.few and r.format != "date"]
    counted = pf.distinct_counts(pf.cell_counts(df, maybe)).collect() if maybe else []
    few = {r["column"] for r in counted if r.n_distinct <= pf.CATALOGUE}
    return {r["column"]: "date" if r.format == "date" else "categorical" if r["column"] in few else "text" for r in facts}


def _catalogue(df: DataFrame, texts: list[str], counts: DataFrame) -> DataFrame:
    """Catalogue facts: dominance, top values, spellings of one value and whether they hold abbreviations."""
    variants = pf.case_variants(df, texts, counts).groupBy("column").agg(
        F.count_distinct("form").alias("n_variants"),
        F.bool_or(F.exists(words(strip(F.col("value"))), lambda w: w.rlike(r"^.{1,5}\.$"))).alias("abbreviations"),
    )
    top = pf.top_values(df, texts, 10, counts).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("top_values")
    )
    shape = pf.categorical_profile(df, texts, counts).select("column", "imbalanced", F.lit(True).alias("is_catalogue"))
    return shape.join(top, "column", "left").join(variants, "column", "left")


def _named(words_: list[str]) -> Column:
    return F.lower("column").rlike("|".join(words_))


def _params(**values) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(str(v))).cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


class Proposal:
    """Builds the suggestion structs of one dimension: ``Proposal("accuracy").high(reason, min_value=0)``."""

    def __init__(self, dimension: str):
        self.dimension = dimension

    def at(self, confidence: str, reason: str | Column, **params) -> Column:
        text = reason if isinstance(reason, Column) else F.lit(reason)
        fields = {"dimension": F.lit(self.dimension), "confidence": F.lit(confidence), "reason": text, "params": _params(**params)}
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    def high(self, reason: str | Column, **params) -> Column:
        return self.at("high", reason, **params)

    def medium(self, reason: str | Column, **params) -> Column:
        return self.at("medium", reason, **params)

    def low(self, reason: str | Column, **params) -> Column:
        return self.at("low", reason, **params)


def _first(*cases: tuple[Column, Column]) -> Column:
    """First suggestion whose condition holds, NULL when none does."""
    return F.coalesce(*[F.when(condition, made) for condition, made in cases])


def _numeric() -> Column:
    return F.lower("data_type").rlike("int|float|double|decimal|number")


def _dated() -> Column:
    return F.lower("data_type").rlike("date|time")


def _text(c: Column, digits: int = 1) -> Column:
    return F.round(c, digits).cast("string")


def completeness_rule() -> Column:
    empty = F.col("pct_null") + F.col("blank_pct")
    return F.when(empty > 0, Proposal("completeness").high(F.concat(_text(empty), F.lit(" % missing or blank")))).otherwise(
        Proposal("completeness").medium("preventive")
    )


def uniqueness_rule() -> Column:
    n, d = F.col("n_rows"), F.col("n_distinct")
    return F.when(
        _named(ID_NAMES),
        _first(
            ((d > 0) & (d == n), Proposal("uniqueness").high("identifier, all values unique")),
            (d > 0, Proposal("uniqueness").high(F.concat(F.lit("identifier with repeats: "), (n - d).cast("string")))),
            (d <= 0, Proposal("uniqueness").medium("named like an identifier")),
        ),
    )


def validity_rule() -> Column:
    top, has_top = F.to_json("top_values"), F.size("top_values") > 0
    cases = [
        (F.col("format") == f, Proposal("validity").high(f"{f} format detected", pattern=PATTERNS[f], format=f))
        for f in ("email", "phone", "url", "tax_id")
    ]
    cases.append((F.col("is_catalogue") & has_top, Proposal("validity").high("catalogue", allowed_values=top)))
    cases.append((F.col("imbalanced") & has_top, Proposal("validity").high("one value dominates", allowed_values=top)))
    cases += [
        (_named(n), Proposal("validity").medium(f"named like {f}", pattern=PATTERNS[f], format=f)) for f, n in FORMAT_NAMES.items()
    ]
    cases.append((_named(CATALOGUE_NAMES) & ~F.col("is_catalogue"), Proposal("validity").medium("named like a catalogue")))
    return _first(*cases)


def consistency_rule() -> Column:
    return _first(
        (F.col("mixed_case"), Proposal("consistency").high("upper and lower case mixed")),
        (F.col("n_formats") > 1, Proposal("consistency").high("several date formats")),
        (F.col("n_variants") > 0, Proposal("consistency").high("several spellings of one value")),
        (_named(DATE_NAMES) & (F.col("n_formats") == 0), Proposal("consistency").medium("named like a date")),
    )


def accuracy_rule() -> Column:
    low, high = F.col("p5"), F.col("p95")
    return _first(
        (F.col("negative_pct") > 0, Proposal("accuracy").high("negative values", min_value=0)),
        (
            (F.col("outliers") > 0) & low.isNotNull() & high.isNotNull(),
            Proposal("accuracy").high("outliers: 5th to 95th percentile", min_value=F.round(low, 2), max_value=F.round(high, 2)),
        ),
        (_named(AGE_NAMES), Proposal("accuracy").medium("named like an age", min_value=0, max_value=120)),
        (_named(MONEY_NAMES), Proposal("accuracy").medium("named like money", min_value=0)),
        (_named(SCORE_NAMES), Proposal("accuracy").medium("named like a score", min_value=0, max_value=100)),
    )


def validity_period_rule(as_of: str | None) -> Column:
    today = moment(as_of).cast("date")

    def window(confidence: str, reason: str, years: int) -> Column:
        return Proposal("validity_period").at(confidence, reason, date_from=F.add_months(today, -12 * years), date_to=today)

    return F.when(
        _dated() | _named(PERIOD_NAMES),
        _first(
            (F.col("future_pct") > 0, window("high", "dates in the future", 5)),
            (F.col("old_pct") > 5, window("high", "dates older than five years", 5)),
            (F.col("old_pct") <= 5, window("medium", "date column", 2)),
        ),
    )


def precision_rule() -> Column:
    low, high = F.col("length_min"), F.col("length_max")
    measured = low.isNotNull() & high.isNotNull() & ~_numeric()
    uneven = (high > 0) & (low > 0) & (high / F.greatest(low, F.lit(1)) > 2)
    return _first(
        (measured & uneven, Proposal("precision").medium("uneven text lengths", min_length=low, max_length=high)),
        (~measured & _named(TEXT_NAMES), Proposal("precision").low("named like a text", min_length=2, max_length=200)),
    )


def reasonableness_rule() -> Column:
    return F.when(
        _numeric() | _dated(),
        _first(
            (F.col("outliers") > 0, Proposal("reasonableness").high(F.concat(F.lit("outliers: "), F.col("outliers").cast("string")))),
            (F.col("skew_label").isin("left", "right"), Proposal("reasonableness").medium("skewed distribution")),
            (~F.col("skew_label").isin("left", "right"), Proposal("reasonableness").low("preventive")),
        ),
    )


def algorithm_case() -> Column:
    """Kind of content by the name signals; NULL without signals."""
    company, street, digits = F.col("company_pct"), F.col("street_pct"), F.col("digit_pct")
    tokens = F.col("mean_tokens")
    return F.when(
        company.isNotNull(),
        F.when(company >= 15, "company")
        .when(street >= 15, "street")
        .when(digits >= 40, "digits")
        .when(tokens.between(2, 4) & (company < 5) & (digits < 10), "person")
        .when(F.col("first_word_ratio") < 0.10, "few_first_words")
        .otherwise("unclear"),
    )


def _choice(kind: Column) -> tuple[Column, Column]:
    algorithm = F.coalesce(*[F.when(kind == k, F.lit(a)) for k, (a, _) in CHOICE.items()])
    threshold = F.coalesce(*[F.when(kind == k, F.lit(str(t))) for k, (_, t) in CHOICE.items()])
    return algorithm, threshold


def similarity_rule() -> Column:
    by_signals = algorithm_case()
    evidence = F.when(F.col("abbreviations"), "abbreviations").otherwise(F.coalesce(by_signals, F.lit("unclear")))
    by_name = F.when(_named(PERSON_NAMES) | _named(ADDRESS_NAMES), "name_only").otherwise("other_name")
    hinted = F.coalesce(by_signals, by_name)

    def made(confidence: str, kind: Column) -> Column:
        algorithm, threshold = _choice(kind)
        return Proposal("similarity").at(confidence, F.concat(F.lit("content: "), kind), algorithm=algorithm, threshold=threshold)

    return F.when(
        ~_named(ID_NAMES),
        _first((F.col("n_variants") > 0, made("high", evidence)), (_named(PARTY_NAMES), made("medium", hinted))),
    )


def timeliness_rule() -> Column:
    return F.when(_named(UPDATE_NAMES), Proposal("timeliness").medium("update date", max_age_days=365))


def suggestions(profile: DataFrame, as_of: str | None = None, dimensions: list[str] | None = None) -> DataFrame:
    """(column, dimension, confidence, reason, params) for every row of a profile table (see ``context``)."""
    makers = {
        "completeness": completeness_rule, "uniqueness": uniqueness_rule, "validity": validity_rule, "consistency": consistency_rule,
        "accuracy": accuracy_rule, "validity_period": lambda: validity_period_rule(as_of), "precision": precision_rule,
        "reasonableness": reasonableness_rule, "similarity": similarity_rule, "timeliness": timeliness_rule,
    }
    rules = [make() for d, make in makers.items() if dimensions is None or d in dimensions]
    return profile.select("column", F.explode(F.array_compact(F.array(*rules))).alias("s")).select("column", "s.*")


def rules_from(found: DataFrame) -> list[Rule]:
    """Rules ready for an analysis. The suggestion table has at most ten rows per column, so it is collected."""
    numeric = {"min_value": float, "max_value": float, "min_length": int, "max_length": int, "threshold": float, "max_age_days": int}
    out = []
    for row in found.select("column", "dimension", "params").collect():
        params = {k: numeric.get(k, str)(v) for k, v in (row.params or {}).items()}
        if "allowed_values" in params:
            params["allowed_values"] = json.loads(params["allowed_values"])
        out.append(Rule(row["column"], row.dimension, params))
    return out
