"""Column and table profiles. Every function returns a long table, one row per column or per (column, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.dates import DEFAULT_FORMATS, moment, parse_date
from plumbline.functions.patterns import VOTE_PRIORITY, vote_label
from plumbline.functions.text import (
    COMPANY_ENDINGS,
    STREET_MARKS,
    is_blank,
    is_missing,
    mask,
    strip,
    words,
)
from plumbline.operators.outliers import exact_quantiles, number_of
from plumbline.operators.uniqueness import duplicate_rows, looks_like_id

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
CATALOGUE = 20  # fixed value: at most this many distinct values make a catalogue

# Written date formats that are counted, with the pattern Spark reads them by.
COUNTED_FORMATS = {
    "YYYY-MM-DD": "yyyy-M-d",
    "DD/MM/YYYY": "d/M/yyyy",
    "MM/DD/YYYY": "M/d/yyyy",
    "DD-MM-YYYY": "d-M-yyyy",
    "DD-MM-YY": "d-M-yy",
    "YYYY/MM/DD": "yyyy/M/d",
    "DD Mon YYYY": "d MMM yyyy",
    "Month DD, YYYY": "MMMM d, yyyy",
    "YYYYMMDD": "yyyyMMdd",
    "DD.MM.YYYY": "d.M.yyyy",
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t.startswith(NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def date_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t.startswith("timestamp") or t == "date"]


def pct(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(part / total * 100, 4)).otherwise(F.lit(0.0))


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with values as text, missing ones kept as NULL."""
    types = dict(df.dtypes)
    items = [
        F.struct(
            F.lit(n).alias("column"),
            F.when(~is_missing(F.col(n), types[n]), F.col(n).cast("string")).alias("value"),
        )
        for n in columns
    ]
    return df.select(F.explode(F.array(*items)).alias("c")).select("c.*")


def cell_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): the one shuffle most text metrics are computed from."""
    return cells(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _unpivot(stats: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One row per column from a one-row aggregate whose columns are named ``<i>_<field>``."""
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{f}").alias(f) for f in fields]) for i, c in enumerate(columns)
    ]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _per_column(df: DataFrame, columns: list[str], metrics) -> DataFrame:
    """One aggregate over all columns; ``metrics(column)`` maps field names to aggregates."""
    made = [metrics(c) for c in columns]
    stats = df.agg(*[agg.alias(f"{i}_{f}") for i, m in enumerate(made) for f, agg in m.items()])
    return _unpivot(stats, columns, list(made[0]))


def quantile_columns(df: DataFrame, columns: list[str], points: list[float], method: str) -> dict[str, Column]:
    """Per column an array of quantiles for use in an aggregate: exact ones are literals found before, or a sketch."""
    if method == "exact":
        found = exact_quantiles(df, columns, points) if columns else {}
        return {c: F.array(*[F.lit(q).cast("double") for q in found[c]]) for c in columns}
    return {c: F.percentile_approx(number_of(df, c), F.array(*map(F.lit, points)), 10000) for c in columns}


def column_info(df: DataFrame, quantiles: str | None = "exact") -> DataFrame:
    """Name, type, rows, missing values; range and 5th/95th percentile of numeric columns (NULL without ``quantiles``)."""
    numeric, types = set(numeric_columns(df)) if quantiles else set(), dict(df.dtypes)
    points = quantile_columns(df, [c for c in df.columns if c in numeric], [0.05, 0.95], quantiles)

    def metrics(c: str) -> dict[str, Column]:
        v = number_of(df, c) if c in numeric else F.lit(None).cast("double")
        q = points[c] if c in numeric else F.array(*[F.max(v)] * 2)
        return {
            "data_type": F.max(F.lit(types[c])),
            "n_rows": F.count(F.lit(1)),
            "n_nulls": F.count_if(is_missing(F.col(f"`{c}`"), types[c])),
            "min_value": F.round(F.min(v), 4),
            "max_value": F.round(F.max(v), 4),
            "p5": F.round(q[0], 4),
            "p95": F.round(q[1], 4),
        }

    return _per_column(df, df.columns, metrics)


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, share of filled cells, repeated rows, bytes of text."""
    missing = [F.count_if(is_missing(F.col(f"`{n}`"), t)) for n, t in df.dtypes]
    size = [F.coalesce(F.sum(F.octet_length(F.col(f"`{n}`"))), F.lit(0)) for n in string_columns(df)] or [F.lit(0)]
    stats = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        sum(missing[1:], missing[0]).alias("missing"),
        sum(size[1:], size[0]).cast("bigint").alias("text_bytes"),
    )
    filled = F.col("n_rows") * len(df.columns)
    return stats.select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.when(filled > 0, F.round((1 - F.col("missing") / filled) * 100, 4)).otherwise(F.lit(100.0)).alias("filled_pct"),
        duplicate_rows(df).scalar().alias("duplicate_rows"),
        "text_bytes",
    )


def format_votes(df: DataFrame, columns: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Detected format per text column: the label of at least half (and three) of its values, else free text."""
    columns = string_columns(df) if columns is None else columns
    counts = cell_counts(df, columns) if counts is None else counts
    votes = counts.where(F.col("value").isNotNull()).select("column", "n", _label(F.col("value")).alias("label"))
    return votes.groupBy("column").agg(*_votes()).select("column", _winner().alias("format"))


def _label(value: Column) -> Column:
    return F.coalesce(vote_label(strip(value)), F.lit("free_text"))


def _votes() -> list[Column]:
    """Votes for every label, and all votes, of rows with label and n."""
    return [
        F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).alias("filled"),
        *[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(k) for k in VOTE_PRIORITY],
    ]


def _winner() -> Column:
    best = F.greatest(*VOTE_PRIORITY)
    winner = F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in VOTE_PRIORITY])
    enough = F.greatest(F.lit(3.0), F.col("filled") * 0.5)
    return F.when(F.col("filled") > 0, F.when(best >= enough, winner).otherwise("free_text"))


def text_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Format, blank share, lengths, mixed case and a sketch of the distinct values of text columns.

    All of it is added up in the tasks that read the rows, so that one row per column and task is shuffled.
    ``few`` is true for every column with at most ``CATALOGUE`` distinct values, and for some with a few more: values
    touch at most as many of the sketch's 512 registers as there are values, and the estimate then counts registers.
    """
    v, n = F.col("value"), F.lit(1)
    rows = cells(df, columns).select(
        "column", "value", n.alias("n"), F.when(v.isNotNull(), _label(v)).alias("label")
    )
    facts = rows.groupBy("column").agg(
        *_votes(),
        pct(F.count_if(is_blank(v)), F.count(n)).alias("blank_pct"),
        F.min(F.char_length(v)).cast("bigint").alias("length_min"),
        F.max(F.char_length(v)).cast("bigint").alias("length_max"),
        F.coalesce(F.bool_or(v.rlike("[A-Z]") & v.rlike("[a-z]")), F.lit(False)).alias("mixed_case"),
        (F.approx_count_distinct(v, 0.05) <= 2 * CATALOGUE).alias("few"),
    )
    return facts.select("column", _winner().alias("format"), "blank_pct", "length_min", "length_max", "mixed_case", "few")


def distinct_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(F.count_if(F.col("value").isNotNull()).alias("n_distinct"))


def typed_routes(df: DataFrame) -> dict[str, str]:
    """Profile kind of every column that isn't text: its type says it."""
    numeric, dates = numeric_columns(df), date_columns(df)
    return {
        n: "numeric" if n in numeric else "date" if n in dates else "categorical" if t == "boolean" else "skipped"
        for n, t in df.dtypes
        if t != "string"
    }


def routes(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Profile kind of every column: numeric, date, categorical or text."""
    texts = string_columns(df)
    out = df.sparkSession.createDataFrame(list(typed_routes(df).items()), "column string, kind string")
    if not texts:
        return out
    counts = cell_counts(df, texts) if counts is None else counts
    voted = format_votes(df, texts, counts).join(distinct_counts(counts), "column", "right")
    kind = F.when(F.col("format") == "date", "date").when(F.col("n_distinct") <= CATALOGUE, "categorical").otherwise("text")
    return out.unionByName(voted.select("column", kind.alias("kind")))


def skew_label(skew: Column) -> Column:
    return F.when(F.abs(skew) < 0.5, "normal").when(skew > 0.5, "right").when(skew.isNotNull(), "left")


def corrected_skewness(v: Column) -> Column:
    """Bias-corrected sample skewness, NULL below three values or without spread."""
    n = F.count(v).cast("double")
    usable = (n >= 3) & (F.max(v) > F.min(v))
    return F.when(usable, F.skewness(v) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def numeric_profile(df: DataFrame, columns: list[str] | None = None, quantiles: str = "exact") -> DataFrame:
    """Location, spread, shape and special shares of all numeric columns from one aggregate."""
    columns = numeric_columns(df) if columns is None else columns
    points = quantile_columns(df, columns, [0.05, 0.25, 0.5, 0.75, 0.95], quantiles)

    def metrics(c: str) -> dict[str, Column]:
        v, n = number_of(df, c), F.count(F.lit(1))
        mean, std = F.avg(v), F.stddev_samp(v)
        q = points[c]
        skew = corrected_skewness(v)
        return {
            "min_value": F.min(v),
            "max_value": F.max(v),
            "mean": F.round(mean, 4),
            "median": F.round(q[2], 4),
            "std": F.round(std, 4),
            "total": F.round(F.sum(v), 4),
            "p5": F.round(q[0], 4),
            "p25": F.round(q[1], 4),
            "p75": F.round(q[3], 4),
            "p95": F.round(q[4], 4),
            "cv_pct": F.round(F.abs(std / F.when(mean != 0, mean)) * 100, 4),
            "null_pct": pct(n - F.count(v), n),
            "zero_pct": pct(F.count_if(v == 0), n),
            "negative_pct": pct(F.count_if(v < 0), n),
            "skew": F.round(skew, 4),
            "skew_label": skew_label(skew),
        }

    return _per_column(df, columns, metrics)


def outlier_counts(df: DataFrame, columns: list[str] | None = None, quantiles: str = "exact") -> DataFrame:
    """Values outside the 1.5 quartile fences per numeric column; the fences come from one scalar subquery."""
    columns = numeric_columns(df) if columns is None else columns
    quartiles = quantile_columns(df, columns, [0.25, 0.75], quantiles)
    limits = df.agg(F.struct(*[quartiles[c].alias(f"q{i}") for i, c in enumerate(columns)]).alias("q")).scalar()

    def metrics(c: str) -> dict[str, Column]:
        v, q = number_of(df, c), F.col("__q").getField(f"q{columns.index(c)}")
        margin = (q[1] - q[0]) * 1.5
        return {"outliers": F.count_if((v < q[0] - margin) | (v > q[1] + margin))}

    return _per_column(df.withColumn("__q", limits), columns, metrics)


def _bins(rows: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins of (column, x, n) per column, last bin closed, constant columns widened by a half."""
    ranges = rows.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    low = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    high = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    edges = ranges.select("column", low.alias("lo"), high.alias("hi"))
    placed = rows.join(F.broadcast(edges), "column").select(  # one row per table column
        "column",
        "lo",
        "hi",
        "n",
        F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).alias("bin"),
    )
    counts = placed.groupBy("column", "bin").agg(F.sum("n").alias("n"))
    grid = edges.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, ["column", "bin"], "left").select(
        "column",
        "bin",
        F.round(F.col("lo") + F.col("bin") * width, 4).alias("from_value"),
        F.round(F.col("lo") + (F.col("bin") + 1) * width, 4).alias("to_value"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    columns = numeric_columns(df) if columns is None else columns
    items = [F.struct(F.lit(c).alias("column"), number_of(df, c).alias("x")) for c in columns]
    rows = df.select(F.explode(F.array(*items)).alias("i")).select("i.*").where(F.col("x").isNotNull())
    return _bins(rows.withColumn("n", F.lit(1)), bins)


def length_histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 5) -> DataFrame:
    """Bins of text length; lengths are counted first, so the bins see one row per length."""
    columns = string_columns(df) if columns is None else columns
    lengths = (
        cells(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column", F.char_length("value").cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _bins(lengths, bins)


def cardinality(distinct: Column, rows: Column) -> Column:
    share = distinct / rows
    return F.when(share > 0.5, "high").when(share >= 0.05, "medium").otherwise("low")


def text_profile(df: DataFrame, columns: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Distinct values, cardinality, lengths, missing, blank and space-only shares, mixed case."""
    columns = string_columns(df) if columns is None else columns
    counts = cell_counts(df, columns) if counts is None else counts
    v, n, rows = F.col("value"), F.col("n"), F.sum("n")

    def share(condition: Column) -> Column:
        return pct(F.coalesce(F.sum(F.when(condition, n)), F.lit(0)), rows)

    return counts.groupBy("column").agg(
        F.count_if(v.isNotNull()).alias("n_distinct"),
        cardinality(F.count_if(v.isNotNull()), rows).alias("cardinality"),
        (F.count_if(v.isNotNull()) <= CATALOGUE).alias("is_catalogue"),
        F.min(F.char_length(v)).cast("bigint").alias("length_min"),
        F.max(F.char_length(v)).cast("bigint").alias("length_max"),
        F.round(F.sum(F.char_length(v) * n) / F.sum(F.when(v.isNotNull(), n)), 4).alias("length_mean"),
        share(v.isNull()).alias("null_pct"),
        share(is_blank(v)).alias("blank_pct"),
        share(is_blank(v) & (v != "")).alias("space_only_pct"),
        F.coalesce(F.bool_or(v.rlike("[A-Z]") & v.rlike("[a-z]")), F.lit(False)).alias("mixed_case"),
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """Most frequent values per column; ties by value. Each task keeps only its own top k before the shuffle."""
    columns = string_columns(df) if columns is None else columns
    counts = cell_counts(df, columns) if counts is None else counts
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rows = df.agg(F.count(F.lit(1)))
    return ranked.select("column", F.col("rank").cast("bigint").alias("rank"), "value", "n", pct(F.col("n"), rows.scalar()).alias("pct"))


def case_variants(df: DataFrame, columns: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Values that are equal after trimming and lower-casing but written in more than one way."""
    columns = string_columns(df) if columns is None else columns
    counts = cell_counts(df, columns) if counts is None else counts
    values = counts.where(F.col("value").isNotNull()).select("column", "value")
    groups = values.groupBy("column", F.lower(strip(F.col("value"))).alias("form")).agg(
        F.count(F.lit(1)).alias("spellings")
    ).where(F.col("spellings") > 1)
    back = values.withColumn("form", F.lower(strip(F.col("value")))).join(groups, ["column", "form"])
    return back.select("column", "form", "value", "spellings")


def masks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shapes of the values per column with counts and shares; missing values have the shape ``-null-``."""
    columns = string_columns(df) if columns is None else columns
    shaped = cells(df, columns).groupBy("column", mask(F.col("value")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    return shaped.withColumn("pct", pct(F.col("n"), df.agg(F.count(F.lit(1))).scalar()))


def name_signals(df: DataFrame, columns: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Signals for the choice of a similarity algorithm; columns with fewer than ten filled values are left out."""
    columns = string_columns(df) if columns is None else columns
    counts = cell_counts(df, columns) if counts is None else counts
    low = F.lower(strip(F.col("value")))
    rows = counts.where(F.col("value").rlike(r"\S")).select(
        "column",
        "n",
        F.element_at(words(F.translate(low, ",", " ")), -1).isin(COMPANY_ENDINGS).alias("company"),
        F.exists(F.array(*map(F.lit, STREET_MARKS)), lambda s: F.contains(low, s)).alias("street"),
        F.get(words(low), F.lit(0)).alias("first"),
        F.size(words(low)).alias("tokens"),
        low.rlike("[0-9]").alias("digit"),
    )
    # One row per first word: its distinct count needs no set of words per column.
    by_first = rows.groupBy("column", "first").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("company"), F.col("n")).otherwise(0)).alias("company"),
        F.sum(F.when(F.col("street"), F.col("n")).otherwise(0)).alias("street"),
        F.sum(F.col("tokens") * F.col("n")).alias("tokens"),
        F.sum(F.when(F.col("digit"), F.col("n")).otherwise(0)).alias("digit"),
    )
    total = F.sum("n")
    return by_first.groupBy("column").agg(
        F.round(F.sum("company") / total * 100, 1).alias("company_pct"),
        F.round(F.sum("street") / total * 100, 1).alias("street_pct"),
        F.round(F.count(F.lit(1)) / total, 3).alias("first_word_ratio"),
        F.count(F.lit(1)).alias("first_words"),
        F.round(F.sum("tokens") / total, 1).alias("mean_tokens"),
        F.round(F.sum("digit") / total * 100, 1).alias("digit_pct"),
        total.alias("filled"),
    ).where(F.col("filled") >= 10).drop("filled")


def date_profile(
    df: DataFrame, columns: list[str], as_of: str | None = None, formats: tuple[str, ...] = DEFAULT_FORMATS
) -> DataFrame:
    """Range, most frequent day, future and more than five years old shares (of all rows)."""
    types = dict(df.dtypes)
    now = moment(as_of)
    old = F.add_months(now.cast("date"), -60).cast("timestamp_ntz") + (now - now.cast("date").cast("timestamp_ntz"))

    def metrics(c: str) -> dict[str, Column]:
        v, n = parse_date(F.col(c), types[c], formats), F.count(F.lit(1))
        return {
            "date_min": F.min(v).cast("date").cast("string"),
            "date_max": F.max(v).cast("date").cast("string"),
            "range_days": F.extract(F.lit("DAY"), F.max(v) - F.min(v)).cast("bigint"),
            "null_pct": pct(F.count_if(F.col(c).isNull()), n),
            "future_pct": pct(F.count_if(v > now), n),
            "old_pct": pct(F.count_if(v < old), n),
        }

    days = _date_cells(df, columns, formats).groupBy("column", F.col("v").cast("date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    common = days.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "day")).getField("day").alias("common_day"))
    return _per_column(df, columns, metrics).join(common, "column", "left")


def _date_cells(df: DataFrame, columns: list[str], formats: tuple[str, ...]) -> DataFrame:
    types = dict(df.dtypes)
    items = [F.struct(F.lit(c).alias("column"), parse_date(F.col(c), types[c], formats).alias("v")) for c in columns]
    return df.select(F.explode(F.array(*items)).alias("i")).select("i.*").where(F.col("v").isNotNull())


def date_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values each written format can read, most frequent first; formats without a value are left out."""

    def metrics(c: str) -> dict[str, Column]:
        text = F.trim(F.col(c).cast("string"))
        return {f"f{i}": F.count(F.try_to_timestamp(text, F.lit(p))) for i, p in enumerate(COUNTED_FORMATS.values())}

    wide = _per_column(df, columns, metrics)
    rows = F.array(*[F.struct(F.lit(k).alias("format"), F.col(f"f{i}").alias("n")) for i, k in enumerate(COUNTED_FORMATS)])
    return wide.select("column", F.explode(rows).alias("f")).select("column", "f.*").where(F.col("n") > 0)


def date_distribution(df: DataFrame, columns: list[str], formats: tuple[str, ...] = DEFAULT_FORMATS) -> DataFrame:
    """Counts per year and per month of the year."""
    dated = _date_cells(df, columns, formats).groupBy("column", F.year("v").alias("y"), F.month("v").alias("m")).agg(
        F.count(F.lit(1)).alias("n")
    )
    parts = F.array(
        F.struct(F.lit("year").alias("part"), F.col("y").cast("bigint").alias("value")),
        F.struct(F.lit("month").alias("part"), F.col("m").cast("bigint").alias("value")),
    )
    return dated.select("column", "n", F.explode(parts).alias("p")).groupBy("column", "p.part", "p.value").agg(F.sum("n").alias("n"))


def categorical_values(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Every value of a categorical column with count and share."""
    counts = cell_counts(df, columns) if counts is None else counts
    rows = df.agg(F.count(F.lit(1)))
    return counts.where(F.col("value").isNotNull()).withColumn("pct", pct(F.col("n"), rows.scalar()))


def categorical_profile(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Distinct values, most and least frequent value, entropy with label, extreme imbalance."""
    counts = cell_counts(df, columns) if counts is None else counts
    v, n = F.col("value"), F.col("n")
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("filled")
    )
    shares = counts.where(v.isNotNull()).join(F.broadcast(totals), "column")  # one row per table column
    p = n / F.col("filled")
    stats = shares.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.min(F.struct((-n).alias("n"), "value")).getField("value").alias("most_frequent"),
        F.max(F.struct((-n).alias("n"), "value")).getField("value").alias("least_frequent"),
        F.sum(-p * F.log2(p + 1e-12)).alias("bits"),
        (F.max(n) / F.max("n_rows") >= 0.95).alias("imbalanced"),
    )
    k = F.col("n_distinct")
    entropy = F.round(F.col("bits") / F.when(k > 1, F.log2(k.cast("double"))).otherwise(1.0), 3)
    return stats.select(
        "column", "n_distinct", "most_frequent", "least_frequent", entropy.alias("entropy"),
        entropy_label(entropy).alias("entropy_label"), "imbalanced",
    )


def entropy_label(entropy: Column) -> Column:
    return (
        F.when(entropy >= 0.9, "very balanced").when(entropy >= 0.7, "balanced")
        .when(entropy >= 0.4, "unbalanced").otherwise("extremely unbalanced")
    )


def alerts(df: DataFrame) -> DataFrame:
    """(column, alert, n): repeated ids, case variants, constants, many missing values, very many distinct texts."""
    texts = string_columns(df)
    simple = [n for n, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    counts = cell_counts(df, simple)
    v, n = F.col("value"), F.col("n")
    stats = counts.groupBy("column").agg(
        F.count_if(v.isNotNull()).alias("n_distinct"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("n_nulls"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("repeated"),
    )
    variants = case_variants(df, texts, counts.where(F.col("column").isin(texts))).groupBy("column").agg(
        F.count_distinct("form").alias("forms")
    )
    rows = stats.join(variants, "column", "left")
    is_id = F.col("column").isin([c for c in simple if looks_like_id(c)])
    is_text = F.col("column").isin(texts)
    d = F.col("n_distinct")
    found = F.array(
        F.when(is_id & (F.col("repeated") > 0), F.struct(F.lit("identifier with repeats").alias("alert"), F.col("repeated").alias("n"))),
        F.when(is_text & d.between(2, CATALOGUE) & (F.col("forms") > 0), F.struct(F.lit("variants of one value").alias("alert"), F.col("forms").alias("n"))),
        F.when((d == 1) & (F.col("n_rows") > 1), F.struct(F.lit("constant").alias("alert"), d.alias("n"))),
        F.when(F.col("n_nulls") / F.col("n_rows") > 0.3, F.struct(F.lit("many missing values").alias("alert"), F.col("n_nulls").alias("n"))),
        F.when(is_text & (d > 20000), F.struct(F.lit("very many distinct texts").alias("alert"), d.alias("n"))),
    )
    return rows.select("column", F.explode(F.array_compact(found)).alias("a")).select("column", "a.*")


def uniques(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values per column and, up to 15 of them, the ten most frequent."""
    columns = df.columns if columns is None else columns
    counts = cell_counts(df, columns)
    found = distinct_counts(counts)
    few = found.where(F.col("n_distinct") <= 15).select("column")
    top = top_values(df, columns, 10, counts.join(F.broadcast(few), "column", "left_semi"))  # one row per column
    lists = top.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("top_values")
    )
    return found.join(lists, "column", "left")


