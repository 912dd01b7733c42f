"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import kept

#: The size of a text: runs of characters other than space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
LEVELS, WAYS = 3, 256


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """row (all columns of ``docs``), doc_id, source, size (words of the whole text; null has none) and seeded key."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    ids = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")]
    return docs.select(F.struct(*docs.columns).alias("row"), *ids).withColumn("key", _key(seed))


def weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources by code point, null last, get ``weights`` in turn. One row per source goes through one task."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")))


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """The level at which weight * level, clamped at max_epochs * source_size, uses up all words.

    Each round clamps the sources that the last level put above their maximum and shares what is left among the others
    by weight; the level only rises, so a source once clamped stays so, and the rounds end when no more are.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while total:
        over = cap < F.col("weight") * level
        n, fixed, free = sources.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == clamped or not free:
            break
        level, clamped = (total - fixed) / free, n
    return level


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """(source, source_size, weight, target) of the mix; a small table, one row per source."""
    sources = kept(weighted(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-sources", 16)
    level = water_level(sources, max_epochs)
    target = F.least((F.col("source_size") * max_epochs).cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def _key(seed: int):
    """24 seeded bits of a document, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 6), 16, 10).cast("long")


def source_cuts(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Per source its target, how often it repeats whole, and the key (path) and words (rest) at which the last part ends.

    The cut in the seeded order is found by sums over 256 ranges of the order, three times finer and finer, so no task
    sees the documents of one source together.
    """
    sources = source_targets(sizes, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", F.least(whole, F.lit(max_epochs)).cast("long"))
    rest = F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    cut = kept(sources.withColumn("rest", F.greatest(rest, F.lit(0))).withColumn("path", F.lit(0).cast("long")), "mix-cut", 16)
    by_range = Window.partitionBy("source").orderBy("range")
    for level in range(1, LEVELS + 1):
        width = WAYS ** (LEVELS - level)
        at = cut.select(F.col("source").alias("_s"), "path", "rest")
        near = sizes.join(at, sizes["source"].eqNullSafe(at["_s"])).where(F.floor(F.col("key") / (width * WAYS)) == F.col("path"))
        sums = near.groupBy("source", F.floor(F.col("key") / width).alias("range"), "rest").agg(F.sum("size").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(by_range))
        # the first range that the rest doesn't fill; past the last one if it fills them all
        step = sums.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("range"))).alias("open"),
            F.max("range").alias("last"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("full"),
        )
        step = step.select(F.col("source").alias("_s"), F.coalesce("open", F.col("last") + 1).alias("_path"), "full")
        # a source that is taken to its end has no rows left to look at
        cut = cut.join(step, cut["source"].eqNullSafe(step["_s"]), "left").drop("_s").withColumn("rest", F.col("rest") - F.coalesce("full", F.lit(0)))
        cut = kept(cut.withColumn("path", F.coalesce("_path", F.col("path") * WAYS)).drop("_path", "full"), "mix-cut", 16)
    return cut


def placed(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` (with doc_id, source, size, key) and source_size, target, taken."""
    at = cut.withColumnRenamed("source", "_s")
    columns = [*rows.columns, "source_size", "target"]
    rows = rows.join(at, rows["source"].eqNullSafe(at["_s"])).drop("_s")
    order = Window.partitionBy("source", "key").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(F.col("key") == F.col("path"))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    clear = rows.where(F.col("key") != F.col("path")).withColumn("part", F.when(F.col("key") < F.col("path"), F.col("size")).otherwise(0))
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return clear.unionByName(edge).select(*columns, taken)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target, taken. The sources share the words of the whole table in
    proportion to their weights; a source gives at most ``max_epochs`` times its size, and what it can't give is shared
    by the others. A source repeats whole as often as its target holds it. The rest is taken in a seeded order of its
    documents: whole documents up to one that is taken in part, so the words taken equal the target rounded down. No
    document gives more than ``max_epochs`` times its size. Reruns agree.

    Null text or text without words has size 0 and gives 0. A null source is a source of its own, last in order. Rows
    that repeat count as rows of their own. An empty table gives no rows. Other columns are ignored.
    """
    sizes = kept(sized(docs, seed).drop("row"), "mix-sizes")
    return placed(sizes, source_cuts(sizes, weights, max_epochs)).drop("key")


def repeated(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mixed rows themselves: every document as often as ``mix`` takes it whole, and its first words for a part.

    Same columns as ``docs``; n_chars, if there, is set for a cut text. Documents that the mix doesn't take are absent.
    """
    rows = sized(docs, seed)
    cut = source_cuts(kept(rows.drop("row"), "mix-sizes"), weights, max_epochs)
    rows = placed(rows, cut).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    left = F.explode(F.transform(F.sequence(F.lit(1), copies), lambda k: F.least(F.col("size"), F.col("taken") - (k - 1) * F.col("size"))))
    rows = rows.select("row", "size", left.alias("left"))
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("left") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("left").cast("int")), "")).otherwise(F.col("row.text"))
    rows = rows.select("row", "size", "left", text.alias("text"))
    out = {name: F.col("row")[name] for name in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("left") < F.col("size"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[out[name].alias(name) for name in docs.columns])
