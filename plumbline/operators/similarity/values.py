"""Distinct values of a column and the blocks that decide which of them may be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_placeholder, normalise, word_soundex, words

BLOCK_LIMIT = 200  # fixed value: larger blocks are split by three-letter prefix
AFFINE_BLOCK_LIMIT = 100  # fixed value: the same for the affine gap algorithm


def raw_values(df: DataFrame, column: str, full: bool = True) -> DataFrame:
    """(raw, v, n): distinct raw values that are not placeholders, their normal form, their rows."""
    raw = F.col(column).cast("string")
    return (
        df.select(raw.alias("raw"))
        .where(~is_placeholder(F.col("raw")))
        .groupBy("raw")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("v", normalise(F.col("raw"), full))
    )


def nodes(raws: DataFrame) -> DataFrame:
    """(v, n, n2, spellings): one row per normal form with rows, sum of squared rows and raw spellings."""
    return (
        raws.where(F.col("v") != "")
        .groupBy("v")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("spellings"))
    )


def blocking_keys(v: Column) -> Column:
    """Two-letter prefix, sound of the first word, length in steps of five, every word over three letters."""
    first = F.get(words(v), F.lit(0))
    size = (F.floor(F.char_length(v) / 5) * 5).cast("string")
    keys = F.array(
        F.when(F.char_length(v) >= 2, F.concat(F.lit("p:"), F.substring(v, 1, 2))),
        F.when(F.char_length(first) >= 2, F.concat(F.lit("s:"), word_soundex(first))),
        F.concat(F.lit("l:"), size),
    )
    long_words = F.transform(F.filter(words(v), lambda w: F.char_length(w) > 3), lambda w: F.concat(F.lit("t:"), w))
    return F.array_distinct(F.concat(F.array_compact(keys), long_words))


def block_sizes(nodes_: DataFrame) -> DataFrame:
    """(block, size) counted in raw spellings; combined map-side, so a block with most values is cheap."""
    exploded = nodes_.select("spellings", F.explode(blocking_keys(F.col("v"))).alias("block"))
    return exploded.groupBy("block").agg(F.sum("spellings").alias("size"))


def split_blocks(nodes_: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(v, spellings, block): members of every final block; large blocks carry a three-letter prefix."""
    large = block_sizes(nodes_).where(F.col("size") > limit).select("block", F.lit(True).alias("large"))
    members = nodes_.select("v", "spellings", F.explode(blocking_keys(F.col("v"))).alias("block"))
    prefix = F.concat_ws("|", "block", F.substring("v", 1, 3))
    return members.join(large.hint("merge"), "block", "left").select(
        "v", "spellings", F.when(F.col("large"), prefix).otherwise(F.col("block")).alias("block")
    )


def with_blocks(nodes_: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(v, blocks): a handful of block hashes per value."""
    return split_blocks(nodes_, limit).groupBy("v").agg(F.collect_set(F.xxhash64("block")).alias("blocks"))


def visited_pairs(members: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    """Pairs a comparison of whole blocks would visit, from block and length counts alone (no pair is built)."""
    if min_ratio <= 0:
        sizes = members.groupBy("block").agg(F.sum("spellings").alias("m"))
        return sizes.agg(F.coalesce(F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("bigint")), F.lit(0)).alias("visited"))
    lengths = members.groupBy("block", F.char_length("v").alias("len")).agg(F.sum("spellings").alias("m"))
    other = lengths.select("block", F.col("len").alias("len2"), F.col("m").alias("m2"))
    both = lengths.join(other.hint("merge"), "block").where(
        (F.col("len") <= F.col("len2")) & (F.col("len") / F.col("len2") >= min_ratio)
    )
    pairs = F.when(F.col("len") == F.col("len2"), (F.col("m") * (F.col("m") - 1) / 2).cast("bigint")).otherwise(
        F.col("m") * F.col("m2")
    )
    return both.agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("visited"))
