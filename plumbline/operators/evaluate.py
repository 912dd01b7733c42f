"""How good a near-duplicate run is against known entities. Pair counts come from group sizes, not from pair lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import normalise, padded_trigrams, words
from plumbline.operators.similarity import candidates as cand
from plumbline.operators.similarity import pipeline as pl
from plumbline.operators.similarity import values as val
from plumbline.session import checkpointed


def pairs_of(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("bigint")


def group_links(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """(key, a, b): every record with the first record of its group. Linear in the rows, however large a group is."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("a"))
    return df.join(first, key).where(F.col(id_col) != F.col("a")).select(key, "a", F.col(id_col).alias("b"))


def group_pairs(df: DataFrame, key: str) -> DataFrame:
    """(key, members, pairs): record pairs of every group with more than one member, counted."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    return sizes.where(F.col("members") > 1).withColumn("pairs", pairs_of(F.col("members")))


def quality(tp: Column, detected: Column, true: Column) -> list[Column]:
    """Precision, recall and F1; 0 when undefined."""
    precision = F.when((detected > 0) & (true > 0), tp / detected).otherwise(0.0)
    recall = F.when((detected > 0) & (true > 0), tp / true).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [F.round(c, 4).alias(n) for c, n in ((precision, "precision"), (recall, "recall"), (f1, "f1"))]


def precision_recall(df: DataFrame, id_col: str, entity: str, groups: DataFrame) -> DataFrame:
    """TP, FP, FN and P, R, F1 of a grouping (record_id, group_id) from the (entity, group) contingency table."""
    rows = df.select(F.col(id_col).alias("record_id"), F.col(entity).alias("entity")).join(cand.shuffled(groups), "record_id", "left")
    cell = rows.groupBy("entity", "group_id").agg(F.count(F.lit(1)).alias("n"))
    both = cell.where(F.col("entity").isNotNull() & F.col("group_id").isNotNull())
    tp = both.agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0)).alias("tp"))
    true = cell.where(F.col("entity").isNotNull()).groupBy("entity").agg(F.sum("n").alias("n"))
    found = cell.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.sum("n").alias("n"))
    count = F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0))
    wide = tp.withColumn("true_pairs", true.agg(count).scalar()).withColumn("detected", found.agg(count).scalar())
    return wide.select(
        "tp", (F.col("detected") - F.col("tp")).alias("fp"), (F.col("true_pairs") - F.col("tp")).alias("fn"),
        *quality(F.col("tp"), F.col("detected"), F.col("true_pairs")),
    )


class PairTruth:
    """Scored value pairs of several algorithms joined once with the entity counts of the values."""

    def __init__(self, df: DataFrame, column: str, entity: str):
        v = normalise(F.col(column).cast("string"))
        rows = df.select(v.alias("v"), F.col(entity).alias("entity"), F.col(column).cast("string").alias("raw"))
        self.rows = rows.where(~val.is_placeholder(F.col("raw")) & (F.col("v") != ""))
        self.by_entity = self.rows.groupBy("v", "entity").agg(F.count(F.lit(1)).alias("n"))
        self.nodes = self.by_entity.groupBy("v").agg(F.sum("n").alias("n"))

    def true_pairs(self) -> DataFrame:
        sizes = self.by_entity.groupBy("entity").agg(F.sum("n").alias("n"))
        return sizes.agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0)).alias("true_pairs"))

    def links(self, algorithm: str, threshold: float) -> DataFrame:
        """(similarity, links, true_links): record pairs behind every scored value pair and every single value."""
        pairs = checkpointed(pl.scored_pairs(self.nodes.select("v"), algorithm, threshold))
        left = self.by_entity.select(F.col("v").alias("a"), "entity", F.col("n").alias("na"))
        right = self.by_entity.select(F.col("v").alias("b"), "entity", F.col("n").alias("nb"))
        good = pairs.join(cand.shuffled(left), "a").join(cand.shuffled(right), ["b", "entity"]).select("similarity", F.lit(0).cast("bigint").alias("links"), (F.col("na") * F.col("nb")).alias("true_links"))
        na = self.nodes.select(F.col("v").alias("a"), F.col("n").alias("na"))
        nb = self.nodes.select(F.col("v").alias("b"), F.col("n").alias("nb"))
        every = pairs.join(cand.shuffled(na), "a").join(cand.shuffled(nb), "b").select("similarity", (F.col("na") * F.col("nb")).alias("links"), F.lit(0).cast("bigint").alias("true_links"))
        same = self.nodes.where(F.col("n") > 1).select(F.lit(100.0).alias("similarity"), pairs_of(F.col("n")).alias("links"), F.lit(0).cast("bigint").alias("true_links"))
        same_good = self.by_entity.where(F.col("n") > 1).select(
            F.lit(100.0).alias("similarity"), F.lit(0).cast("bigint").alias("links"), pairs_of(F.col("n")).alias("true_links")
        )
        return every.unionByName(good).unionByName(same).unionByName(same_good)


def exhaustive(df: DataFrame, column: str, entity: str, algorithm: str, threshold: float) -> DataFrame:
    """Ceiling of an algorithm: every pair above the threshold (the lossless join finds them all) against the truth."""
    truth = PairTruth(df, column, entity)
    stats = truth.links(algorithm, threshold).agg(
        F.coalesce(F.sum("true_links"), F.lit(0)).alias("tp"), F.coalesce(F.sum("links"), F.lit(0)).alias("detected")
    )
    wide = stats.withColumn("true_pairs", truth.true_pairs().scalar())
    return wide.select("tp", "detected", "true_pairs", *quality(F.col("tp"), F.col("detected"), F.col("true_pairs")))


def threshold_sweep(
    df: DataFrame, column: str, entity: str, algorithms: list[str], thresholds: list[float], min_precision: float = 0.75
) -> DataFrame:
    """Quality per algorithm and threshold; pairs are scored once per algorithm. The best trustworthy F1 is marked."""
    truth = PairTruth(df, column, entity)
    scored = None
    for algorithm in algorithms:
        part = truth.links(algorithm, min(thresholds)).withColumn("algorithm", F.lit(algorithm))
        scored = part if scored is None else scored.unionByName(part)
    levels = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("similarity") >= t))
    sums = scored.select("algorithm", "links", "true_links", levels.alias("threshold")).groupBy("algorithm", "threshold").agg(
        F.sum("true_links").alias("tp"), F.sum("links").alias("detected")
    )
    # a threshold that no pair reaches has a row of its own
    asked = df.sparkSession.createDataFrame([(a, float(t)) for a in algorithms for t in thresholds], "algorithm string, threshold double").distinct()
    none = F.lit(0).cast("bigint")
    sums = asked.join(sums, ["algorithm", "threshold"], "left").withColumns({c: F.coalesce(c, none) for c in ("tp", "detected")})
    sums = sums.withColumn("true_pairs", truth.true_pairs().scalar())
    rated = sums.select(
        "algorithm", "threshold", "tp", "detected", *quality(F.col("tp"), F.col("detected"), F.col("true_pairs"))
    )
    # At most algorithms x thresholds rows from here on.
    trusted = (F.col("precision") >= min_precision).cast("int")
    order = Window.partitionBy("algorithm").orderBy(trusted.desc(), F.desc("f1"), "threshold")
    return rated.withColumn("best", F.row_number().over(order) == 1)


def value_entities(df: DataFrame, column: str, entity: str) -> DataFrame:
    """(entity, v): the distinct normal forms of every entity."""
    v = normalise(F.col(column).cast("string"))
    rows = df.where(~val.is_placeholder(F.col(column).cast("string"))).select(F.col(entity).alias("entity"), v.alias("v"))
    return rows.where(F.col("v") != "").distinct()


def value_links(df: DataFrame, column: str, entity: str) -> DataFrame:
    """(a, b): every distinct normal form with the first one of its entity, a < b."""
    rows = value_entities(df, column, entity)
    first = rows.groupBy("entity").agg(F.min("v").alias("a"))
    return rows.join(first, "entity").where(F.col("v") != F.col("a")).select("a", F.col("v").alias("b")).distinct()


def judged(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``true``: both values are forms of one entity (null entities link nothing)."""
    left = entities.select(F.col("v").alias("a"), "entity")
    right = entities.select(F.col("v").alias("b"), "entity")
    hits = pairs.select("a", "b").join(cand.shuffled(left), "a").join(cand.shuffled(right), ["b", "entity"]).select("a", "b").distinct()
    return pairs.join(cand.shuffled(hits.withColumn("true", F.lit(True))), ["a", "b"], "left").withColumn("true", F.coalesce("true", F.lit(False)))


def usable_words(values: DataFrame, token_limit: int) -> DataFrame:
    """(v, t): words of three letters or more that at most ``token_limit`` values have."""
    tokens = values.select("v", F.explode(F.array_distinct(words(F.col("v")))).alias("t")).where(F.char_length("t") >= 3)
    rare = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= token_limit).select("t")
    return tokens.join(cand.shuffled(rare), "t")


def length_pairs(values: DataFrame, by: list[str], ratio: float) -> Column:
    """Scalar: pairs of ``values`` that agree in ``by`` and whose shorter length is ``ratio`` of the longer or more.

    Counted from a running sum over the distinct lengths of each group: a length L meets the lengths from ratio * L on.
    """
    sizes = values.groupBy(*by, F.char_length("v").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    counts = sizes.select(*by, F.col("at").cast("double").alias("at"), "n", none.alias("asks"))
    asked = sizes.select(*by, (F.ceil(F.col("at") * ratio - 1e-9) - 0.5).alias("at"), none.alias("n"), F.col("n").alias("asks"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, -1)
    run = counts.unionByName(asked).withColumn("below", F.coalesce(F.sum("n").over(before), none))
    # with all shorter lengths, less those that are too short
    pairs = F.col("n") * F.col("below") + pairs_of(F.col("n")) - F.col("asks") * F.col("below")
    return run.agg(F.coalesce(F.sum(pairs), none)).scalar()


def word_pairs(forms: DataFrame, values: DataFrame, token_limit: int) -> DataFrame:
    """(entity, a, b): true pairs with a usable word in common. A word is in few values, so its pairs are few."""
    worded = forms.join(cand.shuffled(usable_words(values, token_limit)), "v")
    left, right = (worded.select("entity", "t", F.col("v").alias(c)) for c in "ab")
    return left.join(cand.shuffled(right), ["entity", "t"]).where("a < b").select("entity", "a", "b").distinct()


def uncovered(ratio: float) -> Column:
    """A pair (a, b) that neither its first three letters nor its lengths propose."""
    shorter, longer = F.least(F.char_length("a"), F.char_length("b")), F.greatest(F.char_length("a"), F.char_length("b"))
    return (F.substring("a", 1, 3) != F.substring("b", 1, 3)) & (shorter < F.ceil(longer * ratio - 1e-9))


def blocking_coverage(forms: DataFrame, values: DataFrame, ratios: tuple[float, ...] = (0.25, 0.7), token_limit: int = 200) -> DataFrame:
    """Per strategy: comparisons it proposes on ``values`` (v) and true pairs of ``forms`` (entity, v) it covers.

    Strategies: same first three letters, a usable word in common, length ratio of each of ``ratios``, and all together.
    All pairs of distinct forms of an entity are true. None is listed but those with a usable word: prefixes and lengths
    are counted by group, and the union by inclusion and exclusion.
    """
    # Both are counted in many ways, and each would normalise all names again.
    values = checkpointed(values.select("v"))
    forms = checkpointed(forms.where("entity is not null").select("entity", "v")).withColumn("prefix", F.substring("v", 1, 3))
    shared = checkpointed(word_pairs(forms.select("entity", "v"), values, token_limit))
    n, total = F.count(F.lit(1)), F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0))

    def grouped(df: DataFrame, *by) -> Column:
        return df.groupBy(*by).agg(n.alias("n")).agg(total).scalar()

    prefix = grouped(forms, "entity", "prefix")
    words_ = usable_words(values, token_limit)
    lines = [("prefix", grouped(values, F.substring("v", 1, 3)), prefix), ("token", grouped(words_, "t"), shared.agg(n).scalar())]
    for r in ratios:
        length = length_pairs(forms, ["entity"], r)
        lines.append((f"length_{r:g}", length_pairs(values, [], r), length))
        rest = shared.where(uncovered(r)).agg(n).scalar()
        lines.append((f"union_{r:g}", F.lit(None).cast("bigint"), prefix + length - length_pairs(forms, ["entity", "prefix"], r) + rest))
    rows = F.array(*[F.struct(F.lit(name).alias("strategy"), p.cast("bigint").alias("proposed"), c.cast("bigint").alias("covered")) for name, p, c in lines])
    links = forms.groupBy("entity").agg(n.alias("n")).agg(total.alias("links"))
    return links.select(F.explode(rows).alias("r"), "links").select("r.*", "links")


def orphans(forms: DataFrame, values: DataFrame, ratio: float = 0.7, token_limit: int = 200) -> DataFrame:
    """(entity, a, b): true pairs that no strategy proposes.

    Forms of an entity are first compared by class (first letters, length), so that only pairs of classes that neither
    strategy covers are written out.
    """
    forms = forms.where("entity is not null")
    classes = forms.select("entity", F.substring("v", 1, 3).alias("prefix"), F.char_length("v").alias("size")).distinct()
    left, right = (classes.select("entity", F.col("prefix").alias(f"p{k}"), F.col("size").alias(f"n{k}")) for k in "12")
    apart = left.join(right, "entity").where((F.col("p1") != F.col("p2")) & (F.col("n1") < F.ceil(F.col("n2") * ratio - 1e-9)))
    first, second = (
        forms.select("entity", F.substring("v", 1, 3).alias(f"p{k}"), F.char_length("v").alias(f"n{k}"), F.col("v").alias(f"v{k}")) for k in "12"
    )
    pairs = apart.join(first, ["entity", "p1", "n1"]).join(second, ["entity", "p2", "n2"])
    pairs = pairs.select("entity", F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b"))
    return pairs.join(word_pairs(forms, values, token_limit), ["entity", "a", "b"], "left_anti")


def cap_loss(stream: DataFrame, cap: int) -> DataFrame:
    """True pairs among the ranked candidates (a, b, containment, true) before and after a cap on the best."""
    before = stream.agg(F.count_if(F.col("true")).alias("before_cap"))
    after = pl.best_of(stream, cap).agg(F.count_if(F.col("true")))
    return before.withColumn("after_cap", after.scalar()).withColumn("lost", F.col("before_cap") - F.col("after_cap"))


def trigram_jaccard(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("jaccard", cand.jaccard(padded_trigrams(F.col("a")), padded_trigrams(F.col("b"))))


def cap_strategies(stream: DataFrame, members: DataFrame, cap: int, per_block: int) -> DataFrame:
    """True pairs that survive a cap by length difference, a cap per block, and a cap by trigram similarity."""
    gap = F.abs(F.char_length("a") - F.char_length("b"))
    sides = members.select(F.col("v").alias("a"), "block"), members.select(F.col("v").alias("b"), "block")
    in_block = stream.join(cand.shuffled(sides[0]), "a").join(cand.shuffled(sides[1]), ["b", "block"])
    order = Window.partitionBy("block").orderBy(gap, "a", "b")
    kept = {
        "length_difference": stream.orderBy(gap, "a", "b").limit(cap),
        "per_block": in_block.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_block),
        "trigram": trigram_jaccard(stream).orderBy(F.desc("jaccard"), "a", "b").limit(cap),
    }
    out = None
    for name, table in kept.items():
        chosen = table.select("a", "b", "true").distinct()
        part = chosen.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("true")).alias("survivors"))
        part = part.select(F.lit(name).alias("strategy"), "pairs", "survivors")
        out = part if out is None else out.unionByName(part)
    return out


def blocking_stats(nodes: DataFrame, limit: int = val.BLOCK_LIMIT) -> DataFrame:
    """Per key type: blocks, largest block and comparisons before and after the split of large blocks."""
    kind = F.substring("block", 1, 1)

    def stats(sizes: DataFrame, prefix: str) -> DataFrame:
        return sizes.groupBy(kind.alias("key_type")).agg(
            F.count(F.lit(1)).alias(f"{prefix}_blocks"), F.max("size").alias(f"{prefix}_largest"),
            F.sum(pairs_of(F.col("size"))).alias(f"{prefix}_pairs"),
        )

    whole = val.block_sizes(nodes)
    final = val.split_blocks(nodes, limit).groupBy("block").agg(F.sum("spellings").alias("size"))
    return stats(whole, "whole").join(stats(final, "split"), "key_type")


def random_pairs(nodes: DataFrame, algorithm: str = "qgrams", sample: int = 200, shifts: int = 40, threshold: float = 85) -> DataFrame:
    """Similarity of random pairs: a hash sample of values, each compared with the next ``shifts`` of the sample."""
    chosen = nodes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(sample)  # bounded: the sample
    numbered = chosen.select("v", (F.row_number().over(Window.orderBy("h", "v")) - 1).alias("i"))
    size = chosen.agg(F.count(F.lit(1)))
    steps = F.sequence(F.lit(1), F.least(F.lit(shifts), F.greatest(F.col("size") - 1, F.lit(1)).cast("int")))
    left = numbered.withColumn("size", size.scalar()).select("v", F.explode(steps).alias("s"), "i", "size")
    left = left.select(F.col("v").alias("a"), ((F.col("i") + F.col("s")) % F.col("size")).cast("int").alias("i"))
    pairs = left.join(numbered.withColumnRenamed("v", "b"), "i").where(F.col("a") != F.col("b"))
    scored = pairs.select(pl.score_of(algorithm, F.col("a"), F.col("b")).alias("s"))
    return scored.agg(
        F.count(F.lit(1)).alias("checked"), F.round(F.max("s"), 4).alias("highest"), F.count_if(F.col("s") > threshold).alias("over_threshold")
    )


def lost_pairs(stream: DataFrame, cap: int) -> DataFrame:
    """Similarity of true pairs kept and lost by a cap: extremes, median and a 0.1-wide histogram per measure."""
    kept = pl.best_of(stream, cap).select("a", "b", F.lit(True).alias("kept"))
    rows = trigram_jaccard(stream.where(F.col("true"))).join(kept, ["a", "b"], "left").select(
        F.coalesce("kept", F.lit(False)).alias("kept"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in ("jaccard", "containment")])).alias("m"),
    ).select("kept", "m.*")
    spread = rows.groupBy("kept", "measure").agg(
        F.round(F.min("x"), 4).alias("lowest"), F.round(F.median("x"), 4).alias("median"), F.round(F.max("x"), 4).alias("highest")
    )
    bins = rows.groupBy("kept", "measure", F.least(F.floor(F.col("x") * 10 + 1e-9), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(spread), ["kept", "measure"])  # at most four rows


def fingerprint(groups: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row that says whether two runs agree: sums over the rows of ``groups`` as a multiset, and a digest of ``meta``.

    Of the md5 of every row as text the first and the next 15 hex digits are added up, so neither the order of rows nor
    of partitions matters, and a row that occurs twice counts twice. ``meta`` has one row (score and counters); without it only the rows are compared.
    """
    def text(df: DataFrame) -> Column:
        return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("null")) for n in sorted(df.columns)]))

    def part(start: int) -> Column:
        return F.coalesce(F.sum(F.conv(F.substring("h", start, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")

    rows = groups.select(text(groups).alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), part(1).alias("rows_a"), part(16).alias("rows_b"))
    return rows.withColumn("meta", F.lit(None).cast("string") if meta is None else meta.select(text(meta)).scalar())
