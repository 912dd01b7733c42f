"""Value pairs above a threshold, groups of records, and the similarity score."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import kernels
from plumbline.functions.text import is_placeholder, padded_trigrams
from plumbline.operators.similarity import candidates as cand
from plumbline.operators.similarity import values as val
from plumbline.operators.similarity.components import connected_components
from plumbline.operators.uniqueness import null_count
from plumbline.session import checkpointed

ALGORITHMS = [
    "jaro_winkler", "jaro", "levenshtein", "soundex", "monge_elkan", "qgrams", "cosine", "smith_waterman", "affine_gap",
]
LENGTH_TOLERANT = {"affine_gap", "monge_elkan"}
TOLERANT_RATIO = 0.25  # fixed value: shorter/longer length required by the two tolerant algorithms
DENSITY_LIMIT = 0.6  # fixed value: groups of three or more below it are chains, not duplicates
BIG_GROUP = 10
UNRELIABLE_SHARE = 0.20
SCORE_FLOOR = 50.0
PARTIAL_CONTAINMENT = 0.65
PAIR_CAP, TOLERANT_PAIR_CAP = 15_000, 50_000  # fixed values: pairs that a capped run compares
PAIRS_PER_BLOCK = 200  # fixed value: pairs of a block that enter the capped ranking


def score_of(algorithm: str, a: Column, b: Column, compared: int | None = None) -> Column:
    """Similarity 0..100 of two different normal forms (``compared``: first characters the affine gap reads, else all)."""
    if algorithm == "levenshtein":
        return (1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b))) * 100
    if algorithm == "soundex":
        sa, sb = cand.soundex_set(a), cand.soundex_set(b)
        return F.size(F.array_intersect(sa, sb)) / F.greatest(F.size(sa), F.size(sb), F.lit(1)) * 100
    if algorithm == "qgrams":
        ga, gb = cand.qgram_set(a), cand.qgram_set(b)
        return F.when((F.size(ga) > 0) & (F.size(gb) > 0), cand.jaccard(ga, gb) * 100).otherwise(0.0)
    if algorithm == "cosine":
        return cand.cosine_score(a, b)
    kernel = {
        "jaro": kernels.jaro,
        "jaro_winkler": kernels.jaro_winkler,
        "monge_elkan": kernels.monge_elkan,
        "smith_waterman": kernels.smith_waterman,
        "affine_gap": lambda x, y: kernels.affine_gap(x, y, compared),
    }
    if algorithm not in kernel:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {ALGORITHMS}")
    return kernel[algorithm](a, b)


def candidate_pairs(values: DataFrame, algorithm: str, threshold: float, blocks: DataFrame | None = None, compared: int | None = None) -> DataFrame:
    """(a, b): every pair that can reach the threshold; with ``blocks`` only pairs that share a block."""
    t = threshold / 100
    values = cand.settled(values.select("v"))
    if algorithm in ("jaro", "jaro_winkler"):
        return cand.jaro_pairs(values, t, algorithm == "jaro_winkler", blocks)
    if algorithm == "qgrams":
        pairs = cand.set_pairs(cand.ranked(values, cand.qgram_set(F.col("v"))), t, "jaccard")
    elif algorithm == "soundex":
        pairs = cand.set_pairs(cand.ranked(values, cand.soundex_set(F.col("v"))), t)
    elif algorithm == "cosine":
        pairs = cand.cosine_pairs(values, t)
    elif algorithm == "monge_elkan":
        pairs = cand.monge_elkan_pairs(values, t)
    elif algorithm in ("levenshtein", "smith_waterman", "affine_gap"):
        pairs = cand.edit_pairs(values, t, algorithm, compared)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {ALGORITHMS}")
    if algorithm in LENGTH_TOLERANT and blocks is not None:
        shorter = F.least(F.char_length("a"), F.char_length("b"))
        pairs = pairs.where(shorter / F.greatest(F.char_length("a"), F.char_length("b")) >= TOLERANT_RATIO)
    return pairs if blocks is None else cand.sharing_block(pairs, blocks)


def scored_pairs(
    values: DataFrame, algorithm: str, threshold: float, blocks: DataFrame | None = None, compared: int | None = None
) -> DataFrame:
    """(a, b, similarity) of all different normal forms at or above the threshold."""
    pairs = candidate_pairs(values, algorithm, threshold, blocks, compared)
    return cand.reaching(pairs, threshold, similarity=score_of(algorithm, F.col("a"), F.col("b"), compared))


class NearDuplicates:
    """One near-duplicate run. Pairs and components are computed once and cut from their lineage.

    All pairs above the threshold count. ``blocking`` keeps only pairs of a common block, as a walk through blocks
    would find them; since large blocks are split, that answer depends on the other rows of the table. ``cap`` is a
    partial run: only the ``per_block`` best pairs of every block by trigram containment, and of those the ``cap`` best,
    are compared; ``report`` says what was left out, and score and reliability take it into account. ``compared`` limits
    the affine gap to the first characters (whole texts by default).
    """

    def __init__(
        self,
        df: DataFrame,
        id_col: str,
        column: str,
        algorithm: str = "jaro_winkler",
        threshold: float = 92,
        normalise: bool = True,
        blocking: bool = False,
        cap: int | None = None,
        per_block: int = PAIRS_PER_BLOCK,
        compared: int | None = None,
    ):
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {algorithm!r}; known: {ALGORITHMS}")
        self.df, self.id_col, self.column = df, id_col, column
        self.algorithm, self.threshold = algorithm, float(threshold)
        self.normalise, self.blocking = normalise, blocking
        self.cap, self.per_block, self.compared = cap, per_block, compared

    @cached_property
    def raws(self) -> DataFrame:
        return val.raw_values(self.df, self.column, self.normalise)

    @cached_property
    def nodes(self) -> DataFrame:
        return checkpointed(val.nodes(self.raws))

    @property
    def block_limit(self) -> int:
        return val.AFFINE_BLOCK_LIMIT if self.algorithm == "affine_gap" else val.BLOCK_LIMIT

    @cached_property
    def block_members(self) -> DataFrame:
        return checkpointed(val.split_blocks(self.nodes, self.block_limit).select("v", "block"))

    @cached_property
    def stream(self) -> DataFrame:
        """(a, b, containment): the best pairs of every block."""
        return pair_stream(self.nodes, self.block_members, self.per_block)

    @cached_property
    def report(self) -> DataFrame:
        """What the cap leaves out (see ``cap_report``)."""
        ratio = TOLERANT_RATIO if self.algorithm in LENGTH_TOLERANT else 0.0
        one_each = self.block_members.withColumn("spellings", F.lit(1).cast("bigint"))
        return checkpointed(cap_report(self.stream, val.visited_pairs(one_each, ratio), self.cap))

    @cached_property
    def pairs(self) -> DataFrame:
        """(a, b, similarity) between different normal forms."""
        if self.cap is not None:
            chosen = best_of(self.stream, self.cap).select("a", "b")
            return checkpointed(cand.reaching(chosen, self.threshold, similarity=score_of(self.algorithm, F.col("a"), F.col("b"), self.compared)))
        blocks = val.with_blocks(self.nodes, self.block_limit) if self.blocking else None
        return checkpointed(scored_pairs(self.nodes.select("v"), self.algorithm, self.threshold, blocks, self.compared))

    @cached_property
    def components(self) -> DataFrame:
        """(v, component) of the values that have a similar partner."""
        linked = connected_components(self.pairs.select("a", "b"))
        # Spellings of one normal form are linked to each other even without another partner.
        alone = self.nodes.where(F.col("spellings") > 1).select("v").join(cand.shuffled(linked.select("v")), "v", "left_anti")
        return checkpointed(linked.unionByName(alone.select("v", F.col("v").alias("component"))))

    @cached_property
    def best(self) -> DataFrame:
        """(v, similarity): best similarity of a value; 100 when it has several spellings."""
        both = self.pairs.select(F.col("a").alias("v"), "similarity").unionByName(
            self.pairs.select(F.col("b").alias("v"), "similarity")
        )
        spelled = self.nodes.where(F.col("spellings") > 1).select("v", F.lit(100.0).alias("similarity"))
        return both.unionByName(spelled).groupBy("v").agg(F.max("similarity").alias("similarity"))

    def link_counts(self) -> DataFrame:
        """(v, links): linked record pairs per value, from row counts alone; a pair is booked on its smaller value."""
        left = self.nodes.select(F.col("v").alias("a"), F.col("n").alias("na"))
        right = self.nodes.select(F.col("v").alias("b"), F.col("n").alias("nb"))
        across = self.pairs.join(cand.shuffled(left), "a").join(cand.shuffled(right), "b").select(
            F.col("a").alias("v"), (F.col("na") * F.col("nb")).alias("links")
        )
        within = self.nodes.where(F.col("spellings") > 1).select(
            "v", ((F.col("n") * F.col("n") - F.col("n2")) / 2).cast("bigint").alias("links")
        )
        return across.unionByName(within)

    @cached_property
    def group_stats(self) -> DataFrame:
        """(component, members, links, density, dispersed, big)."""
        sizes = self.components.join(cand.shuffled(self.nodes), "v").groupBy("component").agg(F.sum("n").alias("members"))
        links = self.link_counts().join(cand.shuffled(self.components), "v").groupBy("component").agg(F.sum("links").alias("links"))
        m = F.col("members")
        density = F.when(m < 3, 1.0).otherwise(F.col("links") / (m * (m - 1) / 2))
        return sizes.join(cand.shuffled(links), "component").select(
            "component", "members", "links", density.alias("density"),
            ((m >= 3) & (density < DENSITY_LIMIT)).alias("dispersed"), (m > BIG_GROUP).alias("big"),
        )

    def record_metrics(self) -> DataFrame:
        """One row: linked record pairs and records with any partner."""
        pairs = self.link_counts().agg(F.coalesce(F.sum("links"), F.lit(0)).alias("pairs_over_threshold"))
        records = self.components.join(cand.shuffled(self.nodes), "v").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("r"))
        return pairs.withColumn("records_with_pair", records.scalar())

    @cached_property
    def members(self) -> DataFrame:
        """Records of all groups: (record_id, value, component, similarity, rank, copies); equal rows are one with copies."""
        rows = self.df.select(
            F.col(self.id_col).alias("record_id"),
            F.col(self.column).cast("string").alias("raw"),
            F.struct(
                null_count(self.df).alias("nulls"),
                (-F.char_length(F.col(self.column).cast("string"))).alias("length"),
                F.col(self.id_col).cast("string").alias("id"),
                F.xxhash64(*[F.col(f"`{c}`") for c in self.df.columns]).alias("content"),
            ).alias("rank"),
        )
        grouped = self.raws.select("raw", "v").join(cand.shuffled(self.components), "v").join(cand.shuffled(self.best), "v")
        found = rows.join(cand.shuffled(grouped.select("raw", "component", "similarity")), "raw")
        return found.groupBy("record_id", "raw", "component", "similarity", "rank").agg(F.count(F.lit(1)).alias("copies"))

    def principals(self) -> DataFrame:
        """(component, group_id, best, keep_value, keep_id): fewest missing fields, longest value, smallest id text."""
        return self.members.groupBy("component").agg(
            F.min("record_id").cast("string").alias("group_id"),
            F.min("rank").alias("best"),
            F.min_by("raw", "rank").alias("keep_value"),
            F.min_by("record_id", "rank").alias("keep_id"),
        )

    def groups(self) -> DataFrame:
        """One row per member of every group."""
        keep = (F.col("rank") == F.col("best")) & (F.col("copy") == 1) & ~F.col("dispersed")  # of equal rows the first copy
        return (
            self.members.join(cand.shuffled(self.principals()), "component")
            .join(cand.shuffled(self.group_stats), "component")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select(
                "record_id",
                F.col("raw").alias("value"),
                "group_id",
                F.round("similarity", 1).alias("similarity_pct"),
                keep.alias("is_principal"),
                F.when(~keep & ~F.col("dispersed"), F.col("keep_value")).alias("correct_value"),
                F.col("big").alias("big_group"),
                F.col("dispersed").alias("dispersed_group"),
                "members",
                F.round("density", 4).alias("density"),
            )
        )

    def issues(self) -> DataFrame:
        reason = F.when(F.col("dispersed_group"), "dispersed group: possible chain, not in the score").when(
            F.col("is_principal"), "near-duplicate: keep this record"
        ).otherwise("near-duplicate: correct to the kept record")
        return self.groups().select(
            "record_id",
            F.lit(self.column).alias("column"),
            F.lit("similarity").alias("dimension"),
            reason.alias("reason"),
            "value", "is_principal", "correct_value", "group_id", "similarity_pct", "big_group", "dispersed_group",
        )

    @cached_property
    def counts(self) -> DataFrame:
        """One row with the counters of the run."""
        missing = is_placeholder(F.col(self.column).cast("string"))
        rows = self.df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("placeholders"))
        repeated = self.raws.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("x"))
        reliable, m = ~F.col("dispersed"), F.col("members")
        grouped = self.group_stats.agg(
            F.struct(
                F.count_if(reliable).alias("groups"),
                F.coalesce(F.sum(F.when(reliable, m)), F.lit(0)).alias("involved"),
                F.count_if(reliable & F.col("big")).alias("big_groups"),
                F.count_if("dispersed").alias("dispersed_groups"),
                F.coalesce(F.sum(F.when(F.col("dispersed"), m)), F.lit(0)).alias("dispersed_records"),
                F.count(F.lit(1)).alias("groups_formed"),
            ).alias("g")
        )
        linked = self.record_metrics().select(F.struct("pairs_over_threshold", "records_with_pair"))
        distinct = self.nodes.agg(F.coalesce(F.sum("spellings"), F.lit(0)))
        return (
            rows.withColumn("g", grouped.scalar())
            .withColumn("l", linked.scalar())
            .select(
                "n_rows", "placeholders", (F.col("n_rows") - F.col("placeholders")).alias("evaluated"),
                repeated.scalar().alias("exact_duplicates"), distinct.scalar().alias("distinct_values"),
                "g.*", (F.col("g.involved") - F.col("g.groups")).alias("surplus"), "l.*",
            )
        )

    def meta(self) -> DataFrame:
        """Counters, score and reliability. A capped run that left out promising pairs is partial: its score has a ceiling."""
        counts = self.counts
        if self.cap is None:
            counts = counts.withColumn("partial", F.lit(False)).withColumn("discarded_pct", F.lit(0.0))
        else:
            state = self.report.select(F.struct("partial", "discarded_pct"))
            counts = counts.withColumn("state", state.scalar()).select("*", "state.*").drop("state")
        e, dispersed = F.col("evaluated"), F.col("dispersed_records")
        share = F.when(e > 0, dispersed / e).otherwise(0.0)
        plain = F.when(e > 0, F.round((1 - F.col("surplus") / e) * 100, 1)).otherwise(100.0)
        ceiling = F.when(F.col("dispersed_groups") > 0, F.greatest(F.lit(SCORE_FLOOR), 100 - share * 100)).otherwise(100.0)
        cap = F.when(F.col("partial"), F.greatest(F.lit(SCORE_FLOOR), 100 - F.col("discarded_pct"))).otherwise(100.0)
        reliability = (
            F.when(F.col("partial"), "unreliable")
            .when(F.col("dispersed_groups") == 0, "reliable")
            .when(share >= UNRELIABLE_SHARE, "unreliable")
            .otherwise("partial")
        )
        return counts.select(
            "*",
            F.lit(self.algorithm).alias("algorithm"),
            F.lit(self.threshold).alias("threshold"),
            F.round(F.least(plain, ceiling, cap), 1).alias("score"),
            reliability.alias("reliability"),
        )

    def scores(self) -> DataFrame:
        return self.meta().select(
            F.lit(self.column).alias("column"),
            F.lit("similarity").alias("dimension"),
            F.col("evaluated").alias("n_total"),
            F.col("surplus").alias("n_bad"),
            "score",
        )


def near_duplicates(df: DataFrame, id_col: str, column: str, **params) -> NearDuplicates:
    return NearDuplicates(df, id_col, column, **params)


#: Containments that pairs must reach in turn, until every place of a ranking is taken.
FLOORS = (0.7, 0.3, 1e-6)


def best_pairs(values: DataFrame, n: int, measure: str = "jaccard") -> DataFrame:
    """The n most similar pairs by padded trigrams, ties by text; fewer only where there are fewer pairs.

    Exact: the floor is lowered until n pairs reach it; then pairs without a common trigram follow, by text.
    """
    for floor in FLOORS:
        found = cand.trigram_pairs(values, floor, measure).select("a", "b", measure)
        if found.limit(n).count() >= n:
            return found.orderBy(F.desc(measure), "a", "b").limit(n)
    one = values.select("v").orderBy("v").limit(2 * n + 1).select(F.lit("").alias("block"), "v")
    rest = without_trigrams(one, found.select(F.lit("").alias("block"), "a", "b"), n).select("a", "b", F.lit(0.0).alias(measure))
    return found.unionByName(rest).orderBy(F.desc(measure), "a", "b").limit(n)


def without_trigrams(members: DataFrame, sharing: DataFrame, k: int) -> DataFrame:
    """(block, a, b): k pairs of every block, first by text, that are not among ``sharing``, which has fewer than k a block.

    Of the first 2 k pairs by text at least k are not among them, and these lie among the first 2 k + 1 members.
    """
    by_text = Window.partitionBy("block").orderBy("v")
    first = members.withColumn("at", F.row_number().over(by_text)).where(F.col("at") <= 2 * k + 1)
    first = first.groupBy("block").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # at most 2 k + 1
    i, n = F.col("i"), F.size("vs")
    pairs = first.where(n > 1).select("block", "vs", F.posexplode(F.slice("vs", F.lit(1), n - 1)).alias("i", "a"))
    pairs = pairs.select("block", "a", F.explode(F.slice("vs", i + 2, F.size("vs") - i - 1)).alias("b"))
    order = Window.partitionBy("block").orderBy("a", "b")
    pairs = pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= 2 * k).drop("at")
    return pairs.join(cand.shuffled(sharing), ["block", "a", "b"], "left_anti")


def ranked_in_blocks(values: DataFrame, members: DataFrame, k: int, limit: int = cand.TILE) -> DataFrame:
    """(block, rank, a, b, containment): the k best pairs of every block (v, block) by trigram containment, ties by text.

    All pairs of a block are ranked, without a floor: a block has fewer than k only if it has fewer pairs. Blocks of up
    to ``limit`` values are compared pair by pair, many in a task, and only their best pairs leave it. Those of larger
    blocks are sought at falling floors; a block leaves once k of its pairs (or all it has) reach the floor, since no
    other can then be better. Blocks that are left have fewer pairs with a common trigram; the others follow by text.
    """
    n = F.count(F.lit(1))
    dealt = members.select("block", "v").repartition(cand.partitions(members), "block")
    small = dealt.withColumn("n", n.over(Window.partitionBy("block"))).where(F.col("n").between(2, limit)).select("block", "v")
    schema = "block string, rank int, a string, b string, containment double"
    ranked = small.sortWithinPartitions("block", "v").mapInPandas(kernels.ranked_blocks(k), schema)
    large = members.groupBy("block").agg(n.alias("n")).where(F.col("n") > limit)
    open_ = checkpointed(large.select("block", F.least(F.lit(k).cast("bigint"), (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")).alias("want")))
    return ranked if open_.isEmpty() else ranked.unionByName(ranked_at_floors(values, members, open_, k))


def ranked_at_floors(values: DataFrame, members: DataFrame, open_: DataFrame, k: int) -> DataFrame:
    """The k best pairs of the blocks ``open_`` (block, want), sought at falling floors (see ``ranked_in_blocks``)."""
    sets = checkpointed(cand.ranked(values.select("v"), padded_trigrams(F.col("v"))))
    parts = []
    order = Window.partitionBy("block").orderBy(F.desc("containment"), "a", "b")
    for floor in FLOORS:
        here = members.join(cand.shuffled(open_.select("block")), "block").join(cand.shuffled(sets), "v")
        found = cand.contained_in_blocks(here, floor)
        found = checkpointed(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        done = found.groupBy("block").agg(F.count(F.lit(1)).alias("n")).join(cand.shuffled(open_), "block").where("n >= want").select("block")
        parts.append(found.join(cand.shuffled(done), "block", "left_semi"))
        open_ = checkpointed(open_.join(cand.shuffled(done), "block", "left_anti"))
        if open_.isEmpty():
            break
    else:
        some = found.join(cand.shuffled(open_.select("block")), "block", "left_semi").drop("rank")
        rest = without_trigrams(members.join(cand.shuffled(open_.select("block")), "block"), some.select("block", "a", "b"), k)
        both = some.unionByName(rest.withColumn("containment", F.lit(0.0)))
        parts.append(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("block", "rank", "a", "b", "containment")


def pair_stream(values: DataFrame, members: DataFrame, per_block: int = PAIRS_PER_BLOCK) -> DataFrame:
    """(a, b, containment): the pairs that are among the ``per_block`` best of some block."""
    return checkpointed(ranked_in_blocks(values, members, per_block).select("a", "b", "containment").distinct())


def best_of(pairs: DataFrame, cap: int) -> DataFrame:
    return pairs.orderBy(F.desc("containment"), "a", "b").limit(cap)


def cap_report(stream: DataFrame, visited: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    """What a run that compares the ``cap`` best pairs of ``stream`` (a, b, containment) leaves out.

    ``generated`` are the comparisons of a walk through all blocks (``visited``, one row, counted from sizes),
    ``marginal_containment`` is that of the last pair compared, where the cap left out any. The run is partial if that
    pair was still a promising one.
    """
    last = best_of(stream, cap).agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("containment").alias("c")).alias("s"))
    out = stream.agg(F.count(F.lit(1)).alias("ranked")).withColumn("s", last.scalar()).withColumn("generated", visited.scalar())
    fired = F.col("ranked") > F.col("s.n")
    margin = F.when(fired, F.col("s.c")).otherwise(0.0)
    return out.select(
        "generated",
        "ranked",
        F.col("s.n").alias("evaluated"),
        F.when(F.col("generated") > 0, F.round((F.col("generated") - F.col("s.n")) / F.col("generated") * 100, 1))
        .otherwise(0.0)
        .alias("discarded_pct"),
        F.round(margin, 4).alias("marginal_containment"),
        (fired & (margin >= PARTIAL_CONTAINMENT)).alias("partial"),
    )
