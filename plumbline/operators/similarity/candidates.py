"""Lossless candidate pairs: an equality join on rare signatures instead of all pairs of a block.

For every algorithm and threshold there is a small set of tokens of which a similar pair must share at least
one. Values are joined on those tokens, rarest first, so common tokens are only used by values that have
nothing else. What is left out can be shown to stay below the threshold; nothing is capped or sampled.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import chunks, kernels, letters
from plumbline.functions.text import bind, clean_tokens, grams, padded_trigrams, word_soundex, words
from plumbline.session import checkpointed

UNSHARED_IDF = 1.4054651081081644  # fixed value: 1 + ln(3/2), weight of a term in one of two texts
EPS = 1e-9
TILE = 1024  # values of a block that are compared pair by pair; values on each side of a square of letter counts
EDIT_TILE = 4096  # the same for edits, counted in strips
WIDE_TILE = 98_304  # values on each side of a tile in which pairs are sought by pieces or letters
SMALL_TILE = 2048  # fewer are not dealt to more tasks
SHARED_KEYS = 3  # rare keys a pair must share where that many can be shown to survive
COMMON = 20_000  # most frequent tokens that are put in order of frequency; rarer ones precede them by text


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def settled(values: DataFrame) -> DataFrame:
    """Hash-partitioned by value. The exchange also keeps costly token arrays from being computed once per use.

    One partition more than elsewhere: Spark drops an exchange that repeats the one of an aggregate by value below it,
    and would compute the tokens in the few tasks that the aggregate is coalesced to.
    """
    return values.repartition(partitions(values) + 1, "v")


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the data. Spark takes an exploded table to be as small as before the explode and
    would broadcast it through the driver."""
    return df.hint("merge")


def common(long: DataFrame) -> DataFrame:
    """(t, df): how many rows of ``long`` have each of the most frequent tokens. Small at any size, so it is broadcast."""
    counts = long.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    return F.broadcast(counts.orderBy(F.desc("df"), "t").limit(COMMON))


def ranked(values: DataFrame, tokens: Column) -> DataFrame:
    """(v, tokens): the distinct tokens of every value, rarest first (see COMMON; any one order of all tokens is lossless)."""
    sets = settled(values.select("v", tokens.alias("tokens"))).select("v", F.explode("tokens").alias("t"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t")))
    return sets.join(common(sets), "t", "left").groupBy("v").agg(F.transform(order, lambda x: x["t"]).alias("tokens"))


def _ceil(c: Column) -> Column:
    return F.ceil(c - EPS).cast("int")


def _floor(c: Column) -> Column:
    return F.floor(c + EPS).cast("int")


def joined(probe: DataFrame, index: DataFrame, keep: Column | None = None, once: bool = False) -> DataFrame:
    """Distinct (a, b), a < b, of values that share a key. Inputs: (v, keys, ...) tables; ``keep`` sees p and i columns
    and the key. ``once``: it keeps a pair under one key only, so pairs are not shuffled to make them distinct.
    """
    p = probe.select(F.struct(*[c for c in probe.columns if c != "keys"]).alias("p"), F.explode("keys").alias("key"))
    i = index.select(F.struct(*[c for c in index.columns if c != "keys"]).alias("i"), F.explode("keys").alias("key"))
    pairs = p.join(shuffled(i), "key").where(F.col("p.v") != F.col("i.v"))
    if keep is not None:
        pairs = pairs.where(keep)
    pairs = pairs.select(F.least("p.v", "i.v").alias("a"), F.greatest("p.v", "i.v").alias("b"))
    return pairs if once else spread(pairs)


def joined_counting(probe: DataFrame, index: DataFrame, keep: Column) -> DataFrame:
    """Distinct (a, b) where a probe (v, keys, need, ...) shares at least ``need`` keys with an index value."""
    p = probe.select(F.struct(*[c for c in probe.columns if c != "keys"]).alias("p"), F.explode("keys").alias("key"))
    i = index.select(F.struct(*[c for c in index.columns if c != "keys"]).alias("i"), F.explode("keys").alias("key"))
    met = p.join(shuffled(i), "key").where((F.col("p.v") != F.col("i.v")) & keep)
    counted = met.groupBy(F.col("p.v").alias("x"), F.col("i.v").alias("y"), F.col("p.need").alias("need")).agg(F.count(F.lit(1)).alias("n"))
    enough = counted.where(F.col("n") >= F.col("need"))
    return spread(enough.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def spread(pairs: DataFrame) -> DataFrame:
    """Distinct pairs over all shuffle partitions: pairs are small but costly to score, so they are not coalesced."""
    return pairs.repartition(partitions(pairs), "a", "b").dropDuplicates(["a", "b"])


def reaching(pairs: DataFrame, threshold: float, **measures: Column) -> DataFrame:
    """Pairs with their measures, kept where the first one reaches the threshold; each measure is computed once."""
    first = next(iter(measures))
    row = F.struct("a", "b", *[m.alias(n) for n, m in measures.items()])
    return pairs.select(F.inline(F.filter(F.array(row), lambda x: x[first] >= threshold)))


def parity(tokens: Column) -> Column:
    """128 bits, each set if an odd number of tokens fall on it: two sets differ in as many tokens as bits, or more."""
    def half(low: int) -> Column:
        def flip(acc: Column, at: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at - low)
            return acc.bitwiseXOR(F.when((at >= low) & (at < low + 64), bit).otherwise(F.lit(0).cast("bigint")))

        return bind(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(128)).cast("int")), lambda at: F.aggregate(at, F.lit(0).cast("bigint"), flip))

    return F.struct(half(0).alias("low"), half(64).alias("high"))


def differing(x: str, y: str) -> Column:
    """Bits in which two parities differ."""
    return sum(F.bit_count(F.col(f"{x}.{h}").bitwiseXOR(F.col(f"{y}.{h}"))) for h in ("low", "high"))


def set_pairs(sets: DataFrame, threshold: float, measure: str = "larger") -> DataFrame:
    """Pairs whose overlap may reach ``threshold`` of the larger set, or of the union (``jaccard``).

    Two shared tokens are required, so values meet on couples of rare tokens; a single token is a key only where one
    shared token can be enough. Of a jaccard pair the smaller set shares 2 t / (1 + t) of its tokens, the larger one t.
    Pairs whose parities differ in more bits than such sets in tokens never leave the join. Under ``larger`` sets are of
    words, so they are short: they travel as hashes, and only pairs with enough of them leave, each under one key.
    """
    whole = measure == "larger"
    size = F.size("tokens")
    small = 2 * threshold / (1 + threshold) if measure == "jaccard" else threshold
    both = F.col("p.size") + F.col("i.size")
    overlap = both * (threshold / (1 + threshold)) if measure == "jaccard" else F.greatest("p.size", "i.size") * threshold
    near = F.least("p.size", "i.size") >= F.greatest("p.size", "i.size") * threshold - EPS

    hashed = sets.select("v", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"), parity(F.col("tokens")).alias("bits"))

    def keyed(share: float) -> DataFrame:
        required = F.greatest(_ceil(size * share), F.lit(1))
        prefix = F.slice("tokens", 1, F.greatest(size - F.greatest(required, F.lit(2)) + 2, F.lit(0)))
        # the larger set can do with one token where its own share is one
        single = F.when(_ceil(size * threshold) <= 1, F.col("tokens")).otherwise(F.array().cast("array<bigint>"))
        more = [F.col("tokens").alias("hashes"), F.size(prefix).alias("first")] if whole else []
        return hashed.select("v", size.alias("size"), "bits", *more, F.concat(_couples(prefix), single).alias("keys"))

    first = (F.col("p.size") < F.col("i.size")) | ((F.col("p.size") == F.col("i.size")) & (F.col("p.v") < F.col("i.v")))
    alike = differing("p.bits", "i.bits") <= both - 2 * overlap + EPS
    keep = first & near & alike
    if whole:
        met = F.array_sort(F.array_intersect(*[F.slice(f"{k}.hashes", F.lit(1), F.col(f"{k}.first")) for k in "pi"]))
        earliest = bind(met, lambda m: F.when(F.size(m) > 1, F.xxhash64(F.get(m, F.lit(0)), F.get(m, F.lit(1)))).otherwise(F.get(m, F.lit(0))))
        keep &= (F.size(F.array_intersect("p.hashes", "i.hashes")) >= overlap - EPS) & (F.col("key") == earliest)
    return joined(keyed(small), keyed(threshold), keep, whole)


def containment_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose overlap may reach ``threshold`` of the smaller set. Those whose parities differ in more bits than such
    sets in tokens never leave the join."""
    size = F.size("tokens")
    required = F.greatest(_ceil(size * threshold), F.lit(1))
    need = F.least(required, F.lit(SHARED_KEYS))
    both = sets.select("v", "tokens", size.alias("size"), parity(F.col("tokens")).alias("bits"))
    probe = both.select(
        "v", "size", "bits", need.alias("need"), required.alias("required"), F.slice("tokens", 1, F.greatest(size - required + need, F.lit(0))).alias("keys")
    )
    index = both.select("v", "size", "bits", F.col("tokens").alias("keys"))
    first = (F.col("p.size") < F.col("i.size")) | ((F.col("p.size") == F.col("i.size")) & (F.col("p.v") < F.col("i.v")))
    alike = differing("p.bits", "i.bits") <= F.col("p.size") + F.col("i.size") - 2 * F.col("p.required")
    return joined_counting(probe, index, first & alike)


def contained_in_blocks(sets: DataFrame, threshold: float) -> DataFrame:
    """(block, a, b, containment) of the pairs of a block (block, v, trigram tokens) that reach ``threshold``, above 0."""
    size = F.size("tokens")
    required = F.greatest(_ceil(size * threshold), F.lit(1))
    probe = sets.select("block", F.col("v").alias("x"), size.alias("m"), F.explode(F.slice("tokens", F.lit(1), size - required + 1)).alias("t"))
    index = sets.select("block", F.col("v").alias("y"), size.alias("n"), F.explode("tokens").alias("t"))
    met = probe.join(shuffled(index), ["block", "t"]).where((F.col("x") != F.col("y")) & (F.col("m") <= F.col("n")))
    pairs = met.select("block", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("containment", containment(padded_trigrams(F.col("a")), padded_trigrams(F.col("b")))).where(F.col("containment") >= threshold)


def jaccard(a: Column, b: Column) -> Column:
    return bind(
        F.struct(F.size(F.array_intersect(a, b)).alias("both"), (F.size(a) + F.size(b)).alias("sizes")),
        lambda s: F.when(s["sizes"] > 0, s["both"] / (s["sizes"] - s["both"])).otherwise(0.0),
    )


def containment(a: Column, b: Column) -> Column:
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def qgram_set(v: Column) -> Column:
    return grams(F.array_join(clean_tokens(v), " "), 3)


def soundex_set(v: Column) -> Column:
    return F.array_distinct(F.transform(words(v), word_soundex))


def cosine_terms(v: Column) -> Column:
    """Words of two or more characters, with repeats."""
    return F.regexp_extract_all(v, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def _term_counts(terms: Column) -> Column:
    return bind(
        terms,
        lambda every: F.map_from_entries(
            F.transform(
                F.array_distinct(every),
                lambda t: F.struct(t, F.size(F.filter(every, lambda x: x == t)).cast("double")),
            )
        ),
    )


def cosine_score(a: Column, b: Column) -> Column:
    """TF-IDF cosine fitted on the two texts alone: shared terms weigh 1, others 1 + ln 1.5."""
    counts = F.struct(_term_counts(cosine_terms(a)).alias("a"), _term_counts(cosine_terms(b)).alias("b"))

    def with_shared(c: Column) -> Column:
        shared = F.array_intersect(F.map_keys(c["a"]), F.map_keys(c["b"]))
        return bind(shared, lambda s: _cosine(c["a"], c["b"], s))

    return bind(counts, with_shared)


def _cosine(ta: Column, tb: Column, shared: Column) -> Column:
    def total(items: Column, f) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, t: acc + f(t))

    def norm(tf: Column) -> Column:
        c2 = UNSHARED_IDF**2
        everything = total(F.map_values(tf), lambda x: x * x) * c2
        return F.sqrt(everything - total(shared, lambda t: tf[t] * tf[t]) * (c2 - 1))

    dot = total(shared, lambda t: ta[t] * tb[t])
    return F.when(F.size(shared) > 0, F.least(dot / (norm(ta) * norm(tb)), F.lit(1.0)) * 100).otherwise(0.0)


def cosine_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """The squared weight of unshared terms is bounded, so the shared terms begin among the rarest ones.

    Values meet on the two rarest terms they share, or on one that is enough alone. Terms before these are unshared, which
    bounds the cosine from either side, and the bounds multiply: one of both is the threshold or more, so values whose keys
    are all common meet only those for which these are rare.
    """
    lost = (1 - threshold**2) / (1 - threshold**2 + UNSHARED_IDF**2 * threshold**2)
    counts = values.select("v", F.explode(F.map_entries(_term_counts(cosine_terms(F.col("v"))))).alias("e")).select(
        "v", F.col("e.key").alias("t"), (F.col("e.value") * F.col("e.value")).alias("mass")
    )
    rarity = counts.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    terms = counts.join(shuffled(rarity), "t").groupBy("v").agg(
        F.array_sort(F.collect_list(F.struct("df", "t", "mass"))).alias("terms"), F.sum("mass").alias("total")
    )
    total, most = F.col("total"), F.col("total") * lost + EPS

    def before(i: Column) -> Column:
        return F.aggregate(F.slice("terms", 1, i), F.lit(0.0), lambda acc, x: acc + x["mass"])

    def key(value: Column, unshared: Column) -> Column:
        bound = (total - unshared) / (total - unshared + UNSHARED_IDF**2 * unshared)
        return F.struct(value.alias("key"), bound.alias("bound"))

    def keys(marked: Column) -> Column:
        rarest = F.filter(marked, lambda x: x["before"] <= most)
        couples = F.transform(rarest, lambda x, i: F.transform(
            F.filter(F.slice(marked, i + 2, F.size(marked)), lambda y: y["before"] - x["mass"] <= most),
            lambda y: key(F.xxhash64(x["t"], y["t"]), y["before"] - x["mass"]),
        ))
        alone = F.filter(marked, lambda x: total - x["mass"] <= most)
        return F.concat(F.flatten(couples), F.transform(alone, lambda x: key(F.xxhash64(x["t"]), total - x["mass"])))

    marked = F.transform("terms", lambda x, i: F.struct(x["t"].alias("t"), x["mass"].alias("mass"), before(i).alias("before")))
    keyed = terms.select("v", F.explode(bind(marked, keys)).alias("k")).select(F.struct("v", "k.bound").alias("p"), F.col("k.key").alias("key"))
    probe, index = keyed.where(F.col("p.bound") >= threshold - EPS), keyed.select(F.col("p").alias("i"), "key")
    pairs = probe.join(shuffled(index), "key").where((F.col("p.v") != F.col("i.v")) & (F.col("p.bound") * F.col("i.bound") >= threshold**2 - EPS))
    return spread(pairs.select(F.least("p.v", "i.v").alias("a"), F.greatest("p.v", "i.v").alias("b")))


def edit_pairs(values: DataFrame, threshold: float, algorithm: str, compared: int | None = None) -> DataFrame:
    """Alignments and edit distance: edits spoil few pieces of the shorter text, so near texts have one of its rare pieces.

    How many are spoiled follows from the threshold (``chunks.Rule``). Pieces are sought in tiles, and only pairs that reach
    the threshold leave the stage. Long texts, and texts without enough rare pieces, are compared by shared letters and pairs
    of letters (``kernels.edits_allow``). ``compared``: the first characters that the affine gap reads, all by default.
    """
    ratio = {"levenshtein": threshold, "affine_gap": kernels.AFFINE_RATIO}.get(algorithm, 0.0)
    rule, cut = chunks.Rule(algorithm, threshold), compared if algorithm == "affine_gap" else None
    score = {
        "smith_waterman": kernels.smith_waterman_batch,
        "affine_gap": lambda x, y: kernels.affine_gap_batch(x, y, compared),
    }.get(algorithm)

    def allowed(left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        for at, own in _squares(left, EDIT_TILE):
            for other, theirs in _squares(right, EDIT_TILE):
                for start, near_ in kernels.edits_allow(list(own), list(theirs), threshold, algorithm, compared):
                    i, j = np.nonzero(near_)
                    found.append((at + start + i, other + j))
        return found

    def near(left: np.ndarray, right: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
        short = [np.flatnonzero([len(t[:cut]) <= chunks.LONGEST for t in side]) for side in (left, right)]
        x, y = (chunks.Side([t[:cut] for t in side[own]]) for side, own in zip((left, right), short))

        def later(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (y.lengths[j] > x.lengths[i]) | ((y.lengths[j] == x.lengths[i]) & ((j > i) | (not diagonal)))

        i, j, crowded = chunks.meeting(rule, x, y, later)
        found = [(short[0][i], short[1][j])]
        apart = [np.setdiff1d(np.arange(len(side)), own) for side, own in zip((left, right), short)]
        apart[0] = np.union1d(apart[0], short[0][crowded])
        if not diagonal:
            j, i, crowded = chunks.meeting(rule, y, x, lambda j, i: x.lengths[i] > y.lengths[j])
            found.append((short[0][i], short[1][j]))
            apart[1] = np.union1d(apart[1], short[1][crowded])
            found += [(i, apart[1][j]) for i, j in allowed(left, right[apart[1]])]
        found += [(apart[0][i], j) for i, j in allowed(left[apart[0]], right)]
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        if diagonal:
            i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        pair = np.unique(i * len(right) + j)
        i, j = pair // len(right), pair % len(right)
        if score is not None:
            reach = kernels.in_parts(score, list(left[i]), list(right[j])) >= threshold - EPS
            i, j = i[reach], j[reach]
        return left[i], right[j]

    pairs = in_tiles(*by_length(checkpointed(values.select("v")), ratio), near)
    if algorithm == "levenshtein":  # Spark's own distance, before the pairs travel
        longer = F.greatest(F.char_length("a"), F.char_length("b"))
        pairs = pairs.where(F.levenshtein("a", "b") <= longer * (1 - threshold) + EPS)
    return spread(pairs)


def _squares(side: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    return [(at, side[at : at + size]) for at in range(0, len(side), size)]


def jaro_floors(threshold: float, winkler: bool) -> list[float]:
    """Smallest Jaro similarities from which the score can reach ``threshold``, for 0 to 4 first letters alike."""
    if not winkler or threshold <= 0.7:
        return [threshold]
    return [max(0.7, (threshold - 0.1 * n) / (1 - 0.1 * n)) for n in range(5)]


def _couples(tokens: Column) -> Column:
    """Hashes of all unordered token couples of a short array."""
    return bind(
        F.array_sort(tokens),
        lambda ordered: F.flatten(
            F.transform(
                ordered,
                lambda x, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda y: F.xxhash64(x, y)),
            )
        ),
    )


def by_length(values: DataFrame, ratio: float):
    """(values (v, band), meets) for ``in_tiles``: bands of lengths of which only neighbours can have that ratio.

    A ratio of 0 bounds no lengths: there is one band then.
    """
    ratio = min(ratio, 0.9)
    width = -0.5 * math.log(ratio) + 1e-6 if ratio > 0 else 0.0
    band = F.floor(F.log(F.greatest(F.char_length("v"), F.lit(1))) / width).cast("int") if width else F.lit(0)
    return values.select("v", band.alias("band")), lambda x, y: abs(x["band"] - y["band"]) <= 2


def tile_size(df: DataFrame, n: int) -> int:
    """Values on each side of a tile, of ``n`` in all: a task has some tiles, none of them too large."""
    groups = math.ceil(math.sqrt(6 * df.sparkSession.sparkContext.defaultParallelism))
    return min(WIDE_TILE, max(SMALL_TILE, -(-n // groups)))


def in_tiles(banded: DataFrame, meets, near) -> DataFrame:
    """(a, b), a < b, of the pairs that ``near`` finds among values (v, band) of the bands that meet.

    Values are dealt to groups of their band and compared group by group: ``near(left, right, diagonal)`` returns the two
    sides of its pairs; ``diagonal``: of a group with itself, where each pair is to be found once. ``meets(x, y)`` of two
    rows (band, n, least and greatest of the other columns): whether they can hold a pair. A value travels to all groups that
    meet its own, so this grows with the square of the values, by a small factor.
    """
    columns = [c for c in banded.columns if c not in ("v", "band")]
    bounds = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))]
    sizes = sorted((r.asDict() for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *bounds).collect()), key=lambda r: r["band"])
    spark, tile = banded.sparkSession, tile_size(banded, sum(r["n"] for r in sizes))  # a row per band, of which there are few
    parts = [-(-r["n"] // tile) for r in sizes]
    first = list(itertools.accumulate(parts, initial=0))
    groups = [k for k, n in enumerate(parts) for _ in range(n)]  # their bands
    met = {(k, l): meets(sizes[k], sizes[l]) for k in range(len(parts)) for l in range(k, len(parts))}
    tiles = [(g, h) for g in range(len(groups)) for h in range(g, len(groups)) if met[groups[g], groups[h]]]
    of: list[list[int]] = [[] for _ in groups]
    for n, (g, h) in enumerate(tiles):
        of[g].append(n)
        if h != g:
            of[h].append(n)
    bands = spark.createDataFrame([(r["band"], f, n) for r, f, n in zip(sizes, first, parts)], "band int, first int, parts int")
    tiles_of = spark.createDataFrame(list(enumerate(of)), "own int, tiles array<int>")
    dealt = banded.select("v", "band").join(F.broadcast(bands), "band")
    dealt = dealt.select("v", (F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("own"))
    sent = dealt.join(F.broadcast(tiles_of), "own").select("v", "own", F.explode("tiles").alias("tile"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g, h = tiles[key[0]]
        left = rows.v[rows.own == g].to_numpy()
        right = left if g == h else rows.v[rows.own == h].to_numpy()
        x, y = near(left, right, g == h) if len(left) and len(right) else (left[:0], left[:0])
        swap = x > y
        return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)})

    # A tile is a few megabytes and seconds of work, so the tasks are not coalesced.
    return sent.repartition(min(max(2 * len(tiles), 1), 4096), "tile").groupBy("tile").applyInPandas(compare, "a string, b string")


def by_letters(values: DataFrame, floors: list[float]):
    """(values, meets) for ``in_tiles``: bands by length and letters, in order; those with too different letters don't meet."""
    length = F.char_length("v")
    held = [length - F.char_length(F.translate("v", g, "")) for g in letters.GROUPS[:2]]
    counted = values.select("v", length.alias("size"), held[0].alias("x"), held[1].alias("y")).withColumn("z", F.expr("size - x - y"))
    key = F.col("size").cast("bigint") * 2**40 + F.col("x") * 2**20 + F.col("y")
    n = values.count()
    groups = min(-(-n // tile_size(values, n)), 1000)
    places = [k / groups for k in range(1, groups)] or [1.0]
    cuts = sorted(set(counted.agg(F.percentile_approx(key, places, 10_000)).first()[0] or []))
    band = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < key)) if cuts else F.lit(0)
    limit = letters.lacking(floors[min(1, len(floors) - 1)])

    def meets(a: dict, b: dict) -> bool:
        if max(a["most_size"], b["most_size"]) > letters.LONGEST:
            return True
        allowed = limit[a["least_size"] : a["most_size"] + 1, b["least_size"] : b["most_size"] + 1].max()
        return sum(max(a[f"least_{c}"] - b[f"most_{c}"], b[f"least_{c}"] - a[f"most_{c}"], 0) for c in "xyz") <= allowed

    return counted.select("v", band.alias("band"), "size", "x", "y", "z"), meets


def by_beginning(values: DataFrame):
    """(values, meets) for ``in_tiles``: bands of values with the same first two letters."""
    n = values.count()
    bands = max(-(-n // tile_size(values, n)), min(2 * values.sparkSession.sparkContext.defaultParallelism, -(-n // SMALL_TILE)), 1)
    band = F.pmod(F.xxhash64(F.substring("v", 1, 2)), F.lit(bands)).cast("int")
    return values.select("v", band.alias("band")), lambda x, y: x["band"] == y["band"]


def letter_tiles(values: DataFrame, floors: list[float]) -> DataFrame:
    """Pairs whose Jaro similarity reaches the floor for the first letters they have alike (``jaro_floors``).

    Names use few letters, so no letter is rare enough to join on: letters are compared tile by tile (``letters.similar``),
    those of values that begin with the same two letters apart, by a lower floor. Pairs that may have enough in common are
    matched, those that reach the floor leave the tile. Long values, or more different letters than are told apart, are
    compared by matrices of letter counts.
    """

    def squares(left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        for at, own in _squares(left, TILE):
            for other, theirs in _squares(right, TILE):
                i, j = np.nonzero(kernels.letters_allow(list(own), list(theirs), floors[-1] - EPS))
                x, y = own[i], theirs[j]
                a, b = np.where(x > y, y, x), np.where(x > y, x, y)
                reach = kernels.in_parts(lambda a, b: kernels.jaro_batch(a, b, winkler=False), list(a), list(b)) >= floors[-1] - EPS
                found.append((at + i[reach], other + j[reach]))
        return found

    def near(beginning: bool):
        def found_in(left: np.ndarray, right: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
            long = [np.flatnonzero([len(t) > letters.LONGEST for t in side]) for side in (left, right)]
            short = [np.flatnonzero([len(t) <= letters.LONGEST for t in side]) for side in (left, right)]
            texts = letters.Texts([*left[short[0]], *([] if diagonal else right[short[1]])])
            if texts.exact:
                half = 0 if diagonal else len(short[0])
                i, j = letters.similar(texts, half, floors, beginning) if diagonal or (half and len(short[1])) else (np.zeros(0, np.int64),) * 2
                found = [(short[0][i], short[1][j - half])]
            else:
                found = [(short[0][i], short[1][j]) for i, j in squares(left[short[0]], right[short[1]])]
            found += [(long[0][i], j) for i, j in squares(left[long[0]], right)]
            found += [(i, long[1][j]) for i, j in squares(left, right[long[1]])]
            i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            if diagonal:
                i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
            pair = np.unique(i * len(right) + j)
            return left[pair // len(right)], right[pair % len(right)]

        return found_in

    values = checkpointed(values.select("v"))
    pairs = in_tiles(*by_letters(values, floors), near(False))
    if len(floors) > 1:
        pairs = pairs.unionByName(in_tiles(*by_beginning(values), near(True)))
    return spread(pairs)


def sharing_block(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The pairs whose values have one of their ``blocks`` (v, blocks) in common."""
    left = blocks.select(F.col("v").alias("a"), F.col("blocks").alias("ka"))
    right = blocks.select(F.col("v").alias("b"), F.col("blocks").alias("kb"))
    return pairs.join(shuffled(left), "a").join(shuffled(right), "b").where(F.arrays_overlap("ka", "kb")).select("a", "b")


def jaro_pairs(values: DataFrame, threshold: float, winkler: bool, blocks: DataFrame | None = None) -> DataFrame:
    """Pairs that can reach the threshold, of a common block when ``blocks`` (v, blocks) is given."""
    pairs = letter_tiles(values, jaro_floors(threshold, winkler))
    return pairs if blocks is None else sharing_block(pairs, blocks)


def monge_elkan_pairs(values: DataFrame, threshold: float, near: float = 0.79) -> DataFrame:
    """A value's rarest words must have a near word in the other value; near words come from the vocabulary.

    At 0.8 half of the words could go without one at a threshold of 90, so a common word would have to be joined on; a little
    below it is less than half.
    """
    near = min(near, threshold - 0.05) if threshold > 0.1 else threshold / 2
    tokens = settled(values.select("v", clean_tokens(F.col("v")).alias("tokens"))).where(F.size("tokens") > 0)
    long = tokens.select("v", F.size("tokens").alias("n"), F.explode(F.array_distinct("tokens")).alias("t"))
    vocabulary = long.select(F.col("t").alias("v")).distinct()
    possible = jaro_pairs(settled(vocabulary), near, winkler=True)
    # Used three times below and costly: computed once, in the shared checkpoint folder.
    close = checkpointed(
        reaching(possible, near * 100 - 1e-6, s=kernels.jaro_winkler(F.col("a"), F.col("b"))).select("a", "b")
    )
    neighbours = (
        close.select(F.col("a").alias("t"), F.col("b").alias("w"))
        .unionByName(close.select(F.col("b").alias("t"), F.col("a").alias("w")))
        .unionByName(vocabulary.select(F.col("v").alias("t"), F.col("v").alias("w")))
    )
    used = long.groupBy(F.col("t").alias("w")).agg(F.count(F.lit(1)).alias("df"))
    reach = neighbours.join(shuffled(used), "w").groupBy("t").agg(F.sum("df").alias("reach"))
    order = F.array_sort(F.collect_list(F.struct("reach", "t")))
    below = _floor(F.max("n") * ((1 - threshold) / (1 - near)))
    probes = long.join(shuffled(reach), "t").groupBy("v").agg(F.slice(order, 1, below + 1).alias("rare"))
    probe = probes.select("v", F.explode("rare.t").alias("t")).join(shuffled(neighbours), "t").select("v", F.col("w").alias("key")).distinct()
    pairs = probe.join(shuffled(long.select(F.col("v").alias("other"), F.col("t").alias("key"))), "key").where(F.col("v") != F.col("other"))
    return spread(pairs.select(F.least("v", "other").alias("a"), F.greatest("v", "other").alias("b")))


def trigram_sets(values: DataFrame) -> DataFrame:
    return ranked(values, padded_trigrams(F.col("v")))


def trigram_pairs(values: DataFrame, threshold: float, measure: str = "jaccard") -> DataFrame:
    """(a, b, jaccard, containment) of all pairs whose padded-trigram ``measure`` reaches the threshold."""
    sets = trigram_sets(values)
    pairs = set_pairs(sets, threshold, measure) if measure == "jaccard" else containment_pairs(sets, threshold)
    ta, tb = padded_trigrams(F.col("a")), padded_trigrams(F.col("b"))
    both = {"jaccard": jaccard(ta, tb), "containment": containment(ta, tb)}
    ordered = {measure: both[measure], **both}
    return reaching(pairs, threshold - EPS, **ordered).select("a", "b", "jaccard", "containment")
