"""Queries of near-duplicate detection on company-like names.

The reference SQL compares all pairs of distinct names; the Spark side never does. Queries without a block
rule check that the candidate join loses nothing; block queries rebuild the blocks in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Data, query
from plumbline.functions.text import LEGAL_SUFFIXES, NAME_STOPWORDS, clean_tokens, normalise, padded_trigrams
from plumbline.operators.similarity import candidates as cand
from plumbline.operators.similarity import pipeline as pl
from plumbline.operators.similarity import values as val
from plumbline.operators.similarity.components import connected_components

VIEW = ("companies",)
STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
NORM = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    + f"strip_accents(lower({STRIP}))"
    + r", '\.(\s)', ' \1', 'g'), '\.$', ''), '(\w)\.(\w)', '\1\2', 'g'), '(\w)\.(\w)', '\1\2', 'g'),"
    r" '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
)
PLACEHOLDER = (
    f"(name IS NULL OR lower({STRIP.format(c='name')}) IN ('', 'n/a','na','n.a.','-','--','---','sin dato','sin datos',"
    "'sin nombre','s/n','s/d','null','none','ninguno','.','0'))"
)
RAWS = f"""raws AS (SELECT name AS raw, {NORM.format(c='name')} AS v, count(*) AS n FROM companies WHERE NOT {PLACEHOLDER} GROUP BY 1, 2),
  nodes AS (SELECT v, cast(sum(n) AS bigint) AS n, cast(sum(n * n) AS bigint) AS n2, count(*) AS spellings FROM raws WHERE v <> '' GROUP BY 1)"""
IGNORED = ", ".join(f"'{t}'" for t in LEGAL_SUFFIXES + NAME_STOPWORDS)
CLEAN = f"""CASE WHEN len(list_filter(string_split_regex(v, '\\s+'), lambda t: t NOT IN ({IGNORED}) AND length(t) >= 3)) > 0
  THEN list_filter(string_split_regex(v, '\\s+'), lambda t: t NOT IN ({IGNORED}) AND length(t) >= 3) ELSE string_split_regex(v, '\\s+') END"""
TRIGRAMS = "list_distinct(list_transform(range(1, cast(length({s}) - 1 AS bigint)), lambda i: substr({s}, i, 3)))"
PADDED = TRIGRAMS.format(s="('##' || v || '##')")
# Shared n-grams are counted by joining on them; pairs without a shared one have similarity 0.
SHARED = """e AS MATERIALIZED (SELECT v, unnest(g) AS t, len(g) AS size FROM q),
  overlap AS MATERIALIZED (SELECT x.v AS a, y.v AS b, count(*) / (any_value(x.size) + any_value(y.size) - count(*)) AS jaccard,
    count(*) / least(any_value(x.size), any_value(y.size)) AS containment FROM e x JOIN e y ON x.t = y.t AND x.v < y.v GROUP BY 1, 2)"""


def names(d: Data):
    return val.nodes(val.raw_values(d.view("companies"), "name"))


@query("sim_normalize", f"SELECT id, {NORM.format(c='name')} AS normal FROM companies", VIEW)
def sim_normalize(d: Data):
    """Comparable form of every name."""
    return d.view("companies").select("id", normalise(F.col("name")).alias("normal"))


@query("sim_token_clean", f"WITH {RAWS} SELECT v, array_to_string({CLEAN}, ' ') AS cleaned FROM nodes", VIEW)
def sim_token_clean(d: Data):
    """Words without legal suffixes, stop-words and short words."""
    return names(d).select("v", F.array_join(clean_tokens(F.col("v")), " ").alias("cleaned"))


@query(
    "sim_distinct_values",
    f"""WITH {RAWS} SELECT (SELECT count(*) FROM companies WHERE {PLACEHOLDER}) AS placeholders,
    (SELECT cast(sum(n) AS bigint) FROM raws WHERE n > 1) AS exact_duplicates, (SELECT count(*) FROM raws) AS raw_values,
    (SELECT count(*) FROM nodes) AS normal_forms""",
    VIEW,
)
def sim_distinct_values(d: Data):
    """Placeholders, rows in exact duplicates, distinct raw values and normal forms."""
    companies = d.view("companies")
    raws = val.raw_values(companies, "name")
    stats = raws.agg(
        F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("exact_duplicates"), F.count(F.lit(1)).alias("raw_values")
    )
    placeholders = companies.agg(F.count_if(val.is_placeholder(F.col("name"))))
    return stats.select(
        placeholders.scalar().alias("placeholders"), "exact_duplicates", "raw_values",
        val.nodes(raws).agg(F.count(F.lit(1))).scalar().alias("normal_forms"),
    )


# Sound code in SQL: letters to digits, h and w dropped, equal neighbours collapsed, vowels dropped.
def _collapse(s: str) -> str:
    for digit in "123456":
        s = f"regexp_replace({s}, '{digit}+', '{digit}', 'g')"
    return s


_MAP = "translate({s}, 'abcdefghijklmnopqrstuvwxyz0123456789', '0123012#02245501262301#2020000000000')"
_FIRST = f"replace({_MAP.format(s='substr(t, 1, 1)')}, '#', 'x')"
_REST = f"replace({_MAP.format(s='substr(t, 2)')}, '#', '')"
SOUNDEX = (
    f"(upper(substr(t, 1, 1)) || substr(rpad(replace(substr({_collapse(f'({_FIRST} || {_REST})')}, 2), '0', ''), 3, '0'), 1, 3))"
)
BLOCKS = f"""keys AS (SELECT v, spellings, unnest(list_distinct(list_concat(
    list_filter([CASE WHEN length(v) >= 2 THEN 'p:' || substr(v, 1, 2) END, CASE WHEN length(t) >= 2 THEN 's:' || {SOUNDEX} END,
      'l:' || cast(cast(floor(length(v) / 5) * 5 AS bigint) AS string)], lambda k: k IS NOT NULL),
    list_transform(list_filter(string_split_regex(v, '\\s+'), lambda w: length(w) > 3), lambda w: 't:' || w)))) AS block
    FROM (SELECT *, list_extract(string_split_regex(v, '\\s+'), 1) AS t FROM nodes)),
  big AS (SELECT block FROM keys GROUP BY 1 HAVING sum(spellings) > 200),
  members AS (SELECT v, spellings, CASE WHEN block IN (SELECT block FROM big) THEN block || '|' || substr(v, 1, 3) ELSE block END AS block FROM keys)"""


@query("sim_blocking_keys", f"WITH {RAWS}, {BLOCKS} SELECT v, block FROM keys", VIEW)
def sim_blocking_keys(d: Data):
    """Blocks of every name."""
    return names(d).select("v", F.explode(val.blocking_keys(F.col("v"))).alias("block"))


@query("sim_block_split", f"WITH {RAWS}, {BLOCKS} SELECT v, spellings, block FROM members", VIEW)
def sim_block_split(d: Data):
    """Final blocks: large ones are split by three-letter prefix."""
    return val.split_blocks(names(d))


QGRAM_SETS = f"q AS (SELECT v, {TRIGRAMS.format(s='s')} AS g FROM (SELECT v, array_to_string({CLEAN}, ' ') AS s FROM nodes))"


def qgram_sql(threshold: float) -> str:
    return f"{SHARED}, pairs AS MATERIALIZED (SELECT a, b, jaccard * 100 AS similarity FROM overlap WHERE jaccard * 100 >= {threshold})"


@query(
    "sim_candidate_pairs",
    f"""WITH {RAWS}, {BLOCKS}, {QGRAM_SETS}, {qgram_sql(70)}
    SELECT a, b FROM pairs p WHERE EXISTS (SELECT 1 FROM members m JOIN members o USING (block) WHERE m.v = p.a AND o.v = p.b)""",
    VIEW,
)
def sim_candidate_pairs(d: Data):
    """Pairs of a common block that can reach q-gram similarity 70, from the signature join."""
    base = names(d)
    blocks = val.with_blocks(base)
    return pl.scored_pairs(base.select("v"), "qgrams", 70, blocks).select("a", "b")


@query(
    "sim_visited_pairs",
    f"WITH {RAWS}, {BLOCKS} SELECT cast(sum(m * (m - 1) / 2) AS bigint) AS visited FROM (SELECT sum(spellings) AS m FROM members GROUP BY block)",
    VIEW,
)
def sim_visited_pairs(d: Data):
    """Comparisons a walk through all blocks would make, from block sizes alone."""
    return val.visited_pairs(val.split_blocks(names(d)))


@query("sim_trigram_index", f"WITH {RAWS} SELECT v, unnest({PADDED}) AS trigram FROM nodes", VIEW)
def sim_trigram_index(d: Data):
    """Padded trigram set of every name."""
    return names(d).select("v", F.explode(padded_trigrams(F.col("v"))).alias("trigram"))


PADDED_SETS = f"q AS (SELECT v, {PADDED} AS g FROM nodes)"


@query(
    "sim_trigram_jaccard",
    f"WITH {RAWS}, {PADDED_SETS}, {SHARED} SELECT a, b, round(jaccard, 4) AS jaccard FROM overlap WHERE jaccard >= 0.5",
    VIEW,
)
def sim_trigram_jaccard(d: Data):
    """Pairs with trigram Jaccard of at least one half."""
    found = cand.trigram_pairs(names(d), 0.5, "jaccard")
    return found.select("a", "b", F.round("jaccard", 4).alias("jaccard"))


CONTAINED = f"{SHARED}, c AS MATERIALIZED (SELECT a, b, containment FROM overlap WHERE containment >= 0.65)"


@query(
    "sim_trigram_containment",
    f"WITH {RAWS}, {PADDED_SETS}, {CONTAINED} SELECT a, b, round(containment, 4) AS containment FROM c",
    VIEW,
)
def sim_trigram_containment(d: Data):
    """Pairs whose smaller trigram set is contained to 65 % in the larger one."""
    found = cand.trigram_pairs(names(d), 0.65, "containment")
    return found.select("a", "b", F.round("containment", 4).alias("containment"))


#: Every pair of every block with its trigram measures, ranked; the best of the blocks; the best of those.
RANKED = f"""pe AS MATERIALIZED (SELECT v, unnest(g) AS t, len(g) AS size FROM (SELECT v, {PADDED} AS g FROM nodes)),
  common AS MATERIALIZED (SELECT x.v AS a, y.v AS b, count(*) / (any_value(x.size) + any_value(y.size) - count(*)) AS jaccard,
    count(*) / least(any_value(x.size), any_value(y.size)) AS containment FROM pe x JOIN pe y ON x.t = y.t AND x.v < y.v GROUP BY 1, 2),
  visits AS MATERIALIZED (SELECT m.block, m.v AS a, o.v AS b, coalesce(containment, 0.0) AS containment, coalesce(jaccard, 0.0) AS jaccard
    FROM members m JOIN members o ON o.block = m.block AND m.v < o.v LEFT JOIN common c ON c.a = m.v AND c.b = o.v),
  ranks AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY containment DESC, a, b) AS rank FROM visits)"""


def stream_sql(per_block: int, cap: int) -> str:
    return f"""{RANKED}, stream AS MATERIALIZED (SELECT DISTINCT a, b, containment, jaccard FROM ranks WHERE rank <= {per_block}),
  chosen AS MATERIALIZED (SELECT a, b, containment FROM stream ORDER BY containment DESC, a, b LIMIT {cap})"""


@query("sim_topk_per_block", f"WITH {RAWS}, {BLOCKS}, {RANKED} SELECT block, rank, a, b, round(containment, 4) AS containment FROM ranks WHERE rank <= 3", VIEW)
def sim_topk_per_block(d: Data):
    """Three best pairs of every block by trigram containment, of all its pairs."""
    base = names(d)
    top = pl.ranked_in_blocks(base, val.split_blocks(base).select("v", "block"), 3)
    return top.select("block", F.col("rank").cast("bigint").alias("rank"), "a", "b", F.round("containment", 4).alias("containment"))


@query(
    "sim_topk_jaccard",
    f"WITH {RAWS}, {PADDED_SETS}, {SHARED} SELECT a, b, round(jaccard, 4) AS jaccard FROM overlap ORDER BY overlap.jaccard DESC, a, b LIMIT 50",
    VIEW,
)
def sim_topk_jaccard(d: Data):
    """Fifty best pairs by trigram Jaccard."""
    return pl.best_pairs(names(d), 50).select("a", "b", F.round("jaccard", 4).alias("jaccard"))


CAP, PER_BLOCK = 300, 20
CAP_REPORT = """report AS (SELECT (SELECT count(*) FROM visits) AS generated, (SELECT count(*) FROM stream) AS ranked, count(*) AS evaluated,
    min(containment) AS margin FROM chosen),
  capped AS (SELECT generated, ranked, evaluated, CASE WHEN generated > 0 THEN round((generated - evaluated) / generated * 100.0, 1) ELSE 0.0 END AS discarded_pct,
    CASE WHEN ranked > evaluated THEN round(margin, 4) ELSE 0.0 END AS marginal_containment, ranked > evaluated AND margin >= 0.65 AS partial FROM report)"""


@query("sim_global_cap", f"WITH {RAWS}, {BLOCKS}, {stream_sql(PER_BLOCK, CAP)}, {CAP_REPORT} SELECT * FROM capped", VIEW)
def sim_global_cap(d: Data):
    """What a run leaves out that compares only the 300 best of the 20 best pairs of every block."""
    return run_of(d, cap=CAP, per_block=PER_BLOCK).report


def join_query(algorithm: str, threshold: float, oracle: str | None = None):
    """Register all pairs of one algorithm above a threshold."""

    @query(f"sim_join_{algorithm}", oracle, VIEW if oracle else ())
    def run(d: Data):
        base = names(d)
        found = pl.scored_pairs(base.select("v"), algorithm, threshold)
        return found.select("a", "b", F.round("similarity", 4).alias("similarity"))


def plain_join(expression: str, threshold: float, extra: str = "") -> str:
    return f"""WITH {RAWS} SELECT a, b, round(s, 4) AS similarity FROM (SELECT x.v AS a, y.v AS b, {expression} AS s
      FROM nodes x JOIN nodes y ON x.v < y.v {extra}) WHERE s >= {threshold}"""


join_query("jaro", 85, plain_join("jaro_similarity(x.v, y.v) * 100", 85))
join_query("jaro_winkler", 88, plain_join("jaro_winkler_similarity(x.v, y.v) * 100", 88))
join_query(
    "levenshtein", 80,
    plain_join("(1 - levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v))) * 100", 80,
               "AND least(length(x.v), length(y.v)) >= greatest(length(x.v), length(y.v)) * 0.8"),
)
join_query("qgrams", 70, f"WITH {RAWS}, {QGRAM_SETS}, {qgram_sql(70)} SELECT a, b, round(similarity, 4) AS similarity FROM pairs")
join_query(
    "soundex", 75,
    f"""WITH {RAWS}, w AS (SELECT v, unnest(string_split_regex(v, '\\s+')) AS t FROM nodes),
    q AS (SELECT v, list(DISTINCT {SOUNDEX}) AS g FROM w GROUP BY 1)
    SELECT a, b, round(s, 4) AS similarity FROM (SELECT x.v AS a, y.v AS b, len(list_intersect(x.g, y.g)) / greatest(len(x.g), len(y.g)) * 100 AS s
    FROM q x JOIN q y ON x.v < y.v) WHERE s >= 75""",
)
join_query(
    "monge_elkan", 90,
    f"""WITH {RAWS}, q AS (SELECT v, {CLEAN} AS g FROM nodes)
    SELECT a, b, round(s, 4) AS similarity FROM (SELECT x.v AS a, y.v AS b, (
      list_avg(list_transform(x.g, lambda p: list_max(list_transform(y.g, lambda r: jaro_winkler_similarity(p, r)))))
    + list_avg(list_transform(y.g, lambda p: list_max(list_transform(x.g, lambda r: jaro_winkler_similarity(p, r)))))) / 2 * 100 AS s
    FROM q x JOIN q y ON x.v < y.v) WHERE s >= 90""",
)
join_query(
    "cosine", 60,
    f"""WITH {RAWS}, t AS (SELECT v, w, count(*) AS tf FROM (SELECT v, unnest(regexp_extract_all(v, '\\b\\w\\w+\\b')) AS w FROM nodes) GROUP BY 1, 2),
    n AS (SELECT v, sum(tf * tf) AS ss FROM t GROUP BY 1),
    p AS (SELECT x.v AS a, y.v AS b, sum(x.tf * y.tf) AS dot, sum(x.tf * x.tf) AS sa, sum(y.tf * y.tf) AS sb FROM t x JOIN t y ON x.w = y.w AND x.v < y.v GROUP BY 1, 2)
    SELECT a, b, round(s, 4) AS similarity FROM (SELECT a, b, least(dot / (sqrt(sa + pow(1 + ln(1.5), 2) * (na.ss - sa)) * sqrt(sb + pow(1 + ln(1.5), 2) * (nb.ss - sb))), 1) * 100 AS s
    FROM p JOIN n na ON na.v = a JOIN n nb ON nb.v = b) WHERE s >= 60""",
)
join_query("smith_waterman", 86)
join_query("affine_gap", 88)

RUN_SQL = f"""{RAWS}, {QGRAM_SETS}, {qgram_sql(80)}"""


def run_of(d: Data, blocking: bool = False, **params):
    options = {"algorithm": "qgrams", "threshold": 80, **params}
    return pl.NearDuplicates(d.view("companies"), "id", "name", blocking=blocking, **options)


@query(
    "sim_threshold",
    f"""WITH {RUN_SQL} SELECT a, b, round(similarity, 4) AS similarity FROM pairs
    UNION ALL SELECT m, raw, 100.0 FROM (SELECT raw, v, min(raw) OVER (PARTITION BY v) AS m FROM raws WHERE v <> '') WHERE raw <> m""",
    VIEW,
)
def sim_threshold(d: Data):
    """Pairs at or above the threshold; spellings of one normal form count as 100 (each listed with the smallest)."""
    run = run_of(d)
    raws = run.raws.where(F.col("v") != "").select("raw", "v")
    first = raws.groupBy("v").agg(F.min("raw").alias("a"))
    spelled = raws.join(cand.shuffled(first), "v").where(F.col("raw") != F.col("a"))
    spelled = spelled.select("a", F.col("raw").alias("b"), F.lit(100.0).alias("similarity"))
    return run.pairs.withColumn("similarity", F.round("similarity", 4)).unionByName(spelled)


LINKS = """record_pairs AS (SELECT p.a AS v, x.n * y.n AS links FROM pairs p JOIN nodes x ON x.v = p.a JOIN nodes y ON y.v = p.b
    UNION ALL SELECT v, cast((n * n - n2) / 2 AS bigint) FROM nodes WHERE spellings > 1),
  involved AS (SELECT a AS v FROM pairs UNION SELECT b FROM pairs UNION SELECT v FROM nodes WHERE spellings > 1)"""


@query(
    "sim_record_metrics",
    f"""WITH {RUN_SQL}, {LINKS} SELECT cast((SELECT sum(links) FROM record_pairs) AS bigint) AS pairs_over_threshold,
    cast((SELECT sum(n) FROM involved JOIN nodes USING (v)) AS bigint) AS records_with_pair""",
    VIEW,
)
def sim_record_metrics(d: Data):
    """Linked record pairs and records with a partner, without building the record pairs."""
    return run_of(d).record_metrics()


COMPONENTS = """WITH RECURSIVE """ + RUN_SQL + ", " + LINKS + """,
  edges AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  reach(v, c) AS (SELECT v, v FROM involved UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.v),
  comps AS MATERIALIZED (SELECT v, min(c) AS component FROM reach GROUP BY 1)"""


@query("sim_components", f"{COMPONENTS} SELECT v, component FROM comps", VIEW)
def sim_components(d: Data):
    """Transitive closure of the pairs, named by the smallest value."""
    return run_of(d).components


STATS = f"""{COMPONENTS}, stats AS (SELECT component, members, links, CASE WHEN members < 3 THEN 1.0 ELSE links / (members * (members - 1) / 2) END AS density
  FROM (SELECT component, cast(sum(n) AS bigint) AS members FROM comps JOIN nodes USING (v) GROUP BY 1)
  JOIN (SELECT component, cast(sum(links) AS bigint) AS links FROM comps JOIN record_pairs USING (v) GROUP BY 1) USING (component))"""


@query(
    "sim_density",
    f"""{STATS} SELECT component, members, links, round(density, 4) AS density, members >= 3 AND density < 0.6 AS dispersed, members > 10 AS big FROM stats""",
    VIEW,
)
def sim_density(d: Data):
    """Members, links and density per group."""
    return run_of(d).group_stats.withColumn("density", F.round("density", 4))


MEMBERS = f"""{STATS}, recs AS (SELECT c.id, c.name, component, CASE WHEN c.id IS NULL THEN 1 ELSE 0 END + CASE WHEN entity IS NULL THEN 1 ELSE 0 END
    + CASE WHEN brand IS NULL THEN 1 ELSE 0 END AS nulls FROM companies c JOIN raws r ON r.raw = c.name JOIN comps USING (v)),
  best AS (SELECT v, max(similarity) AS similarity FROM (SELECT a AS v, similarity FROM pairs UNION ALL SELECT b, similarity FROM pairs
    UNION ALL SELECT v, 100.0 FROM nodes WHERE spellings > 1) GROUP BY 1),
  keep AS (SELECT component, id AS keep_id, name AS keep_value FROM (SELECT *, row_number() OVER (PARTITION BY component
    ORDER BY nulls, -length(name), cast(id AS string)) AS rn FROM recs) WHERE rn = 1)"""


@query("sim_principal", f"{MEMBERS} SELECT component, keep_id, keep_value FROM keep", VIEW)
def sim_principal(d: Data):
    """Record to keep per group."""
    return run_of(d).principals().select("component", "keep_id", "keep_value")


@query(
    "sim_groups",
    f"""{MEMBERS} SELECT r.id AS record_id, r.name AS value, cast(min(r.id) OVER (PARTITION BY r.component) AS string) AS group_id,
    round(b.similarity, 1) AS similarity_pct, r.id = keep_id AND NOT (members >= 3 AND density < 0.6) AS is_principal,
    CASE WHEN r.id <> keep_id AND NOT (members >= 3 AND density < 0.6) THEN keep_value END AS correct_value, members > 10 AS big_group,
    members >= 3 AND density < 0.6 AS dispersed_group, members, round(density, 4) AS density
    FROM recs r JOIN keep USING (component) JOIN stats USING (component) JOIN raws w ON w.raw = r.name JOIN best b ON b.v = w.v""",
    VIEW,
)
def sim_groups(d: Data):
    """One row per member of every group."""
    return run_of(d).groups()


@query(
    "sim_score",
    f"""{STATS}, k AS (SELECT (SELECT count(*) FROM companies) AS n_rows, (SELECT count(*) FROM companies WHERE {PLACEHOLDER}) AS placeholders,
      count(*) AS groups_formed, count(CASE WHEN NOT (members >= 3 AND density < 0.6) THEN 1 END) AS groups,
      cast(coalesce(sum(CASE WHEN NOT (members >= 3 AND density < 0.6) THEN members END), 0) AS bigint) AS involved,
      count(CASE WHEN members >= 3 AND density < 0.6 THEN 1 END) AS dispersed_groups,
      cast(coalesce(sum(CASE WHEN members >= 3 AND density < 0.6 THEN members END), 0) AS bigint) AS dispersed_records FROM stats)
    SELECT n_rows, placeholders, n_rows - placeholders AS evaluated, groups_formed, groups, involved, involved - groups AS surplus, dispersed_groups, dispersed_records,
      round(least(round((1 - (involved - groups) / (n_rows - placeholders)) * 100, 1),
        CASE WHEN dispersed_groups > 0 THEN greatest(50.0, 100 - dispersed_records / (n_rows - placeholders) * 100) ELSE 100.0 END), 1) AS score,
      CASE WHEN dispersed_groups = 0 THEN 'reliable' WHEN dispersed_records / (n_rows - placeholders) >= 0.2 THEN 'unreliable' ELSE 'partial' END AS reliability FROM k""",
    VIEW,
)
def sim_score(d: Data):
    """Score and reliability of a near-duplicate run."""
    return run_of(d).meta().select(
        "n_rows", "placeholders", "evaluated", "groups_formed", "groups", "involved", "surplus", "dispersed_groups",
        "dispersed_records", "score", "reliability",
    )


#: The run of RUN_SQL on the pairs that a cap leaves.
CAPPED_RUN = f"""{RAWS}, {BLOCKS}, {QGRAM_SETS}, {qgram_sql(80).replace('pairs AS MATERIALIZED', 'every AS MATERIALIZED')}, {stream_sql(PER_BLOCK, CAP)}, {CAP_REPORT},
  pairs AS MATERIALIZED (SELECT a, b, similarity FROM every JOIN chosen USING (a, b))"""


@query(
    "sim_score_capped",
    f"""{STATS.replace(RUN_SQL, CAPPED_RUN)}, k AS (SELECT (SELECT count(*) FROM companies WHERE NOT {PLACEHOLDER}) AS evaluated,
      cast(coalesce(sum(CASE WHEN NOT (members >= 3 AND density < 0.6) THEN members - 1 END), 0) AS bigint) AS surplus,
      count(CASE WHEN members >= 3 AND density < 0.6 THEN 1 END) AS dispersed_groups,
      cast(coalesce(sum(CASE WHEN members >= 3 AND density < 0.6 THEN members END), 0) AS bigint) AS dispersed_records FROM stats)
    SELECT k.evaluated, surplus, dispersed_groups, partial, discarded_pct, round(least(round((1 - surplus / k.evaluated) * 100, 1),
        CASE WHEN dispersed_groups > 0 THEN greatest(50.0, 100 - dispersed_records / k.evaluated * 100) ELSE 100.0 END,
        CASE WHEN partial THEN greatest(50.0, 100 - discarded_pct) ELSE 100.0 END), 1) AS score,
      CASE WHEN partial THEN 'unreliable' WHEN dispersed_groups = 0 THEN 'reliable' WHEN dispersed_records / k.evaluated >= 0.2 THEN 'unreliable' ELSE 'partial' END AS reliability
    FROM k, capped""",
    VIEW,
)
def sim_score_capped(d: Data):
    """Score and reliability of a run under a cap that leaves out promising pairs."""
    meta = run_of(d, cap=CAP, per_block=PER_BLOCK).meta()
    return meta.select("evaluated", "surplus", "dispersed_groups", "partial", "discarded_pct", "score", "reliability")


RUN_JW = f"""{RAWS}, pairs AS MATERIALIZED (SELECT a, b, s AS similarity FROM (SELECT x.v AS a, y.v AS b,
  jaro_winkler_similarity(x.v, y.v) * 100 AS s FROM nodes x JOIN nodes y ON x.v < y.v) WHERE s >= 92)"""


@query(
    "sim_default_run",
    f"""{MEMBERS.replace(RUN_SQL, RUN_JW)}, f AS (SELECT r.*, k.keep_id, k.keep_value, members >= 3 AND density < 0.6 AS chain, members > 10 AS big, b.similarity
      FROM recs r JOIN keep k USING (component) JOIN stats USING (component) JOIN raws w ON w.raw = r.name JOIN best b ON b.v = w.v)
    SELECT id AS record_id, 'name' AS "column", 'similarity' AS dimension, CASE WHEN chain THEN 'dispersed group: possible chain, not in the score'
      WHEN id = keep_id THEN 'near-duplicate: keep this record' ELSE 'near-duplicate: correct to the kept record' END AS reason, name AS value,
      id = keep_id AND NOT chain AS is_principal, CASE WHEN id <> keep_id AND NOT chain THEN keep_value END AS correct_value,
      cast(min(id) OVER (PARTITION BY component) AS string) AS group_id, round(similarity, 1) AS similarity_pct, big AS big_group, chain AS dispersed_group FROM f""",
    VIEW,
)
def sim_default_run(d: Data):
    """All issues of a run with the default algorithm and threshold."""
    return pl.near_duplicates(d.view("companies"), "id", "name").issues()


@query("report_similarity_detail")
def report_similarity_detail(d: Data):
    """Counters and warning of an affine-gap run."""
    from plumbline.operators.report import similarity_detail

    return similarity_detail(pl.near_duplicates(d.view("companies"), "id", "name", algorithm="affine_gap", threshold=90).meta())


@query(
    "sim_closure_of_documents",
    """WITH p AS (SELECT min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
    SELECT count(*) AS groups, cast(sum(n) AS bigint) AS records FROM p""",
)
def sim_closure_of_documents(d: Data):
    """Exact copies of whole document texts linked to their first copy and closed transitively."""
    docs = d.table("documents").select("doc_id", "text")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("a"))
    links = docs.join(first, "text").where(F.col("doc_id") > F.col("a")).select("a", F.col("doc_id").alias("b"))
    found = connected_components(links)
    return found.agg(F.count_distinct("component").alias("groups"), F.count(F.lit(1)).alias("records"))
