"""The queries of the operators, over whole tables with production parameters, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import block_ann, byte_cnn, decontamination, html_tree, jaccard_join, license_scan, mixing, periodic_runs, preference, records, simhash_pivots, spelling, unigram_trie

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        LLM_QUERIES[fn.__name__] = fn
        if oracle:
            LLM_ORACLES[fn.__name__] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NEAREST_SQL = """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    d AS (
      SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query(NEAREST_SQL)
def op1_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by Euclidean distance, of every vec_id divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    found = block_ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


@query()
def op8_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under a unigram model over the 32k piece vocabulary."""
    return unigram_trie.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op5_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents that state a known licence."""
    return license_scan.licenses(table(spark, sf_dir, "documents"))


PREFERENCE_SQL = """
    WITH c AS (
      SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    answers AS (SELECT conv_id AS pair_id, turn, min(text) AS answer FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY 1, 2),
    last AS (SELECT pair_id, max(turn) AS last FROM answers GROUP BY 1),
    older AS (SELECT pair_id, arg_max(answer, turn) AS older FROM answers JOIN last USING (pair_id) WHERE turn < last GROUP BY 1),
    r AS (
      SELECT DISTINCT pair_id, turn, role, CASE WHEN turn = last AND role = 'assistant' THEN coalesce(older, '') ELSE text END AS text
      FROM c JOIN last USING (pair_id) LEFT JOIN older USING (pair_id) WHERE turn IS NOT NULL),
    a AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS k FROM r),
    z AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k, a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
          FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.k = b.k),
    n AS (SELECT pair_id, coalesce(min(k) FILTER (WHERE NOT same) - 1, max(k)) AS n FROM z GROUP BY 1),
    line AS (
      SELECT pair_id, side, k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS t,
             CASE WHEN role = 'assistant' THEN '0:' || (13 + length(role)) || ',1:' || (length(text) + 10) || ',0:1'
                  ELSE '0:' || (24 + length(role) + length(text)) END AS m
      FROM (SELECT *, 'a' AS side FROM a UNION ALL SELECT *, 'b' AS side FROM b))
    SELECT n.pair_id, n.n::BIGINT AS n_prompt_turns,
           coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE side = 'a' AND k <= n.n), '') AS prompt,
           coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE side = 'a' AND k > n.n), '') AS chosen,
           coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE side = 'b' AND k > n.n), '') AS rejected,
           coalesce(string_agg(m, ',' ORDER BY k) FILTER (WHERE side = 'a' AND k > n.n), '') AS chosen_mask,
           coalesce(string_agg(m, ',' ORDER BY k) FILTER (WHERE side = 'b' AND k > n.n), '') AS rejected_mask
    FROM n JOIN last USING (pair_id) JOIN line USING (pair_id) GROUP BY 1, 2
"""


@query(PREFERENCE_SQL)
def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, completions and masks of every conversation with an answer against one that repeats its older answer."""
    chosen = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "pair_id")
    pairs = preference.preference_pairs(chosen, preference.stale_answers(chosen))
    return pairs.withColumns({c: preference.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CONTAMINATION_SQL = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    win AS (
      SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM b),
    lens AS (SELECT DISTINCT len(string_split(g, ' ')) AS k FROM win),
    grams AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, w FROM d, lens WHERE len(w) >= k),
    occ AS (SELECT doc_id, pos, k, item_id FROM (SELECT doc_id, pos, k, array_to_string(w[pos:pos+k-1], ' ') AS g FROM grams) JOIN win USING (g)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM occ) GROUP BY 1),
    its AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS s FROM occ GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
           sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query(CONTAMINATION_SQL)
def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that benchmark windows of ten words cover, and the items they come from."""
    rows = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return rows.drop("items", "places")


@query()
def op3_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_tree.extracted(table(spark, sf_dir, "pages"))


@query(
    """
    WITH RECURSIVE sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 6))::BIGINT AS key
      FROM documents),
    src AS (
      SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
      FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
    ordered AS (
      SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(3 * source_size) OVER w, 0) AS caps_before,
             sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_after
      FROM src WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (
      SELECT arg_min((total - caps_before) / weight_after, 3 * source_size / weight)
             FILTER (WHERE 3 * source_size / weight >= (total - caps_before) / weight_after) AS level FROM ordered),
    goal AS (SELECT source, source_size, least(3.0 * source_size, weight * level)::DOUBLE AS target FROM src, level),
    plan AS (
      SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM goal),
    placed AS (
      SELECT s.doc_id, s.size, p.source_size, p.target, p.whole,
             greatest(floor(p.target)::BIGINT - p.whole * p.source_size, 0) AS rest,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
    """
)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a capped mix of all sources takes from every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a byte-level network trained on labelled rows."""
    return byte_cnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


JACCARD_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.c + b.c - i)),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
    SELECT doc_id, coalesce(any_value(n.c), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
    FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query(JACCARD_SQL)
def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 5-word shingles are similar at 0.75 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=75)


@query()
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-delimited token-id records of all documents, read back from the files."""
    _, index = records.export(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "at", "size")


@query()
def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that differ in at most 4 bits."""
    rows = simhash_pivots.simhash_components(table(spark, sf_dir, "documents"), width=4, distance=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: crc32 bit by bit, from the lowest bit of every byte; near words by what is left without one code point.
SPELLING_SQL = f"""
    WITH RECURSIVE run AS (
      SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents)
      WHERE length(w) >= 5 GROUP BY ALL),
    hex AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || w)) AS x FROM run),
    bit AS (
      SELECT doc_id, w, c, list_transform(range(0, 4 * length(x)), lambda i: (('0x' || substr(x, (i // 8 * 2)::INT + 1, 2))::BIGINT >> (i % 8)) & 1) AS b FROM hex),
    crc AS (
      SELECT w, c, xor(list_reduce(b, lambda a, v: xor(a >> 1, 3988292384 * (xor(a, v) & 1)), 4294967295::BIGINT), 4294967295) AS h FROM bit),
    word AS (
      SELECT word, sum(c)::BIGINT AS n FROM (
        SELECT c, CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM crc)
      WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
    del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1))::INT AS i FROM word)),
    pair AS (
      SELECT a.word, b.word AS near, b.n AS m FROM del a JOIN del b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM del a JOIN word b ON a.d = b.word
      UNION SELECT b.word, a.word, a.n FROM del a JOIN word b ON a.d = b.word),
    top AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pair GROUP BY word),
    best AS (SELECT word, n_near, t.m, min(near) AS near FROM top t JOIN pair p USING (word, m) GROUP BY ALL),
    form AS (
      SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
      FROM word w LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS root FROM form UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON c.word = f.word JOIN form e ON e.word = c.root AND e.form IS NULL
"""


@query(SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common words of all documents, their neighbours by one edit, and the forms these lead to."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), least_length=5, least_count=3, ratio=2, delete_every=97)


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of all documents, a tenth of which get a planted one, and the texts without repeats."""
    docs = periodic_runs.planted(table(spark, sf_dir, "documents"))
    rows = periodic_runs.periodic_runs(docs, exponent=4, least=6).withColumn("top", periodic_runs.strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
