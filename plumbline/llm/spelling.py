"""Groups of spelling variants: words one edit apart, each pointing to the commonest of its neighbours.

The vocabulary is counted first. Its words go into blocked Bloom filters, one per word length, of bounded size, which
every task gets. A task generates the edits of its words as hashes, without writing them out: all deletions, probed in
the filter of words shorter by one, and all replacements by a later letter, in that of the same length; insertions are
the deletions of the longer word. Only positives become strings and are joined with the vocabulary, which removes what a
filter let through by chance.

A filter never loses a word. If the vocabulary outgrows ``FILTER_BLOCKS``, more false positives reach the join, and the
result is the same.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pretokens import BASE, mixed
from plumbline.llm.shared import kept

#: Letters of words, as code points: a-z and U+00C0 to U+00FF (A-Z are lower-cased).
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.int64)
RUN = re.compile("[a-zÀ-ÿ]+")
#: Blocks of 256 bits in all filters together (16 MB), and words for each block before that limit.
FILTER_BLOCKS, WORDS_A_BLOCK = 1 << 19, 16
#: Words of this length or more share a filter.
LONGEST = 64
#: Words that a task counts before it hands its counts on, words whose edits one task probes, and probes made at once.
COUNTED, PROBED, PROBES = 1 << 19, 1 << 14, 1 << 19
#: A hash sets one bit of 32 in each of eight lanes.
SALTS = mixed(np.arange(1, 9, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def word_counts(docs: DataFrame, delete_every: int = 0) -> DataFrame:
    """(word, n) of all runs of letters in ``docs`` (doc_id, text), A-Z lower-cased; n counts occurrences.

    ``delete_every``: with h the crc32 of ``<doc_id>:<run>``, a run whose h this divides loses the code point at h %
    length, which plants reproducible misspellings; a null doc_id plants none. 0 leaves all runs as they are.
    """

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                runs = Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode()))
                head = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for run, n in runs.items():
                    if delete_every and head is not None:
                        h = zlib.crc32(run.encode(), head)
                        if h % delete_every == 0:
                            run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    total[run] = total.get(run, 0) + n
                if len(total) > COUNTED:
                    yield handed()
        yield handed()

    return docs.select("doc_id", "text").mapInArrow(counts, "word string, n long").where("word != ''").groupBy("word").agg(F.sum("n").alias("n"))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, code points of the words at these places as a matrix) for each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, (1 << 22) // n)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield n, part, np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), n).astype(np.int64)


def letter_hashes(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64))


def weights(n: int) -> tuple[np.ndarray, np.uint64]:
    """Powers of the base for the places of a word, and the base's inverse."""
    up = np.full(n, BASE, np.uint64)
    up[0] = 1
    return np.multiply.accumulate(up), np.uint64(pow(int(BASE), -1, 1 << 64))


def places(hashes: np.ndarray, length: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, the 32 bits that set or test the lanes) of word hashes."""
    h = mixed(hashes ^ np.uint64(length))
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), h.astype(np.uint32)


def lane_bits(low: np.ndarray, lane: int) -> np.ndarray:
    return np.uint32(1) << (low * SALTS[lane] >> np.uint32(27))


def filter_sizes(counts: dict[int, int]) -> dict[int, int]:
    """Blocks of the filter of each length."""
    total = sum(counts.values())
    return {shard: max(1, min(-(-n // WORDS_A_BLOCK), FILTER_BLOCKS * n // total)) for shard, n in counts.items()}


def filters(words: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The filter of every length: Spark sets the bits of each block; the blocks, bounded in number, are collected."""

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, codes in by_length(batch.column(0).to_pylist()):
                shard = min(n, LONGEST)
                block, low = places((letter_hashes(codes) * weights(n)[0]).sum(axis=1, dtype=np.uint64), n, sizes[shard])
                lanes = [pa.array(lane_bits(low, k).view(np.int32)) for k in range(8)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), shard, np.int32)), pa.array(block), *lanes], names)

    lanes = [f"l{k}" for k in range(8)]
    names = ["shard", "block", *lanes]
    rows = words.select("word").mapInArrow(bits, f"shard int, block long, {', '.join(f'{c} int' for c in lanes)}")
    found = rows.groupBy("shard", "block").agg(*[F.bit_or(c).alias(c) for c in lanes]).toArrow()
    shards, block = found.column("shard").to_numpy(), found.column("block").to_numpy()
    values = np.stack([found.column(c).to_numpy().astype(np.int32).view(np.uint32) for c in lanes], axis=1)
    out = {}
    for shard, size in sizes.items():
        out[shard] = np.zeros((size, 8), np.uint32)
        out[shard][block[shards == shard]] = values[shards == shard]
    return out


def held(table: np.ndarray | None, hashes: np.ndarray, length: int) -> np.ndarray:
    """Which of the hashes of words of ``length`` the filter may hold."""
    if table is None or not len(hashes):
        return np.zeros(0, np.int64)
    block, low = places(hashes, length, len(table))
    left = np.flatnonzero(table[block, 0] & lane_bits(low, 0))
    for lane in range(1, 8):
        left = left[(table[block[left], lane] & lane_bits(low[left], lane)) != 0]
    return left


def probed(codes: np.ndarray, known: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(words, place, letters) of the edits that a filter may hold, of words given as a matrix of code points.

    Letter 0 stands for a deletion. A replacement is probed with later letters only, so that each pair comes once, and a
    deletion only at the first of equal letters in a row.
    """
    n = codes.shape[1]
    up, down = weights(n)
    values = letter_hashes(codes) * up
    whole = values.sum(axis=1, dtype=np.uint64)
    same, shorter = known.get(min(n, LONGEST)), known.get(min(n - 1, LONGEST)) if n > 1 else None
    letters, before = letter_hashes(LETTERS), np.zeros(len(codes), np.uint64)
    for i in range(n):
        if shorter is not None:
            rows = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(len(codes))
            after = whole - before - values[:, i]
            hit = rows[held(shorter, (before + after * down)[rows], n - 1)]
            yield hit, i, np.zeros(len(hit), np.int64)
        step = max(1, PROBES // len(LETTERS))
        for k in range(0, len(codes), step):
            row, letter = np.nonzero(LETTERS[None, :] > codes[k : k + step, i, None])
            row += k
            hit = held(same, (whole - values[:, i])[row] + letters[letter] * up[i], n)
            yield row[hit], i, LETTERS[letter[hit]]
        before = before + values[:, i]


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, n_near): for each of ``words`` (word, n) all others that one inserted, deleted or replaced letter makes."""
    spark = words.sparkSession
    shard = F.least(F.length("word"), F.lit(LONGEST)).alias("shard")
    counts = {r.shard: r["count"] for r in words.groupBy(shard).count().collect()}
    known = spark.sparkContext.broadcast(filters(words, filter_sizes(counts)) if counts else {})
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string())])

    def edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1)
            for length, at, codes in by_length(texts):
                for rows, i, letters in probed(codes, known.value):
                    if len(rows):
                        from_ = at[rows]
                        other = [texts[k][:i] + (chr(c) if c else "") + texts[k][i + 1 :] for k, c in zip(from_.tolist(), letters.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in from_.tolist()], pa.string()), n.take(pa.array(from_)), pa.array(other, pa.string())], schema=schema)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // PROBED))
    positive = words.select("word", "n").repartition(parts, "word").mapInArrow(edits, "word string, n long, other string")
    pairs = positive.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    both = F.array(F.struct(F.col("word"), F.col("other").alias("near"), F.col("m").alias("n_near")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("n_near")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the chain that leads from each word of ``forms`` (word, form; without circles).

    A round joins every word with where its form leads, so a chain of k forms takes about log2(k) rounds.
    """
    chain = kept(forms.select("word", F.col("form").alias("root")), "chains", 8)
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = kept(chain.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains", 8)
        chain = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return chain


def spelling_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, delete_every: int = 0) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of ``docs`` (doc_id, text).

    Words are the runs of letters that ``word_counts`` finds, of ``least_length`` code points and ``least_count``
    occurrences (n) at least. Two are near if one inserted, deleted or replaced code point makes one the other. A
    word's form is its near word of largest n (ties: smallest in code-point order), if that n (form_n) is ``ratio`` (2
    or more) times its own or more, else null. Root is where the chain of forms ends, the word itself if it has none;
    n_near counts near words.

    Null and empty texts have no words; a repeated row counts again; a null doc_id is like any other. An empty table
    gives no rows. Other columns are ignored. Words may be of any length.
    """
    if ratio < 2:
        raise ValueError("ratio: 2 or more, or chains of forms could be circles")
    counts = word_counts(docs, delete_every).where((F.length("word") >= least_length) & (F.col("n") >= least_count))
    words = kept(counts, "vocabulary")
    best = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("minus"), F.col("near"))).alias("top"))
    best = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "top")
    chosen = -F.col("top.minus") >= ratio * F.col("n")
    rows = best.select("word", "n", "n_near", F.when(chosen, F.col("top.near")).alias("form"), F.when(chosen, -F.col("top.minus")).alias("form_n"))
    rows = kept(rows, "word-forms", 2)
    named = rows.join(roots(rows.where("form is not null")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
