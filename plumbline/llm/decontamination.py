"""Benchmark decontamination with suffix arrays over shards of the training documents.

Every task turns its documents into shards of about half a million words. A shard sorts the suffixes of its word sequence
(those that begin with a few words that some benchmark item has in a row; no other suffix can hold a match), and the
longest verbatim match of every suffix of the benchmark is found in it by binary search. Where it is as long as the
window that begins there, all places of the window are hits. Documents never move; the benchmark goes to the tasks in
blocks of bounded size, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.pretokens import mixed
from plumbline.llm.words import NON_WORDS, hashed_words, row_slices

#: Bytes of benchmark text that go to the tasks at once, words of a shard, words by which suffixes are sorted (a window
#: if that is longer), rows of words compared at once.
ITEM_BLOCK, SHARD_WORDS, DEPTH, STEP = 8 << 20, 1 << 19, 64, 1 << 15


@dataclass
class Items:
    """A block of the benchmark: words as numbers from 1 (0: any other word, or a text's end)."""

    names: list[str]
    vocabulary: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    window: int

    @classmethod
    def of(cls, names: list[str], texts: list[str], window: int) -> Items:
        hashes, bounds = hashed_words(pa.array(texts, pa.string()), NON_WORDS)
        vocabulary, ids = np.unique(hashes, return_inverse=True)
        return cls(names, vocabulary, ids.astype(np.int64) + 1, bounds, window)

    def __post_init__(self):
        counts = np.diff(self.bounds)
        item = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(len(self.words)) - self.bounds[:-1][item]
        size = np.minimum(counts, self.window)[item]
        self.depth = max(DEPTH, self.window)
        self.bits = int(len(self.vocabulary) + 1).bit_length()
        self.per_key = 63 // self.bits
        self.spaced = np.zeros(len(self.words) + len(counts) + self.depth, np.int64)
        self.place = np.arange(len(self.words)) + item
        self.spaced[self.place] = self.words
        self.item, self.inner = item, inner
        starts = np.flatnonzero(inner <= counts[item] - size)
        self.window_sizes = size[starts]
        self.lead = int(min(4, self.window_sizes.min())) if len(starts) else 1
        rows = words_at(self.spaced, self.place[starts], self.window)
        rows[np.arange(self.window)[None, :] >= self.window_sizes[:, None]] = 0
        # equal windows are looked for once
        self.windows, which = np.unique(np.column_stack([rows, self.window_sizes]), axis=0, return_inverse=True)
        self.starts, self.which = starts, which.ravel()
        pairs = np.unique(np.column_stack([self.which, item[starts]]), axis=0)
        self.window_items = pairs[:, 1]
        self.item_bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.suffixes = np.flatnonzero(inner <= counts[item] - self.lead)
        self.suffix_leads = lead_hashes(self.spaced, self.place[self.suffixes], self.lead)
        self.leads = np.unique(self.suffix_leads)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Words packed into whole numbers, several to a key, in an order that is the order of the words."""
        columns = []
        for k in range(0, rows.shape[1], self.per_key):
            key = np.zeros(len(rows), np.int64)
            for j in range(self.per_key):
                key <<= self.bits
                if k + j < rows.shape[1]:
                    key |= rows[:, k + j]
            columns.append(key)
        return np.column_stack(columns) if columns else np.zeros((len(rows), 0), np.int64)


def words_at(spaced: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` words from each place; 0 from the first 0 on."""
    rows = spaced[np.minimum(places[:, None] + np.arange(depth)[None, :], len(spaced) - 1)]
    rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0
    return rows


def lead_hashes(spaced: np.ndarray, places: np.ndarray, lead: int) -> np.ndarray:
    h = np.zeros(len(places), np.uint64)
    for k in range(lead):
        h = mixed(h * np.uint64(3) + spaced[places + k].astype(np.uint64))
    return h


class Shard:
    """The suffix array of a shard, over the suffixes that can begin a match."""

    def __init__(self, items: Items, hashes: np.ndarray, bounds: np.ndarray):
        self.items, counts = items, np.diff(bounds)
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.searchsorted(items.vocabulary, hashes)
        at[at == len(items.vocabulary)] = 0
        known = items.vocabulary[at] == hashes if len(items.vocabulary) else np.zeros(len(hashes), bool)
        self.spaced = np.zeros(len(hashes) + len(counts) + items.depth, np.int32)
        self.place = np.arange(len(hashes)) + text
        self.spaced[self.place] = np.where(known, at + 1, 0)
        self.text_of = np.append(np.repeat(np.arange(len(counts)), counts + 1), len(counts))
        self.begins = bounds[:-1] + np.arange(len(counts))
        run = self.spaced[: len(self.text_of)] != 0
        for k in range(1, items.lead):
            run = run & (self.spaced[k : k + len(run)] != 0)
        places = np.flatnonzero(run)
        leads = lead_hashes(self.spaced, places, items.lead)
        known = np.isin(leads, items.leads)
        places, self.leads = places[known], np.unique(leads[known])
        parts = [items.keys(words_at(self.spaced, places[k : k + STEP], items.depth)) for k in range(0, len(places), STEP)]
        keys = np.concatenate(parts) if parts else items.keys(np.zeros((0, items.depth), np.int32))
        order = np.lexsort(keys.T[::-1]) if len(places) else np.zeros(0, np.int64)
        self.suffixes, self.keys = places[order], keys[order]

    def lower(self, rows: np.ndarray) -> np.ndarray:
        """For each row of words the first place in the suffix array that isn't before it, by binary search."""
        wanted = self.items.keys(rows)
        width = wanted.shape[1]
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.suffixes), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            less = self.keys[mid, :width] < wanted[open_]
            more = self.keys[mid, :width] > wanted[open_]
            first_less, first_more = (np.where(x.any(1), x.argmax(1), width) for x in (less, more))
            before = first_less < first_more
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]

    def places_of(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of every suffix that begins with the first ``sizes`` words of a row; the row has 0 after them."""
        after = rows.copy()
        after[np.arange(len(rows)), sizes - 1] += 1
        low, high = self.lower(rows), self.lower(after)
        n = high - low
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(rows)), n), self.suffixes[np.repeat(low, n) + inner]

    def sorted_matches(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest match of every suffix of every item within the sorted words, from ``lead`` words."""
        items = self.items
        best, where = np.zeros(len(items.words), np.int64), np.zeros(len(items.words), np.int64)
        sought = items.suffixes[np.isin(items.suffix_leads, self.leads)]
        for k in range(0, len(sought), STEP):
            some = sought[k : k + STEP]
            rows = words_at(items.spaced, items.place[some], items.depth)
            low = self.lower(rows)
            for side in (low, low - 1):  # the longest common beginnings are beside the place
                ok = np.flatnonzero((side >= 0) & (side < len(self.suffixes)))
                place = self.suffixes[side[ok]]
                mine = words_at(self.spaced, place, items.depth)
                same = np.where((mine != rows[ok]) | (mine == 0), 0, 1).cumprod(axis=1).sum(axis=1)
                better = same > best[some[ok]]
                best[some[ok[better]]], where[some[ok[better]]] = same[better], place[better]
        return best, where

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence of every window: those that the longest match of their suffix covers."""
        items = self.items
        length, _ = self.sorted_matches()
        found = np.unique(items.which[length[items.starts] >= items.window_sizes])
        which, place = self.places_of(items.windows[found, :-1], items.windows[found, -1])
        return found[which], place

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest match of every suffix of every item, of at least ``lead`` words."""
        items, depth = self.items, self.items.depth
        best, where = self.sorted_matches()
        for k in np.flatnonzero(best == depth).tolist():  # beyond the sorted words every equal suffix is compared
            mine = int(items.place[k])
            _, places = self.places_of(words_at(items.spaced, items.place[k : k + 1], depth), np.array([depth]))
            for a in range(0, len(places), STEP):
                some = places[a : a + STEP]
                length, open_ = np.full(len(some), depth), np.arange(len(some))
                while len(open_):
                    theirs = words_at(self.spaced, some[open_] + length[open_], depth)
                    ours = words_at(items.spaced, mine + length[open_], depth)
                    same = np.where((theirs != ours) | (theirs == 0), 0, 1).cumprod(axis=1).sum(axis=1)
                    length[open_] += same
                    open_ = open_[same == depth]
                if length.max() > best[k]:
                    best[k], where[k] = length.max(), some[length.argmax()]
        return best, where


def shards(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of whole documents of about SHARD_WORDS words: (rows, word hashes, bounds)."""
    for batch in (part for whole in batches for part in row_slices(whole, column)):
        hashes, bounds = hashed_words(batch.column(column), NON_WORDS)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SHARD_WORDS, "right")) - 1)
            b = min(b, batch.num_rows)
            yield batch.slice(a, b - a), hashes[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            a = b


def item_blocks(items: DataFrame, window: int) -> list:
    """The benchmark as broadcast blocks of about ITEM_BLOCK bytes each; a longer item is a block of its own."""
    spark = items.sparkSession
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text")).where("text is not null").distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // ITEM_BLOCK))
    out = []
    for k in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
        out.append(spark.sparkContext.broadcast(Items.of([r[0] for r in rows], [r[1] for r in rows], window)))
    return out


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def matched(docs: DataFrame, items: DataFrame, window: int = 10) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with words, spans hit and items found; the second value names these columns (they never clash).

    spans: little-endian int32 pairs, first and last word + 1 of every stretch that is hit.
    """
    names = docs.columns
    cols = {k: _free(k, names) for k in ("n_words", "spans", "items")}
    spark_schema = T.StructType([*docs.schema.fields, T.StructField(cols["n_words"], T.LongType()), T.StructField(cols["spans"], T.BinaryType()), T.StructField(cols["items"], T.ArrayType(T.StringType()))])
    state = docs.withColumns({cols["n_words"]: F.lit(0).cast("long"), cols["spans"]: F.lit(b""), cols["items"]: F.array().cast("array<string>")})
    text, first = names.index("text"), len(names)

    def search(block):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = block.value
            for rows, hashes, bounds in shards(batches, text):
                shard = Shard(found, hashes, bounds)
                which, place = shard.occurrences()
                hit = np.zeros(len(shard.text_of) + 1, np.int32)
                np.add.at(hit, place, 1)
                np.add.at(hit, place + found.windows[which, -1], -1)
                hit = np.cumsum(hit) > 0
                old_spans, old_items = rows.column(first + 1).to_pylist(), rows.column(first + 2).to_pylist()
                for k in [k for k, s in enumerate(old_spans) if s]:
                    for a, b in np.frombuffer(old_spans[k], "<i4").reshape(-1, 2):
                        hit[shard.begins[k] + a : shard.begins[k] + b] = True
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                texts = shard.text_of[starts]
                for k in np.unique(texts).tolist():
                    mine = texts == k
                    old_spans[k] = (np.column_stack([starts[mine], ends[mine]]) - shard.begins[k]).astype("<i4").tobytes()
                pairs = np.unique(np.column_stack([shard.text_of[place], which]), axis=0)
                for k, w in pairs.tolist():
                    old_items[k] = {*old_items[k], *(found.names[i] for i in found.window_items[found.item_bounds[w] : found.item_bounds[w + 1]].tolist())}
                arrays = [rows.column(c) for c in range(first)]
                arrays += [pa.array(np.diff(bounds)), pa.array(old_spans, pa.binary()), pa.array([sorted(x) for x in old_items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names[:first], *cols.values()])

        return run

    for block in item_blocks(items, window):
        state = state.mapInArrow(search(block), spark_schema)
    return state, cols


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, places.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A window is
    ``window`` consecutive words of an item of ``items`` (item_id, text), or the whole item if it has fewer words. Every
    word inside an occurrence of a window is hit. places: (first_word, n_words) of every stretch of hit words, in order.

    Null and empty texts have no words; items without words have no window. An item without item_id counts by the name
    null; items that share an item_id are one. Repeated documents are rows of their own, null doc_ids stay null. An
    empty ``items`` hits nothing; an empty ``docs`` gives no rows. Other columns are ignored.
    """
    found, _ = matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.frombuffer(s, "<i4").reshape(-1, 2) for s in batch.column(2).to_pylist()]
            hits = [int(np.diff(s).sum()) for s in spans]
            places = pa.array([[{"first_word": a, "n_words": b - a} for a, b in s.tolist()] for s in spans], place)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), batch.column(3), places], ["doc_id", "n_words", "n_hit", "items", "places"])

    place = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
    schema = "doc_id long, n_words long, n_hit long, items array<string>, places array<struct<first_word:long,n_words:long>>"
    rows = found.select("doc_id", "n_words", "spans", "items").mapInArrow(count, schema)
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "places")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of ``items`` occurs.

    Rows with a null or empty text stay, repeated rows are judged alike, and columns may have any names. Without items
    (or with none that has words) every row stays; an empty ``docs`` gives no rows.
    """
    found, cols = matched(docs, items, window)
    return found.where(F.octet_length(cols["spans"]) == 0).select(*docs.columns)


def longest_matches(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The longest verbatim match of every suffix of every item: item_id, first_word, length, doc_id, at_word.

    Only matches of at least four words (of the shortest window, if that is shorter) are listed. Of equally long matches
    a task names the first in its sorted words, and of those of all tasks the one with the smallest doc_id and place is
    named. Null and empty texts match nothing, items that share an item_id are one, empty tables give no rows.
    """

    def search(block):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = block.value
            for rows, hashes, bounds in shards(batches, 1):
                shard = Shard(found, hashes, bounds)
                length, place = shard.longest()
                hit = np.flatnonzero(length >= found.lead)
                texts = shard.text_of[place[hit]]
                at = place[hit] - shard.begins[texts]
                ids = rows.column(0).take(pa.array(texts))
                names = pa.array([found.names[i] for i in found.item[hit].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(found.inner[hit]), pa.array(length[hit]), ids, pa.array(at)], ["item_id", "first_word", "length", "doc_id", "at_word"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = None
    for block in item_blocks(items, window):
        part = rows.mapInArrow(search(block), "item_id string, first_word long, length long, doc_id long, at_word long")
        parts = part if parts is None else parts.unionByName(part)
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("d"), (-F.col("at_word")).alias("a"))).alias("best")
    parts = parts.groupBy("item_id", "first_word").agg(best)
    return parts.select("item_id", "first_word", F.col("best.length").alias("length"), (-F.col("best.d")).alias("doc_id"), (-F.col("best.a")).alias("at_word"))
