"""SimHash near-duplicates by tables of distances to reference fingerprints.

A fingerprint is described by its Hamming distances to a table of references. The base reference is fixed; the others
are it with the first 1, 2, ... bits of one segment of the 64 bits turned. By the triangle inequality two fingerprints
within ``distance`` differ by at most that in every coordinate, so a pair with a larger difference is discarded, and
survivors are verified on their bits.

Not every pair is compared. What turning bits of a segment adds to the distance depends on that segment alone. With s
segments, a pair within ``distance`` has s - ``distance`` segments without a differing bit, and agrees there in all these
additions. A fingerprint goes to one bucket for every choice of s - ``distance`` segments, named by the additions of the
choice; a pair that is near meets in a bucket. s follows from the number of distinct fingerprints, so that a bucket of
unrelated ones holds a few; a bucket beyond ``LIMIT`` is cut into blocks, and every two blocks meet in a tile.

A task returns links that join what it found near, fewer than the fingerprints it read, and never lists of pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components, star_forest
from plumbline.llm.pretokens import mixed
from plumbline.llm.shared import kept
from plumbline.llm.words import row_slices

#: Fingerprints of a bucket that are compared in one piece, and entries that one task compares.
LIMIT, ENTRIES = 16_384, 1 << 19
#: Buckets up to this size are compared pair by pair, all at once; larger ones are searched.
SMALL = 24
#: Shingles whose bits are counted at once.
COUNTED = 1 << 18
BASE = 0x6A09E667F3BCC908


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of every run of ``width`` words, joined by a space; a shorter text is one run, one without words none."""
    words = text.lower().split()  # of bytes: A-Z only, and only at space and 09 to 0D
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, whose ``counts`` hashes lie in a row, the bits that over half of them have set."""
    votes = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for a in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[a : a + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = owner[a : a + COUNTED]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        votes[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprinted(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(ref, fingerprint) of every row of ``docs`` (ref, text)."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in row_slices(whole, 1)):
            hashes = [shingle_hashes(text or b"", width, seed) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((h for part in hashes for h in part), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(flat, counts).view(np.int64))], ["ref", "fingerprint"])

    return docs.select("ref", "text").mapInArrow(digest, "ref long, fingerprint long")


@lru_cache(maxsize=16)
def references(segments: int) -> tuple[np.ndarray, tuple[tuple[int, int], ...]]:
    """(reference fingerprints, where the references of every segment lie among them); the first is the base."""
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    turned = [((1 << b) - 1) ^ ((1 << a) - 1) for a, z in zip(edges, edges[1:]) for b in range(a + 1, z + 1)]
    return np.array([BASE, *(BASE ^ t for t in turned)], np.uint64), tuple((a + 1, z + 1) for a, z in zip(edges, edges[1:]))


def distance_table(prints: np.ndarray, segments: int) -> np.ndarray:
    """Hamming distances of every fingerprint to every reference."""
    table = np.empty((len(prints), 65), np.int8)
    for k, reference in enumerate(references(segments)[0]):
        table[:, k] = np.bitwise_count(prints ^ reference)
    return table


def buckets(table: np.ndarray, segments: int, distance: int) -> np.ndarray:
    """The bucket of every fingerprint for each choice of segments: named by what its references add to the distance."""
    added = (table[:, 1:] - table[:, :1]).astype(np.int64).view(np.uint64)
    names = []
    for a, z in references(segments)[1]:
        h = np.full(len(table), a, np.uint64)
        for k in range(a - 1, z - 1):
            h = mixed(h * np.uint64(3) + added[:, k])
        names.append(h)
    keys = []
    for number, choice in enumerate(combinations(range(segments), segments - distance)):
        h = np.full(len(table), number, np.uint64)
        for k in choice:
            h = mixed(h * np.uint64(3) + names[k])
        keys.append(h)
    return np.stack(keys, axis=1)


def near(table: np.ndarray, prints: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs (a, b) are near: none that a coordinate discards, and verified on the bits."""
    left = np.arange(len(a))
    for columns in (slice(0, 9), slice(9, 65)):
        gap = np.abs(table[a[left], columns] - table[b[left], columns]).max(axis=1) if len(left) else np.zeros(0)
        left = left[gap <= distance]
    return left[np.bitwise_count(prints[a[left]] ^ prints[b[left]]) <= distance]


def searched(table: np.ndarray, prints: np.ndarray, members: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the near members of a bucket: from each, in turn, to all near ones that no link has reached yet.

    Members lie by their first coordinate, and one looks only where this differs by at most ``distance``.
    """
    rest = members[np.argsort(table[members, 0], kind="stable")]
    links, reached = [], []
    while len(rest):
        if not reached:
            reached, rest = [int(rest[0])], rest[1:]
        own = reached.pop()
        first = table[rest, 0]
        lo, hi = np.searchsorted(first, table[own, 0] - distance), np.searchsorted(first, table[own, 0] + distance, "right")
        part = rest[lo:hi]
        hit = near(table, prints, np.full(len(part), own), part, distance)
        if len(hit):
            links.append((np.full(len(hit), own), part[hit]))
            reached.extend(part[hit].tolist())
            rest = np.delete(rest, lo + hit)
    return links


def bucket_links(cells: np.ndarray, prints: np.ndarray, segments: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) that join all fingerprints that are near and share a cell, fewer than there are fingerprints."""
    prints, at = np.unique(prints, return_inverse=True)
    table = distance_table(prints, segments)
    order = np.argsort(cells, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, np.diff(cells[order]) != 0))
    sizes = np.diff(np.append(first, len(at)))
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for n in range(2, SMALL + 1):
        starts = first[sizes == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, (1 << 19) // len(i))
        for k in range(0, len(starts), step):
            a, b = (at[(starts[k : k + step, None] + x[None, :]).ravel()] for x in (i, j))
            hit = near(table, prints, a, b, distance)
            links.append((a[hit], b[hit]))
    for start, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        links += searched(table, prints, np.unique(at[start : start + n]), distance)
    a, b = star_forest(*(np.concatenate(part) for part in zip(*links)))
    return prints[a], prints[b]


def segments_for(n: int, distance: int) -> int:
    """Segments with which buckets of ``n`` unrelated fingerprints hold a few: more give more and smaller buckets."""
    return next((s for s in range(distance + 2, 2 * distance + 2) if 4 << (64 * (s - distance) // s) >= n), 2 * distance + 2)


def near_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (x, y) that join all fingerprints of ``prints`` (fingerprint, distinct) within ``distance``."""
    spark = prints.sparkSession
    n = prints.count()
    segments = segments_for(n, distance)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1 << 14):
                own = whole.column(0).slice(k, 1 << 14).to_numpy().view(np.uint64)
                keys = buckets(distance_table(own, segments), segments, distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(own.view(np.int64), keys.shape[1]))], ["bucket", "fingerprint"]
                )

    entries = prints.select("fingerprint").mapInArrow(dealt, "bucket long, fingerprint long")
    crowded = kept(entries.groupBy("bucket").count().where(F.col("count") > LIMIT).select("bucket", F.ceil(F.col("count") / LIMIT).cast("int").alias("blocks")), "crowded", 8)
    cell = entries.join(crowded, "bucket", "left") if crowded.count() else entries.withColumn("blocks", F.lit(None).cast("int"))
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = cell.select("bucket", "fingerprint", F.coalesce(block, F.lit(0)).alias("block"), other.alias("other"))
    cell = cell.select("fingerprint", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("cell"))
    per_print = len(list(combinations(range(segments), segments - distance)))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * per_print // ENTRIES))

    def link(table: pa.Table) -> pa.Table:
        x, y = bucket_links(table.column("cell").to_numpy(), table.column("fingerprint").to_numpy().view(np.uint64), segments, distance)
        return pa.table({"x": pa.array(x.view(np.int64)), "y": pa.array(y.view(np.int64))})

    return cell.groupBy(F.pmod("cell", F.lit(groups))).applyInArrow(lambda table: link(table), "x long, y long")


def simhash_components(docs: DataFrame, width: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (a long) and component_id of every row of ``docs`` (doc_id, text).

    The words of a text are runs of characters other than space and 09 to 0D, with A-Z lower-cased; its shingles are all
    runs of ``width`` words, repeats included, or the whole sequence if it has fewer. A bit of the fingerprint is set if
    over half of the shingles' XXH64 have it set. Fingerprints within ``distance`` bits link; component_id is the
    smallest doc_id that links reach, itself included.

    Null and empty texts and texts without words have the fingerprint 0, which links like any other. Rows with a null
    doc_id link like others; they give their component no name, and it is null if nobody else does. Repeated rows are
    rows of their own in one component, half of the votes set no bit. An empty table gives no rows; other columns are ignored.
    """
    rows = kept(fingerprinted(docs.select(F.col("doc_id").cast("long").alias("ref"), "text"), width, seed), "fingerprints")
    prints = kept(rows.groupBy("fingerprint").agg(F.min("ref").alias("lowest")), "distinct-fingerprints", 2)
    links = kept(near_links(prints, distance), "near-fingerprints", 4)
    named = components(links).withColumnRenamed("node", "fingerprint")
    known = prints.join(named, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    known = kept(known, "fingerprint-components", 2)
    lowest = known.groupBy("component").agg(F.min("lowest").alias("component_id"))
    known = kept(known.join(lowest, "component").select("fingerprint", "component_id"), "component-names", 2)
    return rows.join(known, "fingerprint").select(F.col("ref").alias("doc_id"), "fingerprint", "component_id")
