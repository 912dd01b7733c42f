"""Runs of periodic words: stretches that repeat their first words several times, found on tiles of every scale.

Periods are taken by octaves, from P to 2 P - 1. For an octave every document is covered by overlapping tiles around
boundaries P words apart. A tile is solved by itself: the Z-function at its boundary, forwards, says which periods of
the octave hold for the P words behind it; periods that only repeat a shorter one are dropped; and the Z-functions
forwards and backwards say how far, by less than another P words, the others reach. A stretch long enough contains two
boundaries at least, so that no tile needs to look farther.

A task solves tiles of all scales for its documents in blocks of bounded size, joins what neighbouring tiles of a block
found for one period, and hands on fragments (text, period, first, last), far fewer than words. They are shuffled by text
and period, and fragments that overlap or touch are stitched to runs. Words are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.pretokens import mixed
from plumbline.llm.shared import kept
from plumbline.llm.words import BLANKS, hashed_words, row_slices

#: Words of a block of tiles; fragments are joined inside a block, and stitched across blocks after the shuffle.
BLOCK = 1 << 20
#: Words compared at once when fragments are extended.
STEP = 1 << 20

FRAGMENT = pa.struct([("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
SOLVED = pa.schema([("doc_id", pa.int64()), ("ref", pa.binary()), ("n", pa.int64()), ("words", pa.string()), ("fragments", pa.list_(FRAGMENT))])


@lru_cache(maxsize=2)
def smallest_primes(limit: int) -> np.ndarray:
    """The smallest prime factor of every number up to ``limit``."""
    out = np.arange(limit + 1)
    for p in range(2, int(limit**0.5) + 1):
        if out[p] == p:
            part = out[p * p :: p]
            part[part == np.arange(p * p, limit + 1, p)] = p
    return out


def shorter_periods(period: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, period / prime) for the prime factors of every period."""
    rest, prime = period.copy(), smallest_primes(1 << int(period.max()).bit_length())
    while True:
        at = np.flatnonzero(rest > 1)
        if not len(at):
            return
        p = prime[rest[at]]
        yield at, period[at] // p
        for _ in range(64):
            more = rest[at] % p == 0
            if not more.any():
                break
            rest[at[more]] //= p[more]


def repeats_shorter(half: np.ndarray, width: int, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where the ``period`` words from ``at`` repeat fewer words. ``half``: hashes of ``width`` words, at most half a period."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    for own, d in shorter_periods(period):
        length, same = period[own] - d, np.ones(len(own), bool)
        for k in range(0, int(length.max()), width):
            offset = np.minimum(k, length - width)  # the last window lies at the end
            same &= half[at[own] + offset] == half[at[own] + d + offset]
        out[own[same]] = True
    return out


def z_values(words: np.ndarray, at: np.ndarray, period: np.ndarray, most: int, step: int) -> np.ndarray:
    """Z-functions at boundaries: for how many words (up to ``most``) from ``at``, going by ``step`` (1 or -1), a word is
    the same as that a period later."""
    out = np.zeros(len(at), np.int64)
    rows, done, width = np.arange(len(at)), 0, 8
    while len(rows) and done < most:
        width = min(width, most - done)
        stopped = np.zeros(len(rows), bool)
        for k in range(0, len(rows), max(1, STEP // width)):
            part = rows[k : k + max(1, STEP // width)]
            place = at[part, None] + step * np.arange(done, done + width)[None, :]
            ahead = place + period[part, None]
            inside = (place >= 0) & (ahead < len(words))
            same = inside & (words[np.where(inside, place, 0)] == words[np.where(inside, ahead, 0)])
            reach = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
            out[part] += reach
            stopped[k : k + len(part)] = reach < width
        rows, done, width = rows[~stopped], done + width, width * 4
    return out


def fragments(words: np.ndarray, offsets: np.ndarray, exponent: int) -> tuple[np.ndarray, ...]:
    """(document, period, lo, hi) of documents that lie one behind the other, the longest first: words lo to hi - 1 are the
    same as those a period later. ``words`` of different documents differ."""
    lengths, found = np.diff(offsets), []
    hashes = half = words
    for octave in range(63):
        width = 1 << octave
        docs = int(np.searchsorted(-lengths, -exponent * width, "right"))
        if not docs:
            break
        n = int(offsets[docs])
        if octave:
            half, hashes = hashes[:n], np.zeros(n, np.uint64)
            ahead = n - width // 2
            hashes[:ahead] = mixed(half[:ahead] * np.uint64(3) + mixed(half[width // 2 :] + np.uint64(octave)))
        rows = max(2, BLOCK // width)
        for a in range(0, -(-n // width), rows):
            boundary = hashes[a * width : (a + rows) * width : width]
            later = hashes[(a + 1) * width : (a + 1 + len(boundary)) * width]
            later = np.append(later, np.zeros(len(boundary) * width - len(later), np.uint64)).reshape(-1, width)
            i, j = np.nonzero(later == boundary[:, None])  # the Z-function at the boundary reaches over the next `width` words
            at, period = (a + i) * width, width + j
            ends = at + period + width <= n
            at, period = at[ends], period[ends]
            if octave:
                fresh = ~repeats_shorter(half, width // 2, at, period)
                at, period = at[fresh], period[fresh]
            if not len(at):
                continue
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            new = np.append(True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + width))
            first, last, period = at[new], at[np.append(new[1:], True)], period[new]
            border = ((first == a * width) & (a > 0)) | (last == (a + len(boundary) - 1) * width)
            able = border | (last - first + 3 * width > (exponent - 1) * period)
            first, last, period, border = first[able], last[able], period[able], border[able]
            lo = first - z_values(words, first - 1, period, width, -1)
            hi = last + width + z_values(words, last + width, period, width, 1)
            keep = border | (hi - lo >= (exponent - 1) * period)
            lo, hi, period = lo[keep], hi[keep], period[keep]
            doc = np.searchsorted(offsets, lo, "right") - 1
            found.append((doc, period, lo - offsets[doc], hi - offsets[doc]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(part) for part in zip(*found))


def solved(docs: DataFrame, exponent: int) -> DataFrame:
    """doc_id, ref (of texts with fragments), n, the words joined by a space, and the fragments of ``docs`` (doc_id, text)."""

    def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in row_slices(whole, 1)):
            hashes, bounds = hashed_words(batch.column(1), BLANKS, True, False)
            counts = np.diff(bounds)
            order = np.argsort(-counts, kind="stable")
            owner = np.repeat(order, counts[order])
            offsets = np.concatenate([[0], np.cumsum(counts[order])])
            inner = np.arange(len(hashes)) - np.repeat(offsets[:-1], counts[order])
            words = mixed(hashes[bounds[owner] + inner] ^ mixed(owner.astype(np.uint64)))
            doc, period, lo, hi = fragments(words, offsets, exponent)
            doc = order[doc]
            by = np.lexsort((lo, period, doc))
            ends = np.searchsorted(doc[by], np.arange(len(counts) + 1))
            joined = [b" ".join(t.split()) if t else b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            refs = [hashlib.blake2b(t, digest_size=16).digest() if a < z else None for t, a, z in zip(joined, ends, ends[1:])]
            values = pa.StructArray.from_arrays([pa.array(x[by]) for x in (period, lo, hi)], fields=list(FRAGMENT))
            columns = [batch.column(0), pa.array(refs, pa.binary()), pa.array(counts.astype(np.int64)), pa.array([t.decode() for t in joined], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], schema=SOLVED)

    return docs.mapInArrow(tiles, "doc_id long, ref binary, n long, words string, fragments array<struct<period: long, lo: long, hi: long>>")


def stitched(pieces: DataFrame, exponent: int, least: int) -> DataFrame:
    """(ref, start, period, length) of the runs that ``pieces`` (ref, period, lo, hi) make."""
    behind = Window.partitionBy("ref", "period").orderBy("lo", "hi")
    before = F.max("hi").over(behind.rowsBetween(Window.unboundedPreceding, -1))
    parts = pieces.withColumn("gap", (F.col("lo") > before).cast("int"))
    parts = parts.withColumn("part", F.sum(F.coalesce("gap", F.lit(0))).over(behind))
    whole = parts.groupBy("ref", "period", "part").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo")).alias("same"))
    long = (F.col("same") >= (exponent - 1) * F.col("period")) & (F.col("same") + F.col("period") >= least)
    return whole.where(long).select("ref", "start", "period", (F.col("same") + F.col("period")).alias("length"))


RUNS = "array<struct<start: long, period: long, length: long>>"


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n, runs and collapsed of every row of ``docs`` (doc_id, text).

    The n words of a text are runs of characters other than space and 09 to 0D, case kept. A run is a stretch with
    smallest period q (words q apart are identical), of max(``least``, ``exponent`` * q) words or more, that can't be
    longer; ``runs`` has start, period and length of each, by start, then period. ``collapsed`` has the words, joined by
    a space, without those that lie in a run after its first q words.

    Null and empty texts have no words, no runs (an empty list) and an empty ``collapsed``. Null doc_ids and repeated
    rows are rows like others; an empty table gives no rows; other columns are ignored. Texts may be of any length.
    """
    if exponent < 3:
        raise ValueError("exponent: 3 or more, or a run could lie between two boundaries")
    rows = kept(solved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), exponent), "solved-tiles", compression="zstd")
    some = rows.where("ref is not null")
    pieces = some.groupBy("ref").agg(F.min("fragments").alias("fragments")).select("ref", F.explode("fragments").alias("f")).select("ref", "f.*")
    runs = stitched(pieces, exponent, least).groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = kept(runs, "runs", 4)

    def collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split(" ")
                keep = np.ones(len(words), bool)
                for r in found or ():
                    keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                texts.append(" ".join(words[k] for k in np.flatnonzero(keep).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(texts, pa.string())], ["doc_id", "n", "runs", "collapsed"])

    changed = some.join(runs, "ref").select("doc_id", "n", "words", "runs").mapInArrow(collapse, f"doc_id long, n long, runs {RUNS}, collapsed string")
    same = rows.where("ref is null").select("doc_id", "n", F.array().cast(RUNS).alias("runs"), F.col("words").alias("collapsed"))
    without = some.join(runs, "ref", "left_anti").select("doc_id", "n", F.array().cast(RUNS).alias("runs"), F.col("words").alias("collapsed"))
    return same.unionByName(without).unionByName(changed)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; the texts of a tenth of the doc_ids, by their crc32, end in a periodic stretch.

    With g the tenth part of the crc32, from word a = g % n on the p = 1 + (n - a) // (3 + g % 8) words from a are
    repeated to the n-th word; the words are then joined by a space. Null doc_ids and texts without words stay.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", crc.alias("crc")).withColumn("w", F.when((F.col("crc") % 10 == 0) & F.col("text").isNotNull(), cut))
    g, n = F.floor(F.col("crc") / 10), F.nullif(F.size("w").cast("long"), F.lit(0))
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    rows = rows.withColumn("a", a.cast("int")).withColumn("p", p.cast("int")).withColumn("rest", (n - a).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest"))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.size("w") > 0, text).otherwise(F.col("text")).alias("text"))


def strongest(runs):
    """The run of a list with the greatest exact length / period; of ties the first, so smallest start, then period."""
    best = lambda b, r: F.when(b["period"].isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, period: long, length: long>"), best)
