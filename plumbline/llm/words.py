"""Words of whole texts as 64-bit hashes, cut by NumPy from the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.llm.pretokens import mixed, span_hashes

#: Bytes hashed at once; a slice ends between words, so only a longer word makes a longer slice.
SLICE = 1 << 20


def lowered_table(separators: bytes) -> np.ndarray:
    """Byte to its lower-case form, 0 for separators."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    table[list(separators)] = 0
    return table


#: Words between white space: space and the controls 09 to 0D.
BLANKS = lowered_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of ASCII letters and digits and of everything beyond ASCII.
NON_WORDS = lowered_table(bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of one string column; a longer text is a run of its own."""
    _, offsets = utf8(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = min(max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1), batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


def word_spans(codes: np.ndarray, word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a text boundary also ends a word."""
    n = len(codes)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, word
    here = np.append(word, False)
    return np.flatnonzero(here & (~before | edge)), np.flatnonzero(before & (~here | edge))


def hashed_words(column: pa.Array, table: np.ndarray, byte_zero: bool = False, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the end) of a string column.

    ``byte_zero``: the byte 00 belongs to words; the table can't say so, since 0 marks separators. ``fold``:
    words that differ in the case of A-Z are one.
    """
    buf, offsets = utf8(column)
    codes = table[buf]
    word = codes != 0
    if byte_zero:
        word |= buf == 0
    starts, ends = word_spans(codes, word, offsets)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, "right")))
        a, b = starts[at], ends[to - 1]
        hashes[at:to] = span_hashes((codes if fold else buf)[a:b], starts[at:to] - a, ends[at:to] - a)
        at = to
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds per text): all runs of ``width`` words; a shorter text is one shingle, an empty has none."""
    counts = np.diff(bounds)
    place = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(2 * width)]
    if len(hashes) >= width:
        rolled = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            rolled = mixed(rolled * np.uint64(3) + hashes[k : len(hashes) - width + 1 + k] + place[k])
    else:
        rolled = np.zeros(0, np.uint64)
    full = np.maximum(counts - width + 1, 0)
    sizes = np.where((counts > 0) & (counts < width), 1, full)
    out = np.concatenate([[0], np.cumsum(sizes)])
    result = np.zeros(out[-1], np.uint64)
    long = np.flatnonzero(full > 0)
    if len(long):
        lengths = full[long]
        inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        result[np.repeat(out[long], lengths) + inner] = rolled[np.repeat(bounds[long], lengths) + inner]
    for k in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        h = np.zeros(1, np.uint64)
        for j in range(counts[k]):
            h = mixed(h * np.uint64(5) + hashes[bounds[k] + j] + place[width + j])
        result[out[k]] = h[0]
    return result, out


def distinct_per_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their bounds. Sorts ``values`` in place."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    if not len(values):
        return values, bounds
    new = np.append(True, values[1:] != values[:-1])
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[bounds]
