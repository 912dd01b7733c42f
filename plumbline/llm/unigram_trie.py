"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The distinct pre-tokens that a task sees go into a trie, kept as sorted strings with the lengths of the prefixes they
share. The forward score of a prefix, the best sum of piece scores that spells it, and the number of pieces on that way
are computed once per trie node, a level of the trie at a time; the numbers at the ends are the counts of pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pretokens import powers_for
from plumbline.llm.words import BLANKS, hashed_words, row_slices, utf8, word_spans

#: The mark of a word's beginning in piece vocabularies.
SPACE = "▁"
#: Pre-tokens with more characters are walked alone; distinct pre-tokens that a worker remembers.
LONG, REMEMBERED = 128, 2_000_000
#: Log-probability of a character without a piece, below that of the rarest piece.
UNKNOWN_STEP = 10.0


def piece_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model with log-probabilities by Zipf's law over their order in the file.

    The file ranks its pieces by merges and holds no probabilities; control and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    total = np.log((1 / np.arange(1, len(plain) + 1)).sum())
    return {model.id_to_piece(k): float(-np.log(rank) - total) for rank, k in enumerate(plain, 1)}


def span_keys(starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, down: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * down[starts]


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers_for(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class UnigramCounter:
    """Pieces on the best way through pre-tokens; a character without a piece counts its UTF-8 bytes.

    Of ways with equal scores the one with the longer last piece counts.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = {p: s for p, s in scores.items() if p}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_STEP
        self.longest = max(map(len, self.scores), default=1)
        self.by_length = {}
        for n in sorted({len(p) for p in self.scores}):
            pieces = [p for p in self.scores if len(p) == n]
            codes = code_points("".join(pieces))
            at = np.arange(len(pieces)) * n
            sums, down = prefix_sums(codes)
            keys = span_keys(at, at + n, sums, down)
            order = np.argsort(keys)
            self.by_length[n] = keys[order], np.array([self.scores[p] for p in pieces])[order]

    def walk(self, word: str) -> int:
        """The count of one pre-token, character by character."""
        best, counts = [0.0], [0]
        for end in range(1, len(word) + 1):
            top = best[end - 1] + self.unknown
            count = counts[end - 1] + len(word[end - 1].encode())
            for n in range(1, min(end, self.longest) + 1):
                score = self.scores.get(word[end - n : end])
                if score is not None and best[end - n] + score >= top:
                    top, count = best[end - n] + score, counts[end - n] + 1
            best.append(top)
            counts.append(count)
        return counts[-1]

    def trie(self, words: list[str]) -> np.ndarray:
        """The counts of distinct, sorted pre-tokens; every shared prefix is scored once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = code_points("".join(words))
        starts = np.cumsum(lengths) - lengths
        sums, down = prefix_sums(codes)
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        # characters that a word shares with the one before it
        shared = np.zeros(len(words), np.int64)
        live = np.arange(1, len(words))
        for depth in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > depth) & (lengths[live - 1] > depth)]
            live = live[codes[starts[live] + depth] == codes[starts[live - 1] + depth]]
            if not len(live):
                break
            shared[live] = depth + 1
        # the last levels: score and count of the prefix of each word
        ring = self.longest + 1
        best, counts = np.zeros((ring, len(words))), np.zeros((ring, len(words)), np.int64)
        result = np.zeros(len(words), np.int64)
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            active = np.flatnonzero(lengths >= depth)
            new = shared[active] < depth
            nodes = active[new]
            ends = starts[nodes] + depth
            top = best[(depth - 1) % ring, nodes] + self.unknown
            count = counts[(depth - 1) % ring, nodes] + width[ends - 1]
            for n, (keys, scores) in self.by_length.items():
                if n > depth:
                    break
                wanted = span_keys(ends - n, ends, sums, down)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == wanted)
                score = best[(depth - n) % ring, nodes[hit]] + scores[at[hit]]
                better = score >= top[hit]
                hit, score = hit[better], score[better]
                top[hit] = score
                count[hit] = counts[(depth - n) % ring, nodes[hit]] + 1
            node = np.cumsum(new) - 1
            best[depth % ring, active], counts[depth % ring, active] = top[node], count[node]
            ended = active[lengths[active] == depth]
            result[ended] = counts[depth % ring, ended]
        return result

    def counts(self, words: list[str]) -> np.ndarray:
        """The count of each pre-token."""
        order = sorted(range(len(words)), key=words.__getitem__)
        short = [k for k in order if len(words[k]) <= LONG]
        out = np.zeros(len(words), np.int64)
        if short:
            distinct, place = [], np.zeros(len(short), np.int64)
            for n, k in enumerate(short):
                if not distinct or distinct[-1] != words[k]:
                    distinct.append(words[k])
                place[n] = len(distinct) - 1
            out[short] = self.trie(distinct)[place]
        for k in order:
            if len(words[k]) > LONG:
                out[k] = self.walk(words[k])
        return out


class Remembered:
    """Counts of pre-tokens by their hash, so that a worker puts a pre-token in a trie once."""

    def __init__(self, path: str):
        self.counter = UnigramCounter(piece_scores(path))
        self.known, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of every text of a column."""
        hashes, bounds = hashed_words(column, BLANKS, byte_zero=True, fold=False)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.known, assume_unique=True)
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBERED:
                self.known, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                new[:] = True
            buf, offsets = utf8(column)
            codes = BLANKS[buf]
            starts, ends = word_spans(codes, (codes != 0) | (buf == 0), offsets)
            data = buf.tobytes()
            words = [SPACE + data[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            known = np.concatenate([self.known, distinct[new]])
            values = np.concatenate([self.values, self.counter.counts(words)])
            order = np.argsort(known, kind="stable")
            self.known, self.values = known[order], values[order]
        each = self.values[np.searchsorted(self.known, distinct)][which] if len(distinct) else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(each)])
        return np.diff(bounds), sums[bounds[1:]] - sums[bounds[:-1]]


@lru_cache(maxsize=2)
def remembered(path: str) -> Remembered:
    return Remembered(path)


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row of ``docs`` (doc_id, text) under the pieces of ``model``.

    Pre-tokens are runs of characters other than space and 09 to 0D, each behind the mark of a word's beginning. Null
    and empty texts have none. Repeated rows are rows of their own, null doc_ids stay null, an empty table gives no rows.
    Other columns are ignored. Documents don't move: every task counts its own distinct pre-tokens.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = remembered(model)
        for batch in (part for whole in batches for part in row_slices(whole, 1)):
            pretokens, tokens = memory.of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pretokens.astype(np.int64)), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
