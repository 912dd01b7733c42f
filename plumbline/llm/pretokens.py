"""Byte-level BPE by distinct pre-tokens: NumPy cuts the text, the tokenizers library encodes each distinct piece once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The pre-token contractions of byte-level BPE, by their letters after the apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
UNKNOWN, LETTER, NUMBER, OTHER, SPACE = range(5)
#: Distinct pre-tokens a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 2_000_000
#: Code points cut at once; whole documents, so a longer document makes a longer slice.
SLICE = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _visible() -> dict[int, str]:
    """Byte-level BPE writes a printable byte as itself and the n-th other byte as character 256 + n."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + n) for n, b in enumerate(others)}


VISIBLE = _visible()


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(max(1 << 20, 1 << int(n).bit_length()))
    return up[:n], down[:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each span: polynomial by prefix sums, then mixed with the length."""
    up, down = powers_for(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PretokenEncoder:
    """Token ids of whole texts, equal to ``tokenizer.encode(text, add_special_tokens=False).ids``.

    A pre-token is encoded by the library when it is first seen. Texts that hold an added token (such as the end of
    text mark) go to the library whole. The tokenizer must be byte-level BPE without normaliser or post-processor.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.classes = np.zeros(0x110000, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _classify(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.classes[codes]
        if not kinds.all():
            for code in np.unique(codes[kinds == UNKNOWN]).tolist():
                self.classes[code] = self._kind(chr(code))
            kinds = self.classes[codes]
        return kinds

    def _kind(self, char: str) -> int:
        """The class the library itself gives a character: the one whose run it joins."""
        for kind, mate in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(mate + char)) == 1:
                return kind
        return SPACE

    def starts(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in concatenated texts; ``begins`` are the first places of the non-empty texts."""
        n, kinds = len(codes), self._classify(codes)
        text_start = np.zeros(n + 1, bool)
        text_start[begins] = text_start[n] = True
        cut = np.empty(n + 1, bool)
        cut[1:n] = kinds[1:] != kinds[:-1]
        cut[0] = cut[n] = True
        cut |= text_start
        run_start = cut.copy()
        # the last of several white spaces before a word stands alone, and a plain space joins the word
        space = kinds == SPACE
        before_word = np.flatnonzero(space & run_start[1:] & ~text_start[1:])
        cut[before_word] = True
        joined = before_word[codes[before_word] == 0x20] + 1
        cut[joined] = False
        # an apostrophe that begins a pre-token takes a contraction with it
        quote = np.flatnonzero((codes == 0x27) & cut[:-1] & run_start[:-1] & run_start[1:] & ~text_start[1:])
        for tail in CONTRACTIONS:
            hit = quote[quote + len(tail) < n]
            for k, char in enumerate(tail, 1):
                hit = hit[(codes[hit + k] == ord(char)) & ~text_start[hit + k]]
            cut[hit + 1] = False
            cut[hit + len(tail) + 1] = True
        return np.flatnonzero(cut[:-1])

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        tokenize = self.tokenizer.model.tokenize
        ids = [[token.id for token in tokenize(text.encode().decode("latin-1").translate(VISIBLE))] for text in texts]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        places = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate([self.flat, flat])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.places = np.concatenate([self.places, places])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not len(codes):
            return [np.zeros(0, np.uint32)] * len(texts)
        starts = self.starts(codes, offsets[:-1][sizes > 0])
        ends = np.append(starts[1:], len(codes))
        hashes, first, which = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        new = ~np.isin(hashes, self.known, assume_unique=True)
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBERED:
                self._forget()
                new[:] = True
            joined = "".join(texts)
            self._learn(hashes[new], [joined[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        at = np.searchsorted(self.known, hashes)[which]
        lengths = self.lengths[at]
        stops = np.cumsum(lengths)
        take = np.arange(stops[-1]) + np.repeat(self.places[at] - (stops - lengths), lengths)
        ids = self.flat[take]
        bounds = np.concatenate([[0], stops])[np.searchsorted(starts, offsets)]
        return np.split(ids, bounds[1:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(texts)
        group, size = [], 0
        for k, text in enumerate(texts):
            if any(mark in text for mark in self.added):
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            group.append(k)
            size += len(text)
            if size >= SLICE:
                for place, ids in zip(group, self._slice([texts[g] for g in group])):
                    out[place] = ids
                group, size = [], 0
        if group:
            for place, ids in zip(group, self._slice([texts[g] for g in group])):
                out[place] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> PretokenEncoder:
    return PretokenEncoder(path)
