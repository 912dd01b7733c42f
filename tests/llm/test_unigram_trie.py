import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from plumbline.llm import unigram_trie
from plumbline.llm.unigram_trie import Remembered, UnigramCounter

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    return UnigramCounter(unigram_trie.piece_scores(MODEL))


def random_words(n, seed):
    rng = random.Random(seed)
    parts = ["▁", "t", "h", "e", "th", "ing", "é", "漢", "😀", "a", "ou", "ê"]
    return ["▁" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_trie_equals_walking_and_the_library(counter):
    words = random_words(3000, 2) + ["▁" + "thing" * 100]
    got = counter.counts(words).tolist()
    assert got == [counter.walk(w) for w in words]
    pieces = [("<unk>", 0.0), *counter.scores.items(), *((f"<0x{b:02X}>", -99.0) for b in range(256))]
    library = Tokenizer(models.Unigram(pieces, 0, True))
    assert got == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_small_vocabulary_by_all_ways():
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "abb": -3.2, "ba": -2.2}
    counter = UnigramCounter(scores)

    def ways(word):
        if not word:
            yield 0.0, 0
        for n in range(1, len(word) + 1):
            if word[:n] in scores:
                for s, c in ways(word[n:]):
                    yield s + scores[word[:n]], c + 1

    words = ["".join(random.Random(k).choice("ab") for _ in range(1 + k % 9)) for k in range(200)]
    for word, count in zip(words, counter.counts(words)):
        best = max(s for s, _ in ways(word))
        assert count in {c for s, c in ways(word) if abs(s - best) < 1e-9}


def test_table(spark, counter):
    texts = [" ".join(random_words(30, k)).replace("▁", " ") for k in range(40)] + [None, "", " \t\n", "x" * 400, "Case case CASE", "nul\x00l"]
    rows = [(k, t, 1, "n") for k, t in enumerate(texts)] + [(3, texts[3], 2, "n"), (None, "a b", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_pretokens string")
    got = sorted((tuple(r) for r in unigram_trie.token_counts(docs, MODEL).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want.append((doc_id, len(words), sum(counter.walk("▁" + w) for w in words)))
    assert got == sorted(want, key=str)
    assert unigram_trie.token_counts(docs.limit(0), MODEL).collect() == []


def test_memory_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(unigram_trie, "REMEMBERED", 50)
    memory = Remembered(MODEL)
    texts = [" ".join(random_words(40, k)) for k in range(9)]
    once = [memory.of(pa.array([t]))[1][0] for t in texts]
    assert len(memory.known) <= 50 and once == Remembered(MODEL).of(pa.array(texts))[1].tolist()
