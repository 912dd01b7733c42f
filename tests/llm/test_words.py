import random
import re

import pyarrow as pa
import pytest

from plumbline.llm.words import BLANKS, NON_WORDS, distinct_per_text, hashed_words, shingles


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize(
    ("table", "pattern", "zero"), [(BLANKS, r"[^\x20\x09-\x0D]+", True), (NON_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", False)]
)
def test_words_and_shingles_equal_plain_python(table, pattern, zero):
    rng = random.Random(3)
    alphabet = [" ", "\t", "a", "B", "é", "\x00", "\n", "c", "\x85", "1", "-", "_", "漢"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, "", "x" * 5000]
    hashes, bounds = hashed_words(pa.array(texts), table, zero)
    words = [re.findall(pattern, lowered(t)) for t in texts]
    assert [len(w) for w in words] == (bounds[1:] - bounds[:-1]).tolist()
    names = {}
    for word, h in zip((w for ws in words for w in ws), hashes.tolist()):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    values, ends = distinct_per_text(*shingles(hashes, bounds, 5))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert [len(s) for s in sets] == (ends[1:] - ends[:-1]).tolist()
    seen = {}
    for k, s in enumerate(sets):
        got = set(values[ends[k] : ends[k + 1]].tolist())
        assert seen.setdefault(frozenset(s), got) == got
    assert len({frozenset(v) for v in seen.values()}) == len(seen)


def test_slices_of_a_column():
    column = pa.array(["zero one", "two", None, "three four five"]).slice(1)
    hashes, bounds = hashed_words(column, BLANKS, True)
    assert (bounds == [0, 1, 1, 4]).all()
    assert hashes[0] == hashed_words(pa.array(["two"]), BLANKS, True)[0][0]
