import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import spelling


def plain_words(rows, delete_every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if delete_every and doc_id is not None and h % delete_every == 0:
                run = "".join(c for k, c in enumerate(run) if k != h % len(run))
            counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(rows, delete_every=0):
    words = {w: n for w, n in plain_words(rows, delete_every).items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    letters = "abcdeÉßéü÷×ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaaa", "aabbaa", "abababab"]
    rows = []
    for k in range(n):
        out = []
        for _ in range(rng.randint(0, 60)):
            w = base[int(rng.random() ** 3 * len(base))]
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]])
            out.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((k, rng.choice([" ", ", ", "\n", "1"]).join(out)))
    return rows


@pytest.mark.parametrize(("seed", "blocks", "delete_every"), [(1, 1 << 19, 0), (2, 4, 7), (3, 1, 97)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, blocks, delete_every):
    monkeypatch.setattr(spelling, "FILTER_BLOCKS", blocks)  # filters far too small let more through, never less
    monkeypatch.setattr(spelling, "PROBES", 200)
    rows = corpus(seed, 150) + [(500, None), (501, ""), (502, "12 - 3"), (None, "aaaaaa aaaaaa aaaaaa"), (None, None)]
    long = "ab" * 300
    rows += [(600, f"{long} {long} {long}x"), (601, f"{long}x {long}x {long}x {long}"), (601, f"{long} {long} {long} {long} {long} {long}")]
    rows += [(700, " ".join("chainxyz"[: 6 + k] for k in range(3) for _ in range(4 * 3**k)))]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(6)
    got = spelling.spelling_groups(docs, delete_every=delete_every)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_groups(rows, delete_every)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_an_empty_table_and_a_table_without_neighbours(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "entirely entirely entirely different different different tiny tiny tiny")], "doc_id long, text string")
    assert sorted(map(tuple, spelling.spelling_groups(docs).collect())) == [("different", None, "different", 3, 0, None), ("entirely", None, "entirely", 3, 0, None)]


def test_counts_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    rows = corpus(4, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.word: r.n for r in spelling.word_counts(docs, 5).collect()}
    want = plain_words(rows, 5)
    want.pop("", None)
    assert got == dict(want)


def test_a_long_chain_of_forms(spark):
    links = [(f"w{k:03}", f"w{k + 1:03}") for k in range(37)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert set(got.values()) == {"w037"} and len(got) == 37


def test_probes_find_all_edits_and_few_others():
    rng = np.random.default_rng(1)
    words = list({"".join(map(chr, rng.choice(spelling.LETTERS[:26], 8))) for _ in range(4000)})
    codes = next(spelling.by_length(words))[2]
    hashes = (spelling.letter_hashes(codes) * spelling.weights(8)[0]).sum(axis=1, dtype=np.uint64)
    table = np.zeros((256, 8), np.uint32)
    block, low = spelling.places(hashes, 8, 256)
    for lane in range(8):
        np.bitwise_or.at(table[:, lane], block, spelling.lane_bits(low, lane))
    assert len(spelling.held(table, hashes, 8)) == len(words)
    assert len(spelling.held(table, hashes + np.uint64(12345), 8)) < 0.02 * len(words)
    known = {8: table}
    edited = codes.copy()
    edited[:, 3] = spelling.LETTERS[0]
    hit = {(int(r), i, int(c)) for rows, i, letters in spelling.probed(edited, known) for r, c in zip(rows, letters)}
    later = [k for k, w in enumerate(words) if w[3] > "a"]
    assert all((k, 3, ord(words[k][3])) in hit for k in later)
