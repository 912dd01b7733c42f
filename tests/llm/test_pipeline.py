import random
import struct
import zlib

import public_tokenizers
import pytest
from test_decontamination import brute as contaminated
from test_jaccard_join import brute as components
from test_mixing import brute as mixed
from test_mixing import size
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import byte_cnn


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean and junk documents, near copies, benchmark passages, empty texts, repeated rows and a column too many."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ther", "ing", "an", "sto", "le", "ra", "di"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(k, prose(rng.randint(5, 30))) for k in range(8)]
    docs, labels = [], []
    for k in range(160):
        junk = k % 4 == 0
        text = " ".join(w + "$$$ " for w in prose(60).split()) if junk else prose(rng.randint(30, 90))
        if k % 10 == 1:
            text += "\n" + items[k % 8][1] + "\n" + prose(20)
        docs.append([k, text, "en", f"s{k % 3}" if k % 7 else None, len(text)])
        labels.append((k, int(not junk)))
    for k in range(40):
        copy = docs[4 * k + 2][1].split(" ")
        copy[k % len(copy)] = "changed" if k % 2 else copy[k % len(copy)]
        docs.append([1000 + k, " ".join(copy), "en", "s1", 1])
    docs += [[2000, None, None, None, None], [2001, "", "en", "s2", 0], docs[5], [None, prose(40), "en", "s0", 3]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_every_stage_equals_brute_force_on_its_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[k] = (before, docs)
    before, after = seen[0][0], rows_of(seen[0][1])
    scores = byte_cnn.quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    bad = {r.doc_id for r in scores if r.predicted == 0}
    assert sorted(after, key=str) == sorted((r for r in before if r[0] not in bad), key=str)
    assert {r[0] for r in after if r[0] is not None and r[0] < 160} == {k for k in range(160) if k % 4}

    before, after = seen[1][0], rows_of(seen[1][1])
    groups = components([r[:2] for r in before])
    lowest = {}
    for row, (_, n, group) in zip(before, groups):
        if n == 0 or row[0] == group:
            lowest[row[:2]] = row
    assert sorted((r[:2] for r in after), key=str) == sorted(lowest, key=str)

    before, after = seen[2][0], rows_of(seen[2][1])
    clean = [r for r, c in zip(before, contaminated([r[:2] for r in before], items, 10)) if not c[-1]]
    assert sorted(after, key=str) == sorted(clean, key=str) and len(after) < len(before)

    before, after = seen[3][0], rows_of(seen[3][1])
    taken, want = {}, {}
    for r in after:
        taken[r[0]] = taken.get(r[0], 0) + size(r[1])
    for doc_id, _, _, _, n in mixed([(r[0], r[1], r[3]) for r in before]):
        if n:
            want[doc_id] = want.get(doc_id, 0) + n
    assert taken == want

    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(seen[4][0], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = [tuple(r) for r in seen[4][1].select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_run_returns_the_index_of_the_records(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 50
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)
