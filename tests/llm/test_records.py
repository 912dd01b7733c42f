import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import pretokens, records

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(tokenizer, monkeypatch):
    monkeypatch.setattr(pretokens, "REMEMBERED", 3000)  # the memory is emptied on the way
    monkeypatch.setattr(pretokens, "SLICE", 5000)
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "1", "²", "é", "!", "?", "\xa0", "\x1c", "\x85", "漢", "😀", "'s", "'ll", " '", "it's", "́", "٣", "x", "\r\n", "　", "\x00", "'S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += ["", " ", "<|endoftext|> hi", "a<|endoftext|>", "end ", "a" * 3000, " " * 3000 + "b"]
    got = pretokens.PretokenEncoder(PATH).encode(texts)
    for text, ids in zip(texts, got):
        assert tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)


ROWS = [(i, f"Text number {i}. " * (i % 9)) for i in range(300)] + [(-5, None), (7, "same id"), (7, "same id"), (None, "no id"), (9000, "long " * 60000), (9001, "<|endoftext|>")]


def expected(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_round_trip(spark, tokenizer, monkeypatch):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id long, text string, file string, start int").repartition(5)
    monkeypatch.setattr(records.write_records, "__defaults__", (2, 1 << 14))
    folder, index = records.export(docs, PATH)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in index.collect()]
    key = lambda r: (r[1], r[0] or 0)
    assert sorted(got, key=key) == sorted(expected(tokenizer, ROWS), key=key)
    assert index.select("file").distinct().count() > 1
    some = records.shuffled(index, 3).limit(25)
    by_offset = {(r.file, r.at): r for r in records.read_records(spark, folder, some).collect()}
    assert len(by_offset) == 25
    for r in index.join(some.select("file", "at"), ["file", "at"]).collect():
        ids = by_offset[r.file, r.at].ids
        assert by_offset[r.file, r.at].doc_id == r.doc_id and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32
    assert records.read_records(spark, folder).count() == len(ROWS)
    assert [r.at for r in records.shuffled(index, 3).limit(9).collect()] == [r.at for r in records.shuffled(index, 3).limit(9).collect()]


def test_empty_table(spark):
    _, index = records.export(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert index.collect() == []


@pytest.mark.parametrize("at", [0, 9, 13, 20, -2, -1])
def test_damage_is_seen(at):
    data = bytearray(records.frame(5, np.arange(10), 2) + records.CLOSE)
    assert [(d, i.tolist()) for _, _, d, i in records.frames(bytes(data))] == [(5, list(range(10)))]
    data[at] ^= 1
    with pytest.raises(records.CorruptRecord):
        list(records.frames(bytes(data)))
    with pytest.raises(records.CorruptRecord):
        list(records.frames(bytes(data[:-3])))


def test_files_are_in_the_order_of_their_numbers(spark):
    files = [f"part-{k}-x.txt" for k in ("00000", "99999", "100000", "100001")]
    index = spark.createDataFrame([(f, i, 10) for f in files for i in (0, 10)], "file string, in_file long, n_tokens long")
    got = {(r.file, r.in_file): r.start for r in records.with_starts(index.repartition(3)).collect()}
    assert [got[f, i] for f in files for i in (0, 10)] == list(range(0, 80, 10))
