import zlib

import numpy as np
import pyarrow as pa

from plumbline.llm import byte_cnn
from plumbline.llm.words import utf8

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in byte_cnn.quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    held = [(r.quality, rows[r.doc_id]) for r in labels.collect() if r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40 and all(r.held_out for _, r in held)
    assert np.mean([q == r.predicted for q, r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def net():
    rng = np.random.default_rng(2)
    windows = np.zeros((40, byte_cnn.CHUNK), np.uint8)
    for k in range(40):
        text = (b"ab$$ cd$$ " if k % 2 else b"plain words ") * 90
        windows[k, : len(text)] = np.frombuffer(text, np.uint8)[: byte_cnn.CHUNK]
    return byte_cnn.train(windows, np.arange(40), 1 - np.arange(40) % 2, epochs=8, seed=int(rng.integers(9)))


def test_scores_cover_the_whole_text_and_not_its_neighbours():
    model = net()
    texts = ["plain words " * 50, None, "", "plain words " * 3000 + "ab$$ cd$$ " * 200, "x", "plain words " * 3000, "é" * 700]
    together = byte_cnn.scores(model, *utf8(pa.array(texts)))
    alone = [byte_cnn.scores(model, *utf8(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)
    assert together[3] < together[5]  # what stands 36,000 bytes behind counts


def test_chunks_cover_every_byte():
    for n in (0, 1, 1023, 1024, 1025, 1920, 1921, 50000):
        _, starts = byte_cnn.chunk_places(np.array([n]))
        seen = np.zeros(max(n, 1), bool)
        for s in starts:
            seen[s : s + byte_cnn.CHUNK] = True
        assert seen.all() and (np.diff(starts) < byte_cnn.CHUNK).all()


def test_repeated_runs_are_seen():
    rows = np.zeros((2, byte_cnn.CHUNK), np.uint8)
    for k, text in enumerate((b"again again again " * 40, bytes(np.random.default_rng(0).integers(97, 122, 720).astype(np.uint8)))):
        rows[k, : len(text)] = np.frombuffer(text, np.uint8)
    plane = byte_cnn.repetition(rows)
    assert plane[0, 100] == 1 and plane[1].max() < 0.1 and plane[:, 1000].max() == 0


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (1, "a", "t"), (None, None, None), (3, "", "u")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(5, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in byte_cnn.quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (3, 0), (1, 1)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in byte_cnn.quality(docs, one).collect()} == {(1.0, 1)}
    assert byte_cnn.quality(docs.limit(0), one).collect() == []
    kept = byte_cnn.accepted(docs, one)
    assert kept.columns == docs.columns and kept.count() == 4


def test_contradicting_labels_are_left_out(spark):
    docs = spark.createDataFrame([(k, "good text") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(50)] + [(k, 0) for k in range(50)], "doc_id long, quality int")
    assert byte_cnn.fitted(docs, labels) == 0.5
