"""Quality classifier: a byte-level convolutional network in NumPy.

A text is cut into overlapping chunks of 1,024 bytes that cover all of it. In a chunk every filter looks at six bytes in
a row and at a second plane that says how much of what follows repeats what stood shortly before; its largest value in
the chunk is kept. The largest and the mean of each filter over the chunks of a document give one probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.words import utf8

CHUNK, STRIDE, WIDTH, FILTERS = 1024, 896, 6, 8
#: The plane of repetition: a run of eight bytes that stood up to 40 bytes before, averaged over the next 64 bytes.
RUN, LAGS, SPREAD = 8, 40, 64
#: Chunks scored at once.
ROWS = 256


@dataclass
class Network:
    """table: filter x place x byte; repeats: filter; peak, mean: weights of the pooled filters; base: the free term."""

    table: np.ndarray
    repeats: np.ndarray
    shift: np.ndarray
    peak: np.ndarray
    mean: np.ndarray
    base: np.ndarray

    def names(self):
        return ("table", "repeats", "shift", "peak", "mean", "base")


def chunk_places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first byte) of the chunks of texts with so many bytes; an empty text has one chunk."""
    counts = 1 + np.maximum(0, -(-(lengths - CHUNK) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), counts)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE


def chunk_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of CHUNK bytes from each start, 0 from the end of its text on."""
    at = starts[:, None] + np.arange(CHUNK)[None, :]
    rows = np.append(buf, np.uint8(0))[np.minimum(at, len(buf))]
    rows[at >= ends[:, None]] = 0
    return rows


def repetition(rows: np.ndarray) -> np.ndarray:
    """The second plane, 0 to 1."""
    n = len(rows)
    wide = np.zeros((n, LAGS + CHUNK + RUN), np.uint8)
    wide[:, LAGS : LAGS + CHUNK] = rows
    flat = wide.ravel()
    runs = np.ndarray((flat.size - RUN + 1,), "<u8", flat, strides=(1,)).copy()
    runs = np.append(runs, np.zeros(RUN - 1, np.uint64)).reshape(n, -1)
    here = runs[:, LAGS : LAGS + CHUNK]
    again = np.zeros((n, CHUNK), bool)
    for lag in range(1, LAGS + 1):
        again |= here == runs[:, LAGS - lag : LAGS - lag + CHUNK]
    again &= rows != 0
    sums = np.zeros((n, CHUNK + SPREAD + 1), np.int32)
    np.cumsum(again, axis=1, out=sums[:, 1 : CHUNK + 1])
    sums[:, CHUNK + 1 :] = sums[:, CHUNK : CHUNK + 1]
    return ((sums[:, SPREAD : SPREAD + CHUNK] - sums[:, :CHUNK]) / np.float32(SPREAD)).astype(np.float32)


def pairs_of(rows: np.ndarray) -> np.ndarray:
    """Two bytes in a row as one number, for WIDTH - 1 places beyond the chunk as well."""
    wide = np.zeros((len(rows), CHUNK + WIDTH), np.uint16)
    wide[:, :CHUNK] = rows
    return wide[:, :-1] << 8 | wide[:, 1:]


def pooled(net: Network, rows: np.ndarray, plane: np.ndarray, where: bool = False):
    """The largest value of each filter in each chunk, 0 at least, and with ``where`` its place."""
    pairs = pairs_of(rows)
    best = np.empty((len(rows), FILTERS), np.float32)
    places = np.empty((len(rows), FILTERS), np.int64)
    for f in range(FILTERS):
        z = plane * net.repeats[f]
        for k in range(0, WIDTH, 2):
            both = (net.table[f, k][:, None] + net.table[f, k + 1][None, :]).ravel().astype(np.float32)
            z += both[pairs[:, k : k + CHUNK]]
        z += net.shift[f]
        if where:
            places[:, f] = z.argmax(axis=1)
            best[:, f] = z[np.arange(len(rows)), places[:, f]]
        else:
            best[:, f] = z.max(axis=1)
    return (np.maximum(best, 0), places) if where else np.maximum(best, 0)


def combined(net: Network, active: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, largest activity, mean activity) per text from the activities of its chunks."""
    first = np.searchsorted(text, np.arange(n))
    peak = np.maximum.reduceat(active, first, axis=0)
    mean = np.add.reduceat(active, first, axis=0) / np.diff(np.append(first, len(text)))[:, None]
    return 1 / (1 + np.exp(-(net.base[0] - peak @ net.peak - mean @ net.mean))), peak, mean


def scores(net: Network, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One probability for each text of a UTF-8 buffer."""
    text, start = chunk_places(np.diff(offsets))
    if not len(text):
        return np.zeros(0)
    active = np.empty((len(text), FILTERS), np.float32)
    for k in range(0, len(text), ROWS):
        part = slice(k, k + ROWS)
        rows = chunk_bytes_at(buf, offsets, text[part], start[part])
        active[part] = np.tanh(pooled(net, rows, repetition(rows)))
    return combined(net, active, text, len(offsets) - 1)[0]


def chunk_bytes_at(buf: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    a, b = offsets[text] + start, offsets[text + 1]
    low, high = int(a.min()), int(min(len(buf), a.max() + CHUNK))
    return chunk_bytes(buf[low:high], a - low, np.minimum(b, high) - low)


def train(windows: np.ndarray, text: np.ndarray, labels: np.ndarray, epochs: int = 30, seed: int = 5) -> Network:
    """Fit a network by Adam on chunks (rows of bytes) of labelled texts; ``text`` ascends and numbers the labels."""
    rng = np.random.default_rng(seed)
    # filters begin at how much more frequent a byte is in texts of label 0, with noise that tells them apart
    bad = labels[text] == 0
    odds = [np.bincount(windows[side].ravel(), minlength=256)[:256] + 5.0 for side in (bad, ~bad)]
    for counts in odds:
        counts[0] = 1
    odds = np.clip(np.log(odds[0] / odds[0].sum()) - np.log(odds[1] / odds[1].sum()), -2, 2)
    odds[0] = 0
    table = (odds[None, None, :] * rng.uniform(0, 0.2, (FILTERS, WIDTH, 1)) + rng.normal(0, 0.03, (FILTERS, WIDTH, 256))).astype(np.float32)
    table[:, :, 0] = 0
    some = np.linspace(0.2, 1.5, FILTERS, dtype=np.float32)
    net = Network(table, some[::-1].copy(), np.full(FILTERS, -0.3, np.float32), np.full(FILTERS, 0.3, np.float32), np.full(FILTERS, 0.3, np.float32), np.array([1.0], np.float32))
    plane = np.concatenate([repetition(windows[k : k + ROWS]) for k in range(0, len(windows), ROWS)])
    wide = np.zeros((len(windows), CHUNK + WIDTH), np.uint8)
    wide[:, :CHUNK] = windows
    n = len(labels)
    weight = np.where(labels == 0, 0.5 / max(1, (labels == 0).sum()), 0.5 / max(1, (labels == 1).sum())) * n
    moments = {k: [np.zeros_like(getattr(net, k), dtype=np.float64) for _ in range(2)] for k in net.names()}
    bounds, step = np.searchsorted(text, np.arange(n + 1)), 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 64):
            chosen = np.sort(order[k : k + 64])
            rows = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in chosen])
            local = np.repeat(np.arange(len(chosen)), bounds[chosen + 1] - bounds[chosen])
            raw, places = pooled(net, windows[rows], plane[rows], where=True)
            active = np.tanh(raw)
            score, peak, mean = combined(net, active, local, len(chosen))
            slope = (score - labels[chosen]) * weight[chosen] / len(chosen)
            share = 1 / np.diff(np.append(np.searchsorted(local, np.arange(len(chosen))), len(local)))
            pull = -(slope[:, None] * net.mean[None, :] * share[:, None])[local] - np.where(active == peak[local], (slope[:, None] * net.peak[None, :])[local], 0)
            pull *= (1 - active**2) * (raw > 0)
            grads = {"base": np.array([slope.sum()]), "peak": -(slope @ peak), "mean": -(slope @ mean), "shift": pull.sum(0)}
            grads["repeats"] = (pull * plane[rows[:, None], places]).sum(0)
            grads["table"] = np.zeros(net.table.shape)
            for j in range(WIDTH):
                seen = wide[rows[:, None], places + j]
                for f in range(FILTERS):
                    grads["table"][f, j] = np.bincount(seen[:, f], pull[:, f], 256)
            grads["table"][:, :, 0] = 0
            step += 1
            for name, grad in grads.items():
                m, v = moments[name]
                grad = grad + 1e-4 * getattr(net, name)
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                rate = 0.03 * (1 - epoch / epochs) + 0.002
                getattr(net, name)[...] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def remainder(doc_id):
    """crc32 of the doc_id as text, modulo 5: rows with 0 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def sample_windows(docs: DataFrame, labels: DataFrame, per_label: int, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of at most ``per_label`` labelled texts of either label, at most ``windows`` spread over each text.

    The sample is bounded by its parameters: 2 * per_label * windows chunks reach the driver. Held-out rows, null labels
    and doc_ids with both labels are left out.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("low"), F.max("quality").alias("label")).where("low = label").drop("low")
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            text, start = chunk_places(np.diff(offsets))
            of = np.searchsorted(text, np.arange(batch.num_rows + 1))
            out = []
            for k in range(batch.num_rows):
                at = np.unique(np.linspace(of[k], of[k + 1] - 1, windows).astype(np.int64))
                out.append(chunk_bytes_at(buf, offsets, text[at], start[at]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "chunks"])

    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null").join(F.broadcast(chosen), "id")
    rows = texts.select("id", F.col("label").cast("int"), "text").mapInArrow(cut, "id long, label int, chunks binary").collect()
    rows = sorted({(r["id"], r["label"], bytes(r["chunks"])) for r in rows})
    data = [np.frombuffer(r[2], np.uint8).reshape(-1, CHUNK) for r in rows]
    text = np.repeat(np.arange(len(rows)), [len(d) for d in data])
    return np.concatenate(data) if data else np.zeros((0, CHUNK), np.uint8), text, np.array([r[1] for r in rows], np.int64)


def fitted(docs: DataFrame, labels: DataFrame, per_label: int = 600, windows: int = 4) -> Network | float:
    """The network, or a constant score where labels of one kind only (or none: 0.5) are known."""
    rows, text, known = sample_windows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels.withColumn("doc_id", F.col("doc_id").cast("long")), per_label, windows)
    if len(set(known.tolist())) < 2:
        return float(known[0]) if len(known) else 0.5
    return train(rows, text, known)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def scored(docs: DataFrame, net: Network | float) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is the second value: the score of every whole text."""
    name = _free("score", docs.columns)
    model = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            value = scores(net, *utf8(batch.column(at))) if isinstance(net, Network) else np.full(batch.num_rows, net)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value.astype(np.float64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_label: int = 600, windows: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    The network learns ``labels`` (doc_id, quality) of a bounded sample of rows that aren't held out; it sees bytes only.
    score is the probability of label 1, predicted is 1 from ``threshold`` on.

    A null text is empty; empty texts are scored like others. A null doc_id is hashed as empty text. Repeated rows get
    equal scores. Labels that are null or contradict each other are not learnt from; with labels of one kind every score
    is that label, without labels 0.5. An empty table gives no rows. Other columns are ignored.
    """
    rows, name = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted(docs, labels, per_label, windows))
    return rows.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    rows, name = scored(docs, fitted(docs, labels))
    return rows.where(F.col(name) >= threshold).select(*docs.columns)
