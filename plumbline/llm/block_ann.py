"""Nearest neighbours by a block matrix join over int8 tiles, with bounds that make it exact.

A vector is written as scale * int8 numbers + an error of known length. The product of two blocks of int8 numbers gives
the distances between the written vectors; the lengths of the two errors bound the true distances from both sides. A
pair whose lower bound is above the k-th smallest upper bound of its query can't be among the k nearest. The others are
measured on the original numbers in double precision and go into a heap of k per query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import kept

#: Queries and candidates of one tile, candidates multiplied at once, numbers of a product that float32 sums exactly.
QUERY_ROWS, TILE_ROWS, STEP, EXACT = 4096, 1024, 512, 1 << 24


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): one row per id with a vector of finite numbers that aren't all zero; the least vector of an id counts."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, lengths of the errors)."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(v / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((v - q * scale[:, None]) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of int8 rows; float32 sums them exactly in runs of EXACT / 127 ** 2 columns."""
    width, out = EXACT // 127**2, np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], width):
        out += a[:, k : k + width].astype(np.float32) @ b[:, k : k + width].astype(np.float32).T
    return out


def tile(queries: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int, float]]:
    """(query id, id, distance) of the k nearest of ``others`` to each query, the query's own id left out."""
    q_ids, q = queries
    ids, v = others
    heaps: list[list] = [[] for _ in q_ids]
    a, a_scale, a_err = quantised(q)
    a_norm = (a.astype(np.int64) ** 2).sum(axis=1) * a_scale**2
    limit = np.full(len(q), np.inf)
    for start in range(0, len(ids), STEP):
        part, w = ids[start : start + STEP], v[start : start + STEP]
        b, b_scale, b_err = quantised(w)
        square = a_norm[:, None] + ((b.astype(np.int64) ** 2).sum(axis=1) * b_scale**2)[None, :] - 2 * products(a, b) * a_scale[:, None] * b_scale[None, :]
        near = np.sqrt(np.maximum(square, 0))
        # rounding of these sums, far below what the errors of int8 numbers are
        slack = a_err[:, None] + b_err[None, :] + 1e-6 * (np.sqrt(a_norm)[:, None] + 1) + 1e-6 * near + 1e-6 * (np.abs(b_scale) * 127 * np.sqrt(v.shape[1]))[None, :]
        low, high = near - slack, near + slack
        high[q_ids[:, None] == part[None, :]] = np.inf
        if len(part) > k:
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
        rows, cols = np.nonzero((low <= limit[:, None]) & (q_ids[:, None] != part[None, :]))
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            exact = np.sqrt(((q[r] - w[c]) ** 2).sum(axis=1))
            for i, j, d in zip(r.tolist(), part[c].tolist(), exact.tolist()):
                entry = (-d, -j)
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], entry)
                elif entry > heaps[i][0]:
                    heapq.heapreplace(heaps[i], entry)
        full = [i for i in range(len(heaps)) if len(heaps[i]) == k]
        if full:
            limit[full] = np.minimum(limit[full], [-heaps[i][0][0] for i in full])
    return [(int(q_ids[i]), -j, -d) for i, heap in enumerate(heaps) for d, j in heap]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("v").combine_chunks()
    ids = table.column("id").to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def nearest(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int = 10) -> DataFrame:
    """query_id, rank, id, distance: the k vectors nearest to each query by Euclidean distance, ties to smaller ids.

    Vectors that are null, zero, or hold null or numbers that aren't finite take no part, nor do rows without an id. Of
    rows that share an id the least vector counts, so repeated rows count once. Vectors are compared with those of their
    own length only. A query is never its own neighbour; with fewer than k others all are returned. Empty tables give no
    rows. Other columns are ignored.

    Queries and vectors are dealt into blocks of bounded size by a hash of their ids; a tile is one block of each.
    """
    base = kept(usable(vectors, id_column, vector_column).withColumn("width", F.size("v")), "vectors")
    asked = kept(usable(queries, id_column, vector_column).withColumn("width", F.size("v")), "queries")
    tiles = -(-base.count() // TILE_ROWS) or 1
    groups = -(-asked.count() // QUERY_ROWS) or 1
    left = asked.select("id", "v", "width", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("b"))
    right = base.select("id", "v", "width", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("a"), F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("b"))
    key = [F.col(c).cast("long").alias(c) for c in ("a", "b", "width")]

    def search(own: pa.Table, other: pa.Table) -> pa.Table:
        found = tile(_matrix(own), _matrix(other), k) if own.num_rows and other.num_rows else []
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "distance": pa.array(columns[2], pa.float64())})

    pairs = left.select(*key, "id", "v").groupBy("a", "b", "width").cogroup(right.select(*key, "id", "v").groupBy("a", "b", "width"))
    found = pairs.applyInArrow(search, "query_id long, id long, distance double")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(rows["distance"].tolist(), rows["id"].tolist()))
        return pd.DataFrame([(rows["query_id"].iloc[0], n, i, d) for n, (d, i) in enumerate(best, 1)], columns=["query_id", "rank", "id", "distance"])

    return found.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, id long, distance double")
