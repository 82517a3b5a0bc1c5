"""Nearest neighbours (TOP-1, TOP-2, TOP-5, TOP-6, WIN-1, JOIN-4, JOIN-9, RAG-9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
#: Queries whose distances are held at a time.
ROWS = 64
CHUNK_BYTES = 16 << 20
#: Numbers of vectors and of distances that are worked on at a time.
SLICE = 1 << 18


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.stack([((x - v) ** 2).sum(axis=1) for v in q])
    if metric == "cosine":
        return 1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    if metric == "dot":
        return -(q @ x.T)
    raise ValueError(f"unknown metric {metric!r}")


def nearest_rows(k: int, metric: str, digits: int):
    """A function of two Arrow tables (key, v), queries and vectors, that gives the k nearest of each query: qid, id, dist."""

    def nearest(a, b):
        ids, keys = b.column("key").to_numpy(), a.column("key").to_numpy()
        if not len(ids) or not len(keys):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        v, x = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (a, b))
        step = max(1, SLICE // max(ROWS, x.shape[1]))
        rows = []
        for lo in range(0, len(keys), ROWS):
            some = keys[lo : lo + ROWS]
            best = [(ids[:0], np.empty(0))] * len(some)
            for at in range(0, len(x), step):
                d = np.round(distances(v[lo : lo + ROWS], x[at : at + step], metric), digits) + 0.0  # no negative zero
                for i, row in enumerate(d):
                    who, row = np.concatenate([best[i][0], ids[at : at + step]]), np.concatenate([best[i][1], row])
                    # all ties of the k-th, of which the smaller ids stay
                    last = np.partition(row, k - 1)[k - 1] if 0 < k < len(row) else np.nan
                    near = np.arange(len(row)) if np.isnan(last) else np.flatnonzero(row <= last)
                    near = near[np.lexsort((who[near], row[near]))[:k]]
                    best[i] = who[near], row[near]
            rows += [(np.repeat(key, len(who)), who, row) for key, (who, row) in zip(some, best, strict=True)]
        key, who, dist = (np.concatenate(c) for c in zip(*rows, strict=True))
        return pa.table({"qid": pa.array(key, pa.int64()), "id": pa.array(who, pa.int64()), "dist": pa.array(dist, pa.float64())})

    return nearest


def best_of(part: DataFrame, k: int) -> DataFrame:
    """qid, rank, id, dist: of partial neighbours the k nearest, ties to the smaller id."""
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", digits: int = 9, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Exact k nearest vectors of each query: qid, rank, id, dist.

    ``queries`` (qid, v) and ``vectors`` (id, v). Vectors are dealt into chunks of about
    ``chunk_bytes``, whatever their length, queries into blocks of about ``BLOCK``; each block meets each chunk once, as a matrix product, and hands on k rows a
    query. Distances are rounded and ties go to the smaller id. Null vectors are left out.
    """
    if metric not in ("l2", "cosine", "dot"):
        raise ValueError(f"unknown metric {metric!r}")
    q = queries.select("qid", F.col("v").cast("array<double>").alias("v")).where("v is not null")
    x = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where("v is not null")
    values = x.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks, chunks = max(1, -(-q.count() // BLOCK)), max(1, -(-8 * values // chunk_bytes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("b"), every(chunks).alias("c"), F.col("qid").alias("key"), "v")
    right = x.select(every(blocks).alias("b"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("c"), F.col("id").alias("key"), "v")
    part = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(nearest_rows(k, metric, digits), "qid long, id long, dist double")
    return best_of(part, k)


def topk_lists(neighbours: DataFrame, k: int | None = None) -> DataFrame:
    """qid and its ids in rank order, of at most k ranks (a sweep over k reads one search)."""
    rows = neighbours if k is None else neighbours.where(F.col("rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return rows.groupBy("qid").agg(F.transform(ordered, lambda s: s["id"]).alias("doc_ids"))


def lookup(neighbours: DataFrame, corpus: DataFrame) -> DataFrame:
    """Texts of neighbours; ids that are not in the corpus, such as padding, give no row."""
    return neighbours.join(corpus, neighbours["id"] == corpus["chunk_id"]).drop("chunk_id")
