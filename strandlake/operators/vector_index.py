"""A vector index in files: lists of vectors around centroids (SRC-14, SNK-6, SNK-7, TOP-1)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.knn import best_of, nearest_rows
from strandlake.sources.jsonl import _exists, drop

#: Vectors that the centroids are fitted on at most; vectors of a list that meet queries in one task.
SAMPLE, CHUNK = 20_000, 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Of each row the n nearest centroids, nearest first; ties go to the smaller number."""
    d = (centroids**2).sum(axis=1) - 2 * x @ centroids.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def fitted(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows of the sample; one without rows keeps its place."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(sample[lo : lo + 4096], centroids, 1)[:, 0] for lo in range(0, len(sample), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        count = np.bincount(own, minlength=len(centroids))
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


class VectorIndex:
    """Every vector is stored in the list of its nearest centroid; a search reads the ``probes`` nearest lists.

    The centroids are fitted on at most ``SAMPLE`` vectors, those with the smallest hashes of their ids; all
    vectors are indexed. Vectors have one length; null ones are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.centroids = np.array([r["v"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])

    @staticmethod
    def build(vectors: DataFrame, path: str, lists: int | None = None, seed: int = 3) -> VectorIndex:
        """Writes an index of vectors (id, v); ``lists`` is the root of their number unless given."""
        spark = vectors.sparkSession
        x = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
        lists = lists or max(1, min(4096, round(math.sqrt(x.count()))))
        rows = x.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).collect()
        if not rows:
            raise ValueError("an index needs at least one vector")
        centroids = fitted(np.array([r["v"] for r in rows]), lists, seed)
        made = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, v array<double>")
        made.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        index = VectorIndex(spark, path)
        index._write(x, "overwrite")
        return index

    @staticmethod
    def open_or_build(vectors: DataFrame, path: str, **parameters) -> VectorIndex:
        """The index under a path that names its parameters, built if it is not there."""
        at = path + "".join(f"_{k}={v}" for k, v in sorted(parameters.items()))
        spark = vectors.sparkSession
        return VectorIndex(spark, at) if _exists(spark, f"{at}/vectors/_SUCCESS") else VectorIndex.build(vectors, at, **parameters)

    def _write(self, x: DataFrame, mode: str) -> None:
        centroids = self.centroids

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    own = _nearest(_matrix(batch.column(1)), centroids, 1)[:, 0].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0), batch.column(1)], names=["list", "id", "v"])

        placed = x.mapInArrow(place, "list int, id long, v array<double>")
        # sorted by list, so that a search prunes the rest by the files' statistics
        placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.mode(mode).parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("list int, id long, v array<double>").parquet(f"{self.path}/vectors")

    def append(self, vectors: DataFrame) -> None:
        """Adds vectors (id, v), each to the list of its nearest centroid."""
        self._write(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v is not null"), "append")

    def upsert(self, vectors: DataFrame, path: str) -> VectorIndex:
        """The index with new vectors in place of those with their ids, written to another path."""
        new = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        stay = self.vectors().select("id", "v").join(new.select("id"), "id", "left_anti")
        self.spark.read.parquet(f"{self.path}/centroids").write.mode("overwrite").parquet(f"{path}/centroids")
        other = VectorIndex(self.spark, path)
        other._write(stay.unionByName(new.where("v is not null")), "overwrite")
        return other

    def drop(self) -> None:
        drop(self.spark, self.path)

    def search(self, queries: DataFrame, k: int, probes: int = 8, metric: str = "l2", digits: int = 9) -> DataFrame:
        """qid, rank, id, dist of the k nearest vectors in the ``probes`` lists nearest to each query (qid, v).

        All lists give the exact result. A long list is split, and each part meets the queries that probe it.
        """
        centroids, probes = self.centroids, min(probes, len(self.centroids))

        def probe(batches):
            for batch in batches:
                if batch.num_rows:
                    near = _nearest(_matrix(batch.column(1)), centroids, probes).astype(np.int32)
                    at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), batch.column(0).take(at), batch.column(1).take(at)], names=["list", "key", "v"])

        q = queries.select(F.col("qid").cast("long"), F.col("v").cast("array<double>").alias("v")).where("v is not null").mapInArrow(probe, "list int, key long, v array<double>")
        x = self.vectors()
        chunks = x.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # at most 4,096 rows
        wanted = q.join(F.broadcast(chunks), "list").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "c", "key", "v")
        held = x.join(F.broadcast(chunks), "list").select("list", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("c"), F.col("id").alias("key"), "v")
        part = wanted.groupBy("list", "c").cogroup(held.groupBy("list", "c")).applyInArrow(nearest_rows(k, metric, digits), "qid long, id long, dist double")
        return best_of(part, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """qid, recall: the share of each query's exact neighbours (qid, id) that were found."""
    hit = found.select("qid", "id", F.lit(1.0).alias("hit"))
    return exact.select("qid", "id").join(hit, ["qid", "id"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
