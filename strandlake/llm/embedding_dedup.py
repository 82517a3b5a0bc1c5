"""Operator 5: near-duplicate vectors by random-hyperplane signs, exact cosines and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Stored, join_hot
from strandlake.llm.components import components, local_roots

BLOCK = 1024
#: Vectors of a bucket, about: more need fewer sign bits and so fewer tables, fewer need less comparing.
BUCKET = 128


def tables_for(bits: int, cosine: float, recall: float) -> int:
    """Tables in which a pair at the threshold meets at least once with the wanted probability."""
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, tables * bits))


def codes(x: np.ndarray, planes: np.ndarray, tables: int) -> np.ndarray:
    signs = (x @ planes >= 0).reshape(len(x), tables, -1)
    return signs @ (1 << np.arange(signs.shape[2], dtype=np.int64))


def keyed_runs(batches, n_keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of equal leading columns in sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column of equal length, and their values as a matrix in double precision."""
    lens = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.r_[0, np.cumsum(lens)[:-1]]
    for dim in np.unique(lens).tolist():
        at = np.flatnonzero(lens == dim)
        yield at, flat[start[at][:, None] + np.arange(dim)] if len(at) < len(lens) else flat.reshape(len(lens), dim)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.998, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are first reduced to one with a count. The number of sign bits follows the number
    of distinct vectors, that of tables the wanted recall at the threshold. A bucket of more than
    ``BLOCK`` vectors is split into blocks and each pair of blocks is a task's work of bounded size.
    A block reports link counts per vector and a spanning forest, never its pairs; a pair that meets
    in several tables counts in the first. Null, zero or non-finite vectors, and rows without an id,
    have no links and are their own component; vectors of different lengths never link. Repeated rows
    count as vectors. Other columns are pruned; an empty table gives no rows. The rows are stored; all
    other tables are dropped.
    """
    spark = vectors.sparkSession
    done: list[Stored] = []

    def store(df: DataFrame, name: str) -> DataFrame:
        done.append(Stored(df, name))
        return done[-1].df

    given = vectors.schema["embedding"].dataType.simpleString()
    kind = "float" if given == "array<float>" else "double"
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast(f"array<{kind}>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & fine, F.lit(False)))
    v = v.withColumn("e", F.when(F.col("fine"), F.transform("e", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))))
    distinct = store(v.where("fine").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n = distinct.count()
    bits = min(24, max(4, round(math.log2(max(n, 2) / BUCKET))))
    tables = tables_for(bits, cosine, recall)

    def sign(batches):
        for batch in batches:
            rep = batch.column(1).to_numpy(zero_copy_only=False)
            for at, x in by_length(batch.column(0)):
                c = codes(x, hyperplanes(x.shape[1], tables, bits, seed), tables)
                t = np.tile(np.arange(tables), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(t * 100_003 + x.shape[1]), pa.array(c.ravel()), pa.array(np.repeat(rep[at], tables))], names=["t", "code", "rep"])

    keys = store(distinct.select("e", "rep").mapInArrow(sign, "t long, code long, rep long"), "codes")
    full = store(keys.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    member = join_hot(keys, full, ["t", "code"], n * tables).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    member = member.withColumn("own", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    member = member.select("t", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep")
    block = ["t", "code", "i", "j"]
    filled = member.join(distinct, "rep").select(*block, "own", "rep", "copies", "e")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = filled.repartition(max(least, n * tables // 200_000), *block).sortWithinPartitions(*block)

    def compare(batches):
        for run in keyed_runs(batches, 4):
            table = pa.Table.from_batches(run)
            ((_, x),) = by_length(table.column("e").combine_chunks())
            t = table.column("t")[0].as_py() // 100_003
            own, rep, copies = (table.column(c).to_numpy() for c in ("own", "rep", "copies"))
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
            unit = x / np.linalg.norm(x, axis=1)[:, None]
            near = unit[left] @ unit[right].T >= cosine
            if i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            a, b = left[a], right[b]
            if t and len(a):
                c = codes(x, hyperplanes(x.shape[1], tables, bits, seed)[:, : t * bits], t)
                new = np.ones(len(a), bool)
                for s in range(0, len(a), 100_000):
                    new[s : s + 100_000] = ~(c[a[s : s + 100_000]] == c[b[s : s + 100_000]]).any(axis=1)
                a, b = a[new], b[new]
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
            at = np.flatnonzero(links)
            nodes, roots = local_roots(rep[a], rep[b])
            root = roots[np.searchsorted(nodes, rep[at])]
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(root), pa.array(links[at].astype(np.int64))], names=["rep", "root", "links"])

    found = store(dealt.mapInArrow(compare, "rep long, root long, links long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select("rep", "root")).withColumnsRenamed({"node": "rep"})
    of_rep = distinct.join(counts, "rep", "left").join(groups, "rep", "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    of_rep = store(of_rep.select("e", F.col("copies").alias("n"), links.alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "results")
    linked = join_hot(v.where("fine").select("vec_id", "e"), of_rep, ["e"], v.count()).select("vec_id", "n_links", "component_id")
    alone = v.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    out = Stored(out, "classes").df
    for x in done:
        x.drop()
    return out
