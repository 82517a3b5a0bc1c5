"""Connected components of an edge table, distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Stored, join_hot


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the smallest node that each reaches through them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


#: Edges that one task contracts at a time.
TASK_EDGES = 1_000_000


def _contract(batches):
    """A partition's edges as stars around their smallest nodes: never more rows than nodes."""
    held, size, most = [], 0, TASK_EDGES
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
        size += batch.num_rows
        if size > most:
            held = [np.stack(local_roots(*np.concatenate(held, axis=1)))]
            size = held[0].shape[1]
            most = size + TASK_EDGES
    if held:
        nodes, roots = local_roots(*np.concatenate(held, axis=1))
        other = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(roots[other])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    ``edges`` has two long columns. Tasks contract their own edges, as many tasks as the edges need at
    ``TASK_EDGES`` each. Where one task was enough, that is the result. Else rounds of large-star and
    small-star (Kiveris et al. 2014) run, each written to the shared folder, until nothing changes or
    the edges left fit one task. Minima are pre-aggregated and joined back, so the hub of a star is
    never gathered, and its rows meet its minimum where they lie.
    Null ends and loops are ignored; no edges give no rows.
    """
    a, b = edges.columns
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b))
    tasks = edges.count() // TASK_EDGES + 1
    old = Stored(ends.coalesce(tasks).mapInArrow(_contract, "u long, v long"), "components")
    seen = None
    while tasks > 1:
        e = old.df
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, tasks = now, now[0] // TASK_EDGES + 1
        if tasks == 1:
            new = Stored(e.coalesce(1).mapInArrow(_contract, "u long, v long"), "components")
        else:
            both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
            low = Stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"), F.count_if(F.col("y") > F.col("x")).alias("n")), "minima")
            large = join_hot(both.where("y > x"), low.df, ["x"], now[0]).where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
            new = Stored(small, "components")
            low.drop()
        old.drop()
        old = new
    e = old.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
