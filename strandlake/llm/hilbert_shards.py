"""Operator 10: shards as runs of a Hilbert curve over document metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Stored

BITS = 5
SLOT_BITS = 33


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points (rows; coordinates under 2**bits), after Skilling (2004)."""
    x = axes.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[:, i] & q) != 0
            t = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(up, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def shard(docs: DataFrame, shards: int = 16, whole: bool = False) -> DataFrame:
    """Shard and slot of every document, in Hilbert order of (size, language, source).

    Law ``rows``: the ordered rows are cut into runs whose lengths differ by one at most. Sizes are
    quantised by powers of two, languages and sources by hash. Only ids, sizes and checksums are
    shuffled: one range partitioning whose last keys (checksum, id, place in the scan) break ties, so
    that neither a common cell nor a group of equal texts lands in one task. Ranks come from the
    partitions' row counts. Null text: size 1, checksum 0. Null language or source: a value of its
    own. Equal texts follow each other within a cell. A null doc_id stays null; repeated rows each
    get a slot; an empty table gives no rows. Other columns are pruned, or with ``whole`` travel along in
    a struct ``row``.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    cell = lambda c: F.pmod(F.crc32(F.coalesce(docs[c], F.lit("\x00"))), F.lit(1 << BITS))
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []
    d = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        cell("lang").alias("c_lang"),
        cell("source").alias("c_source"),
        F.monotonically_increasing_id().alias("tie"),
        *row,
    )
    @F.pandas_udf("long")
    def curve(size: pd.Series, lang: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([size, lang, source], axis=1), BITS))

    level = F.least((F.length(F.bin("size")) - 1).cast("long"), F.lit((1 << BITS) - 1))
    d = d.withColumn("curve", curve(level, "c_lang", "c_source")).drop("c_lang", "c_source")
    order = ["curve", "text_crc32", "doc_id", "tie"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    kept = Stored(d.drop("tie"), "hilbert").df.withColumn("part", F.shiftright("at", SLOT_BITS))
    counts = kept.groupBy("part").count().orderBy("part").collect()  # one row per partition
    first, total = {}, 0
    for r in counts:
        first[r["part"]] = total
        total += r["count"]
    q, r = divmod(total, shards)
    offsets = F.broadcast(spark.createDataFrame([*first.items()] or [(-1, 0)], "part long, first long"))
    rank = F.col("first") + F.col("at").bitwiseAND((1 << SLOT_BITS) - 1)
    long_runs = r * (q + 1)
    ranked = kept.join(offsets, "part").withColumn("rank", rank)
    in_long = F.col("rank") < long_runs
    if q:
        s = F.when(in_long, F.floor(F.col("rank") / (q + 1))).otherwise(r + F.floor((F.col("rank") - long_runs) / q))
    else:
        s = F.col("rank")
    ranked = ranked.withColumn("shard", s.cast("int"))
    start = F.when(F.col("shard") < r, F.col("shard") * (q + 1)).otherwise(long_runs + (F.col("shard") - r) * q)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *(["row"] if whole else [])
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Documents as files, one folder per shard, each in slot order for pruning by min and max.

    Rows travel with their placement, so each is written once, whatever its doc_id.
    """
    keyed = shard(docs, shards, whole=True).select("row.*", "shard", "slot")
    keyed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
