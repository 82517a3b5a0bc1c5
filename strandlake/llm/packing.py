"""Operator 3: packing by power-of-two decomposition."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import slices
from strandlake.llm.word_bpe import word_bpe

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def piece_lengths(n: int, most: int) -> list[int]:
    """``most`` as often as it fits, then the binary digits of the rest, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str, most: int = 2048, end_id: int = 1) -> DataFrame:
    """Sequences of a power-of-two length, each from one document: no padding, no mixing.

    One row per piece, which is a whole sequence (offset 0), with its packed ids (little-endian
    unsigned 32 bits); ``length`` is its bucket, and batches of a bucket need no padding. No shuffle:
    the sequence id is the scan partition's number and a count within it, so a task that runs again
    gives the same ids for the same rows. Null text: the end id alone. A null doc_id stays null;
    repeated rows are packed each; other columns are pruned; an empty table gives no rows.
    """
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        bpe = word_bpe(vocabulary)
        next_id = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                rows: list[list] = [[] for _ in SCHEMA]
                for i, packed in zip(part, bpe.encode_batch([texts[i] for i in part]), strict=True):
                    packed += end
                    n, at = len(packed) // 4, 0
                    for length in piece_lengths(n, most):
                        ids = packed[4 * at : 4 * (at + length)]
                        for column, x in zip(rows, (keys[i], at, length, zlib.crc32(ids), n, next_id, 0, ids), strict=True):
                            column.append(x)
                        at += length
                        next_id += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SCHEMA, strict=True)], schema=SCHEMA)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, OUT)


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, as training reads it."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
