"""Joins of records (JOIN-1..3, JOIN-5..7, PRJ-2..3, FLT-7, LIM-1..2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(left: DataFrame, right: DataFrame, left_key: str = "qid", right_key: str = "question_id", order: str | None = None) -> DataFrame:
    """Inner join; of repeated left keys the last by ``order``; shared columns from the right; right key dropped."""
    if order:
        others = [c for c in left.columns if c not in (left_key, order)]
        left = left.groupBy(left_key).agg(F.max_by(F.struct(*others), order).alias("r")).select(left_key, "r.*")
    keep = [c for c in left.columns if c == left_key or c not in right.columns]
    return right.join(left.select(*keep), right[right_key] == left[left_key]).drop(right[right_key])


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return right.join(left, right[right_key] == left[left_key], "left_anti")


def ordered_texts(lists: DataFrame, corpus: DataFrame) -> DataFrame:
    """idx and array of struct(id, text) in list order; ids without a text are skipped."""
    items = lists.select("idx", F.posexplode("doc_ids").alias("pos", "id"))
    found = items.join(corpus.select(F.col("chunk_id").alias("id"), "text"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id", "text")))
    return found.groupBy("idx").agg(F.transform(ordered, lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"))).alias("docs"))


def batches(rows: DataFrame, size: int = 4) -> DataFrame:
    """Rows (position, ...) with the number of their batch."""
    return rows.withColumn("batch", F.floor(F.col("position") / size).cast("long"))

