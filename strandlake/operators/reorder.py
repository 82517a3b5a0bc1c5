"""Reordering lists for shared prefixes and rows by index (SORT-1..6, AGG-12, WIN-2, FLT-6, JOIN-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.similarity import common_prefix
from strandlake.operators.durable import checkpointed
from strandlake.operators.ranks import ranked
from strandlake.sources import jsonl


def prefix_groups(lists: DataFrame) -> DataFrame:
    """Lists (idx, doc_ids) with their group, the group's strength, and positions in the new order.

    Sharing a first id is an equivalence, so groups are those of the first id; an empty list is one of
    its own. A group's seed is its first list, its strength the longest prefix the seed shares with
    another. Members: larger, then smaller list, then earlier. Groups: stronger, then smaller head, then
    earlier seed. ``new_pos`` counts from 0 over all lists, ``in_group`` from 1. Lists are sorted once,
    by range, so neither a frequent first id nor the whole batch is one task's work.
    """
    key = F.when(F.size("doc_ids") > 0, F.concat(F.lit("f"), F.element_at("doc_ids", 1).cast("string"))).otherwise(F.concat(F.lit("e"), F.col("idx").cast("string")))
    d = checkpointed(lists.select("idx", "doc_ids").withColumn("grp", key))
    head = F.min(F.struct((-F.size("doc_ids")).alias("s"), "doc_ids", "idx"))
    info = d.groupBy("grp").agg(F.min("idx").alias("seed"), F.min_by("doc_ids", "idx").alias("seed_ids"), head.alias("head"), F.count("*").alias("members"))
    j = checkpointed(d.join(info.select("grp", "seed", "seed_ids", "members", F.col("head.doc_ids").alias("head_ids")), "grp"))
    strength = j.where("idx <> seed").groupBy("grp").agg(F.max(common_prefix(F.col("seed_ids"), F.col("doc_ids"))).alias("strength"))
    g = j.drop("seed_ids").join(strength, "grp", "left").withColumn("strength", F.coalesce("strength", F.lit(0)))
    g = checkpointed(ranked(g, [F.desc("strength"), F.col("head_ids"), F.col("seed"), F.desc(F.size("doc_ids")), F.col("doc_ids"), F.col("idx")], "new_pos"))
    start = g.groupBy("grp").agg(F.min("new_pos").alias("start"))
    return g.join(start, "grp").withColumn("in_group", (F.col("new_pos") - F.col("start") + 1).cast("int")).drop("start")


def rewrite(lists: DataFrame) -> DataFrame:
    """Each list with the ids common to its group first, sorted, then the rest sorted; lone lists stay."""
    g = checkpointed(prefix_groups(lists))
    items = g.where("members > 1").select("grp", "members", "idx", F.explode(F.array_distinct("doc_ids")).alias("doc"))
    common = items.groupBy("grp", "members", "doc").agg(F.count("*").alias("n")).where("n = members").groupBy("grp").agg(F.array_sort(F.collect_list("doc")).alias("common"))
    out = g.join(common, "grp", "left")
    rest = F.array_sort(F.filter("doc_ids", lambda x: ~F.array_contains(F.col("common"), x)))
    return out.select("idx", "grp", "members", "strength", "seed", "head_ids", "in_group", "new_pos", F.when(F.col("members") > 1, F.concat("common", rest)).otherwise(F.col("doc_ids")).alias("new_ids"))


def reorder_rows(rows: DataFrame, indices: DataFrame) -> DataFrame:
    """rows (position, ...) in the order of indices (ord, idx); all unchanged if any index is invalid.

    No indices: unchanged. Of repeated indices the first counts; rows that none names go.
    """
    span = rows.agg(F.max("position").alias("top"))
    bad = indices.join(F.broadcast(span)).where((F.col("idx") < 0) | (F.col("idx") > F.col("top")) | F.col("top").isNull()).limit(1).count()
    if bad or indices.isEmpty():
        return rows.withColumn("new_position", F.col("position"))
    first = indices.groupBy("idx").agg(F.min("ord").alias("new_position"))
    return rows.join(first, rows["position"] == first["idx"]).drop("idx")


def reorder_file(spark: SparkSession, path: str, schema: str, indices: DataFrame, out: str | None = None) -> DataFrame:
    """Rows of a JSON-lines file in the order of indices (ord, idx), written to ``out`` if given (SORT-2).

    Positions are those of the lines that hold a row.
    """
    rows = ranked(jsonl.positions(jsonl.read_jsonl(spark, path, schema), "line__"), [F.col("line__")], "position").drop("line__")
    done = reorder_rows(rows, indices).orderBy("new_position").drop("position", "new_position")
    if out is not None:
        jsonl.write_jsonl(done, out)
    return done


def by_leaf(lists: DataFrame, leaves: DataFrame) -> DataFrame:
    """Lists with their shared prefix first (SORT-3); leaves: (idx, frequency, content, shared).

    A leaf of several queries: its content, sorted. Else the nearest ancestor of several: its content,
    sorted, then the rest. Else as it was. ``shared`` is that ancestor's content or null.
    """
    j = lists.join(leaves, "idx", "left")
    prefix = F.when(F.col("frequency") > 1, F.col("content")).otherwise(F.col("shared"))
    return j.select("idx", F.when(prefix.isNull(), F.col("doc_ids")).otherwise(F.concat(F.array_sort(prefix), F.array_sort(F.array_except("doc_ids", prefix)))).alias("doc_ids"))
