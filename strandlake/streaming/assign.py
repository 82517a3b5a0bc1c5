"""An extension: assign arriving lists to a tree as they come (TOP-7 as a stream against a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandlake.operators.overlap import closest


def assign_stream(lists: DataFrame, nodes: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends (idx, node_id, dist) of each micro-batch to Parquet."""

    def write(batch: DataFrame, epoch: int) -> None:
        closest(batch, nodes).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return lists.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
