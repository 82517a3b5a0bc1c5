"""Intermediate results that outlive executors: iterative operators cut their lineage here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, set as the checkpoint folder.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="strandlake-")
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, whose size the planner knows."""
    at = shared_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_shared(spark)}/strandlake-{name}-{uuid.uuid4().hex}"
