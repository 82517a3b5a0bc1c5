"""Shared plumbing: tables, durable intermediate results, batch iteration."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    global _local_dir
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at:
        return at
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="strandlake-")
    return f"file://{_local_dir}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialize`; a missing one is fine."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stored:
    """A DataFrame written as Parquet in the shared folder: its lineage is one file scan."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/strandlake-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self._exit = atexit.register(self.drop)

    def drop(self) -> None:
        atexit.unregister(self.drop)
        try:
            drop_path(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


#: Rows of one key that a task takes without harm.
KEY_ROWS = 100_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and whose ``n`` counts the key's rows in ``left``.

    A key with more than ``KEY_ROWS`` and more than one in ``share`` of the ``total`` rows meets its row
    by broadcast, where its rows lie: there are fewer than ``share`` such keys, whatever the data. All
    other keys are shuffled, and without hot keys the join is a plain one. ``right`` should be stored, as
    it is read up to four times. ``how`` is inner or left; keys of ``left`` are not null.
    """
    hot = right["n"] > max(total // share, KEY_ROWS)
    if right.where(hot).isEmpty():
        return left.join(right, keys, how)
    few = F.broadcast(right.where(hot))
    return left.join(few, keys).unionByName(left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot), keys, how))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in the whole table: sizes numbers of partitions."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(spark: SparkSession, units: float, per_part: float) -> int:
    """Partitions so that each holds about ``per_part`` units, and every core gets work."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(units // per_part) + 1)


def slices(texts: list[str], most: int = 1_000_000) -> Iterator[list[int]]:
    """Indices of consecutive texts, about ``most`` characters together: bounds working memory."""
    part: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
