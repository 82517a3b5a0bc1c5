"""JSON lines and text in and out (SRC-1..13, SRC-16, SNK-1..5, FLT-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank and malformed lines go, a missing file is an empty table."""
    fields = T._parse_datatype_string(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], fields)
    full = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def positions(df: DataFrame, name: str = "position") -> DataFrame:
    """An increasing line number: file order, by the scan's partitions."""
    return df.withColumn(name, F.monotonically_increasing_id())


def keyed_corpus(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """One text per key: the last line wins."""
    return positions(df).groupBy(key).agg(F.max_by(text, "position").alias(text))


def read_nested(spark: SparkSession, path: str, item_schema: str, field: str = "input_data") -> DataFrame:
    """Rows of an array inside one JSON document."""
    whole = spark.read.option("multiLine", True).schema(f"{field} array<struct<{item_schema}>>").json(path)
    return whole.select(F.inline(field))


def titled_questions(df: DataFrame) -> DataFrame:
    """qid, text ("question in 'title'"), answer."""
    return df.select("qid", F.format_string("%s in '%s'", "question", "title").alias("text"), F.col("answers").alias("answer"))


def aliases(df: DataFrame) -> DataFrame:
    return df.select("Q_id", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("demonyms", F.array().cast("array<string>"))).alias("names"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows of a JSON array; numbers inside facts become text."""
    lists = "array<array<string>>"
    return spark.read.option("multiLine", True).schema(f"_id string, answer string, answer_id string, supporting_facts {lists}, evidences {lists}, evidences_id {lists}").json(path)


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(_id, pred) of answers, supporting facts and evidences, from one JSON object of three maps."""
    maps = "map<string, array<array<string>>>"
    whole = spark.read.option("multiLine", True).schema(f"answer map<string, string>, sp {maps}, evidence {maps}").json(path)
    return tuple(whole.select(F.explode(c).alias("_id", "pred")) for c in ("answer", "sp", "evidence"))


def write_results(rows: DataFrame, means: DataFrame, path: str) -> None:
    """Rows and their one row of means, as JSON lines in two folders under ``path``."""
    write_jsonl(rows, f"{path}/results")
    write_jsonl(means, f"{path}/metrics")


def append_record(spark: SparkSession, path: str, means: DataFrame, **about: str | float) -> None:
    """One JSON line more under ``path``: ``means`` to three digits, with what ``about`` says of the run."""
    rounded = [F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in means.dtypes]
    means.select(*[F.lit(v).alias(k) for k, v in about.items()], *rounded).write.mode("append").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def first_rows(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows in order; all if n is None."""
    return df if n is None else df.orderBy(order).limit(n)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """JSON lines with nulls kept, in the frame's partitions and order; False on an error."""
    try:
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    except Exception:  # noqa: BLE001  the contract is a flag
        return False
    return True


def write_prompts(prompts: DataFrame, questions: DataFrame, path: str) -> bool:
    """JSON lines {prompt, question, answer} of prompts (position, prompt) and questions (position, question, answer), in order."""
    rows = prompts.select("position", "prompt").join(questions.select("position", "question", "answer"), "position")
    return write_jsonl(rows.orderBy("position").select("prompt", "question", "answer"), path)


def checker_rows(answers: DataFrame) -> DataFrame:
    """Answers as an external checker of retrieval reads them (EVL-10), from (query_id, query, gt_answer, response, texts)."""
    context = F.transform("texts", lambda t: F.struct(t.alias("text")))
    return answers.select("query_id", "query", "gt_answer", "response", context.alias("retrieved_context"))


def write_checker(answers: DataFrame, path: str) -> bool:
    """One JSON line a query, in order of the ids."""
    return write_jsonl(checker_rows(answers).orderBy("query_id"), path)


def cached(spark: SparkSession, path: str, build, **parameters) -> DataFrame:
    """A table built once under a path that names its parameters, then read (chunks, embeddings, an index)."""
    at = path + "".join(f"_{k}={v}" for k, v in sorted(parameters.items()))
    if not _exists(spark, f"{at}/_SUCCESS"):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table; a missing one is fine."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those with their key."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)
