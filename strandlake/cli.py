"""Entry points: ``python -m strandlake.cli eval|topk|qa ...``; models come in as ``module:factory``."""

from __future__ import annotations

import argparse
import importlib
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake.operators import evaluate, knn, rag
from strandlake.sources import jsonl


def factory(name: str):
    """The provider factory that ``module:attribute`` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def run_eval(spark: SparkSession, a: argparse.Namespace) -> dict:
    answers, facts, evidences = jsonl.read_predictions(spark, a.pred)
    names = jsonl.aliases(jsonl.read_jsonl(spark, a.alias, "Q_id string, aliases array<string>, demonyms array<string>"))
    return evaluate.evaluation(jsonl.read_gold(spark, a.gold), answers, facts, evidences, names).first().asDict()


def run_topk(spark: SparkSession, a: argparse.Namespace) -> dict:
    make = factory(a.embeddings)
    questions = jsonl.read_jsonl(spark, a.queries, "qid string, question string, title string, answers array<string>")
    q = jsonl.positions(jsonl.titled_questions(questions), "idx")
    corpus = jsonl.positions(jsonl.read_jsonl(spark, a.corpus, "text string"), "chunk_id")
    x = rag.embedded(corpus, make, a.cache)
    near = knn.knn(rag.embed(q, make, "text", True).select(F.col("idx").alias("qid"), "v"), x, a.k, a.metric)
    lists = knn.topk_lists(near).select(F.col("qid").alias("idx"), F.col("doc_ids").alias("top_k_doc_id"))
    return {"written": jsonl.write_jsonl(q.join(lists, "idx").orderBy("idx").select("qid", "text", "answer", "top_k_doc_id"), a.out)}


def run_qa(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = jsonl.positions(jsonl.read_jsonl(spark, a.data_path, "prompt string, answer array<string>"))
    rows = jsonl.first_rows(rows, "position", a.num_questions).withColumnRenamed("answer", "labels")
    start = time.time()
    means = evaluate.label_set_means(rag.document_qa(rows, factory(a.chat)).withColumnRenamed("response", "answer"))
    got = means.first().asDict()
    if a.result_file:
        jsonl.append_record(spark, a.result_file, spark.createDataFrame([got], means.schema), latency=round(time.time() - start, 3))
    return got


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="strandlake")
    sub = p.add_subparsers(required=True)
    e = sub.add_parser("eval", help="corpus metrics of predictions")
    for name in ("pred", "gold", "alias"):
        e.add_argument(name)
    e.set_defaults(run=run_eval)
    t = sub.add_parser("topk", help="nearest documents of every question")
    for name in ("queries", "corpus", "out"):
        t.add_argument(name)
    t.add_argument("--embeddings", required=True)
    t.add_argument("--k", type=int, default=20)
    t.add_argument("--metric", default="l2")
    t.add_argument("--cache", help="path under which the corpus's vectors are kept for later runs")
    t.set_defaults(run=run_topk)
    q = sub.add_parser("qa", help="answers to prompts, scored against their labels")
    q.add_argument("--data-path", required=True)
    q.add_argument("--num-questions", type=int)
    q.add_argument("--chat", required=True)
    q.add_argument("--result-file")
    q.set_defaults(run=run_qa)
    a = p.parse_args(argv)
    out = a.run(spark or SparkSession.builder.getOrCreate(), a)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
