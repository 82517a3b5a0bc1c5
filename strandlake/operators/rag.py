"""Retrieval and generation stages with pluggable providers (UDF-1..8, RAG-1..12, SRC-17)."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import prompts
from strandlake.functions.text import assistant_reply, marked_parts, sub_questions
from strandlake.operators import reorder, tree
from strandlake.operators.durable import checkpointed, shared_path
from strandlake.operators.knn import knn, topk_lists
from strandlake.operators.records import ordered_texts
from strandlake.operators.vector_index import VectorIndex
from strandlake.sources.jsonl import cached, upsert


class ChatProvider(Protocol):
    """Replies to prompts, in order. An exception in place of a reply fails that prompt alone."""

    def chat(self, prompts: list[str], max_new_tokens: int = 1024) -> list[str | Exception]: ...


class EmbeddingProvider(Protocol):
    """Vectors of texts, in order; texts beyond ``max_length`` tokens are cut by the provider."""

    def encode(self, texts: list[str], is_query: bool, max_length: int = 4096) -> list[list[float] | Exception]: ...


class StubChat:
    """For tests and plumbing: answers with the first words of the question's last line."""

    def chat(self, prompts: list[str], max_new_tokens: int = 1024) -> list[str | Exception]:
        return ["assistant\n" + " ".join(p.strip().splitlines()[-1].split()[: min(8, max_new_tokens)]) + " ## stub" for p in prompts]


class StubEmbedding:
    """For tests and plumbing: counts of hashed words, not a model."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def encode(self, texts: list[str], is_query: bool, max_length: int = 4096) -> list[list[float] | Exception]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.split()[:max_length]:
                v[zlib.crc32(w.encode()) % self.dim] += 1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


class Instructed:
    """A provider whose queries carry the task they are asked for; passages go as they are."""

    def __init__(self, inner: EmbeddingProvider, task: str = prompts.QUERY_TASK):
        self.inner, self.task = inner, task

    def encode(self, texts: list[str], is_query: bool, max_length: int = 4096) -> list[list[float] | Exception]:
        asked = [f"Instruct: {self.task}\nQuery: {t}" for t in texts] if is_query else texts
        return self.inner.encode(asked, is_query, max_length)


def concurrently(call: Callable, items: list, workers: int = 10) -> list:
    """Results of ``call`` in the order of the items, ``workers`` at a time; an item that fails gives its exception."""

    def one(item):
        try:
            return call(item)
        except Exception as e:  # noqa: BLE001  reported per item
            return e

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, items))


class HttpEmbedding:
    """An embeddings service: each text is posted to ``{url}/embeddings``, ``workers`` requests at a time."""

    def __init__(self, url: str, model: str, workers: int = 10, timeout: float = 300):
        self.url, self.model, self.workers, self.timeout = url.rstrip("/"), model, workers, timeout

    def _one(self, text: str) -> list[float]:
        body = json.dumps({"model": self.model, "input": text}).encode()
        request = urllib.request.Request(f"{self.url}/embeddings", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["data"][0]["embedding"]

    def encode(self, texts: list[str], is_query: bool, max_length: int = 4096) -> list[list[float] | Exception]:
        return concurrently(self._one, texts, self.workers)


class RemoteChat:
    """A chat service behind any function of (prompt, max_new_tokens), ``workers`` calls at a time."""

    def __init__(self, invoke: Callable[[str, int], str], workers: int = 10):
        self.invoke, self.workers = invoke, workers

    def chat(self, prompts: list[str], max_new_tokens: int = 1024) -> list[str | Exception]:
        return concurrently(lambda p: self.invoke(p, max_new_tokens), prompts, self.workers)


def generate(rows: DataFrame, make: Callable[[], ChatProvider], column: str = "prompt", max_new_tokens: int = 1024) -> DataFrame:
    """Adds ``response``, ``error`` and the ``seconds`` the batch took a prompt: one provider per worker.

    A prompt that fails is null with its error; a batch that fails as a whole, all of it.
    """

    @F.pandas_udf("response string, error string, seconds double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in it:
            start = time.perf_counter()
            try:
                got = provider.chat(batch.tolist(), max_new_tokens)
            except Exception as e:  # noqa: BLE001  reported per row
                got = [e] * len(batch)
            failed = [isinstance(x, Exception) for x in got]
            spent = (time.perf_counter() - start) / max(1, len(batch))
            yield pd.DataFrame({"response": [None if f else x for x, f in zip(got, failed, strict=True)], "error": [str(x) if f else None for x, f in zip(got, failed, strict=True)], "seconds": [spent] * len(batch)})

    names = [c for c in rows.columns if c not in ("response", "error", "seconds")]
    got = rows.select(*names, run.asNondeterministic()(column).alias("g__"))
    return got.select(*names, assistant_reply(F.col("g__.response")).alias("response"), "g__.error", "g__.seconds")


def answered(rows: DataFrame, order: str) -> DataFrame:
    """Rows that did not fail, in order (FLT-1)."""
    return rows.where("error is null").orderBy(order)


def embed(rows: DataFrame, make: Callable[[], EmbeddingProvider], text: str, is_query: bool = False, max_length: int = 4096) -> DataFrame:
    """Adds the vector ``v`` of a text; null where the provider failed."""

    @F.pandas_udf("array<double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for batch in it:
            got = provider.encode(batch.fillna("").tolist(), is_query, max_length)
            yield pd.Series([None if isinstance(x, Exception) else x for x in got], dtype=object)

    return rows.withColumn("v", run.asNondeterministic()(text))


def embedded(corpus: DataFrame, make: Callable[[], EmbeddingProvider], cache: str | None = None, **parameters) -> DataFrame:
    """Vectors (id, v) of a corpus (chunk_id, text), computed once and kept for all searches of a run.

    With ``cache`` they are kept for later runs as well, under a path that names the parameters.
    """
    vectors = embed(corpus.select("chunk_id", "text"), make, "text").select(F.col("chunk_id").alias("id"), "v")
    return checkpointed(vectors) if cache is None else cached(corpus.sparkSession, cache, lambda: vectors, **parameters)


def shuffled(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Retrieved documents in a seeded order."""
    keyed = F.transform("docs", lambda d: F.struct(F.xxhash64(F.lit(seed), d["id"]).alias("h"), d["id"].alias("id"), d["text"].alias("text")))
    return docs.withColumn("docs", F.transform(F.array_sort(keyed), lambda d: F.struct(d["id"].alias("id"), d["text"].alias("text"))))


def retrieve(queries: DataFrame, corpus: DataFrame, k: int, make: Callable[[], EmbeddingProvider], metric: str = "l2", vectors: DataFrame | VectorIndex | None = None) -> DataFrame:
    """idx, question, docs of queries (idx, question) over a corpus (chunk_id, text) and its vectors or their index."""
    q = embed(queries.select(F.col("idx").alias("qid"), F.col("question")), make, "question", True).select("qid", "v")
    x = embedded(corpus, make) if vectors is None else vectors
    near = x.search(q, k, metric=metric) if isinstance(x, VectorIndex) else knn(q, x, k, metric)
    lists = topk_lists(near).withColumnRenamed("qid", "idx")
    return queries.join(ordered_texts(lists, corpus), "idx")


def rag(queries: DataFrame, corpus: DataFrame, k: int, embeddings: Callable[[], EmbeddingProvider], chat: Callable[[], ChatProvider], seed: int | None = None, max_new_tokens: int = 1024, vectors: DataFrame | VectorIndex | None = None) -> DataFrame:
    found = retrieve(queries, corpus, k, embeddings, vectors=vectors)
    found = found if seed is None else shuffled(found, seed)
    texts = F.transform("docs", lambda d: d["text"])
    return generate(found.withColumn("prompt", prompts.simple_rag(texts, F.col("question"))), chat, max_new_tokens=max_new_tokens)


def rag_cot(queries: DataFrame, corpus: DataFrame, k: int, embeddings, chat, vectors: DataFrame | VectorIndex | None = None) -> DataFrame:
    """As :func:`rag`, with the question asked to be thought through step by step."""
    return rag(queries.withColumn("question", prompts.fill(prompts.SIMPLE_COT, F.col("question"))), corpus, k, embeddings, chat, vectors=vectors)


def rat(queries: DataFrame, corpus: DataFrame, k: int, embeddings, chat, paragraphs: int = 5, vectors: DataFrame | VectorIndex | None = None) -> DataFrame:
    """Draft, revise every part of it with new retrieval, summarise: idx, question, chain (revised parts), response, error.

    A part is searched by the question, the parts revised before it and itself; its prompt holds all that
    was found so far. The summary is asked of the same findings. All queries advance together, as many
    steps as the longest draft has parts, whatever number was asked for. A part whose revision fails stays
    as drafted, with its error in the row.
    """
    vectors = embedded(corpus, embeddings) if vectors is None else vectors
    joined = lambda by: F.array_join(F.transform("docs", lambda d: d["text"]), by)
    paragraph = lambda xs: F.array_join(xs, "\n\n")
    none = F.array().cast("array<string>")
    found = retrieve(queries.select("idx", "question"), corpus, k, embeddings, vectors=vectors)
    draft = generate(found.withColumn("prompt", prompts.fill(prompts.FIRST_RAT, joined(", "), F.col("question"), F.lit(str(paragraphs)))), chat)
    state = checkpointed(draft.select("idx", "question", F.coalesce(marked_parts(F.col("response")), none).alias("parts"), none.alias("chain"), none.alias("found"), "error"))
    steps = state.agg(F.max(F.size("parts"))).first()[0] or 0
    for step in range(steps):
        part = F.get("parts", F.lit(step))
        asked = state.where(part.isNotNull())
        text = paragraph(F.concat(F.array("question"), "chain", F.array(part)))
        near = retrieve(asked.select("idx", text.alias("question")), corpus, k, embeddings, vectors=vectors).select("idx", joined("\n\n- ").alias("near"))
        asked = asked.join(near, "idx", "left").withColumn("found", F.concat("found", F.array(F.coalesce("near", F.lit("")))))
        asked = asked.withColumn("prompt", prompts.fill(prompts.REVISE, paragraph(F.col("found")), paragraph(F.col("chain")), part))
        got = generate(asked.drop("error"), chat).select("idx", F.col("found").alias("now"), F.coalesce("response", part).alias("revised"), F.col("error").alias("failed"))
        more = lambda c, x: F.when(F.col(x).isNull(), F.col(c)).otherwise(F.concat(c, F.array(x)))
        state = state.join(got, "idx", "left").select("idx", "question", "parts", more("chain", "revised").alias("chain"), F.coalesce("now", "found").alias("found"), F.coalesce("error", "failed").alias("error"))
        state = checkpointed(state)
    last = state.withColumn("prompt", prompts.fill(prompts.SUMMARIZE, paragraph(F.col("found")), paragraph(F.col("chain")), F.col("question")))
    return generate(last.withColumnRenamed("error", "before"), chat).select("idx", "question", "chain", "response", F.coalesce("before", "error").alias("error"))


def decompose(queries: DataFrame, chat) -> DataFrame:
    """Sub-questions of every question: what follows each '##'."""
    asked = generate(queries.withColumn("prompt", prompts.fill(prompts.SUB_QUESTIONS, F.col("question"))), chat)
    return asked.select("idx", "question", sub_questions(F.col("response")).alias("sub_questions"), "seconds")


def short_answers(queries: DataFrame, corpus: DataFrame, k: int, embeddings, chat, vectors: DataFrame | VectorIndex | None = None) -> DataFrame:
    """Retrieved texts in one line and an answer of a few words."""
    found = retrieve(queries, corpus, k, embeddings, vectors=vectors)
    texts = F.array_join(F.transform("docs", lambda d: d["text"]), ", ")
    return generate(found.withColumn("prompt", prompts.fill(prompts.SHORT_ANSWER, texts, F.col("question"))), chat)


def cot_rag(queries: DataFrame, corpus: DataFrame, k: int, embeddings, chat, vectors: DataFrame | VectorIndex | None = None) -> DataFrame:
    """idx, question, chain, response, error, seconds: sub-questions answered in turn, each knowing those before, then the question.

    All queries advance together, one stage a sub-question, as many as the longest list has. A stage that
    fails leaves its answer empty and its error in the row; the other queries go on. ``seconds`` is what
    the chat provider took over all stages of a query.
    """
    vectors = embedded(corpus, embeddings) if vectors is None else vectors
    state = checkpointed(decompose(queries, chat).withColumns({"chain": F.lit(""), "error": F.lit(None).cast("string")}))
    steps = state.agg(F.max(F.size("sub_questions"))).first()[0] or 0
    known = lambda q: F.concat(F.when(F.col("chain") == "", "").otherwise(F.concat("chain", F.lit("\n"))), F.lit("Q: "), q)
    for step in range(steps):
        part = F.get("sub_questions", F.lit(step))
        asked = state.where(part.isNotNull()).select("idx", F.when(F.col("chain") == "", part).otherwise(known(part)).alias("question"))
        got = short_answers(asked, corpus, k, embeddings, chat, vectors).select("idx", F.coalesce("response", F.lit("")).alias("answer"), F.col("error").alias("failed"), F.col("seconds").alias("more"))
        chain = F.when(F.col("answer").isNull(), F.col("chain")).otherwise(F.concat(known(part), F.lit("\nA: "), F.col("answer")))
        spent = F.col("seconds") + F.coalesce("more", F.lit(0.0))
        state = state.join(got, "idx", "left").select("idx", "question", "sub_questions", chain.alias("chain"), F.coalesce("error", "failed").alias("error"), spent.alias("seconds"))
        state = checkpointed(state)
    last = short_answers(state.select("idx", known(F.col("question")).alias("question")), corpus, k, embeddings, chat, vectors)
    got = last.select("idx", "response", F.col("error").alias("failed"), F.col("seconds").alias("more"))
    spent = F.col("seconds") + F.coalesce("more", F.lit(0.0))
    return state.join(got, "idx", "left").select("idx", "question", "chain", "response", F.coalesce("error", "failed").alias("error"), spent.alias("seconds"))


class Engine:
    """A corpus with its vectors and providers: embeds once, then answers any number of batches.

    ``chunks`` (chunk_id, text) and ``vectors`` (id, v) are tables, or ``vectors`` is their stored index;
    :meth:`upsert` replaces texts by id.
    """

    def __init__(self, corpus: DataFrame, embeddings: Callable[[], EmbeddingProvider], chat: Callable[[], ChatProvider], vectors: DataFrame | VectorIndex | None = None, cache: str | None = None, **parameters):
        self.chunks, self.embeddings, self.provider = corpus.select("chunk_id", "text"), embeddings, chat
        self.vectors = embedded(self.chunks, embeddings, cache, **parameters) if vectors is None else vectors

    def upsert(self, texts: DataFrame) -> None:
        new = texts.select("chunk_id", "text")
        vectors = embed(new, self.embeddings, "text").select(F.col("chunk_id").alias("id"), "v")
        if isinstance(self.vectors, VectorIndex):
            self.vectors = self.vectors.upsert(vectors, shared_path(texts.sparkSession, "index"))
        else:
            self.vectors = checkpointed(upsert(self.vectors, vectors, "id"))
        self.chunks = checkpointed(upsert(self.chunks, new, "chunk_id"))

    def embed_queries(self, queries: DataFrame, max_length: int = 4096) -> DataFrame:
        return embed(queries, self.embeddings, "question", True, max_length)

    def search(self, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        return retrieve(queries, self.chunks, k, self.embeddings, metric, self.vectors)

    def chat(self, rows: DataFrame, max_new_tokens: int = 1024) -> DataFrame:
        return generate(rows, self.provider, max_new_tokens=max_new_tokens)

    def rag(self, queries: DataFrame, k: int, seed: int | None = None, max_new_tokens: int = 1024) -> DataFrame:
        return rag(queries, self.chunks, k, self.embeddings, self.provider, seed, max_new_tokens, self.vectors)

    def rag_cot(self, queries: DataFrame, k: int) -> DataFrame:
        return rag_cot(queries, self.chunks, k, self.embeddings, self.provider, self.vectors)

    def rat(self, queries: DataFrame, k: int, paragraphs: int = 5) -> DataFrame:
        return rat(queries, self.chunks, k, self.embeddings, self.provider, paragraphs, self.vectors)

    def cot_rag(self, queries: DataFrame, k: int) -> DataFrame:
        return cot_rag(queries, self.chunks, k, self.embeddings, self.provider, self.vectors)


def timing(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Seconds in all and per question, also counting questions without an answer (AGG-11)."""
    both = rows.select("seconds", F.lit(0).alias("n")).unionByName(questions.select(F.lit(None).cast("double").alias("seconds"), F.lit(1).alias("n")))
    total, n = F.coalesce(F.sum("seconds"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))
    return both.agg(total.alias("total"), n.alias("n"), (total / F.greatest(n, F.lit(1))).alias("mean"))


def document_qa(requests: DataFrame, chat) -> DataFrame:
    """response and error of requests with a ``prompt``, asked under the multi-document instructions."""
    asked = requests.withColumn("asked", prompts.fill(prompts.QA_CHAT, F.col("prompt")))
    return generate(asked, chat, "asked", prompts.QA_TOKENS).drop("asked", "seconds")


def optimize_lists(lists: DataFrame) -> DataFrame:
    """Cluster, put shared contents first, then order the batch: idx, new_ids, new_pos."""
    nodes = checkpointed(tree.shared_tree(lists))
    first = reorder.by_leaf(lists, tree.prefix_leaves(nodes))
    return reorder.rewrite(first).select("idx", "new_ids", "new_pos")


def synthetic_queries(spark, queries: int = 1000, docs: int = 200, k: int = 10, seed: int = 1) -> DataFrame:
    """k distinct documents a query, drawn with Gaussian weights around the middle (exponential-key sampling)."""
    z = (F.col("doc") - docs / 2) / (docs / 100)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "idx", "doc"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    draws = spark.range(queries).withColumnRenamed("id", "idx").withColumn("doc", F.explode(F.sequence(F.lit(0), F.lit(docs - 1))))
    keyed = draws.withColumn("key", F.log(-F.log(uniform)) + z * z / 2)
    return keyed.groupBy("idx").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("key", "doc"))), lambda s: s["doc"].cast("long")), 1, k).alias("doc_ids"))
