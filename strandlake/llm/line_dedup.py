"""Operator 6: repeated multi-line chunks with content-defined boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Stored, join_hot


def chunk_ends(lines: list[str]) -> list[int]:
    """Line numbers after which a chunk ends.

    A boundary follows each line whose hash is less than those of the lines beside it. From there, and
    from the end of the text, boundaries go up in steps of two lines while a chunk of two is left, also
    through runs of equal lines. Lines added before a passage do not move its boundaries. None follows
    two blank lines or leaves only blank ones, so each chunk of a text with a word has one.
    """
    n = len(lines)
    h = [xxhash.xxh3_64_intdigest(x) for x in lines]
    blank = [not x or x.isspace() for x in lines]
    worded = max((i for i, x in enumerate(blank) if not x), default=0)
    low = [0 < i < n - 1 and h[i - 1] > h[i] < h[i + 1] for i in range(n)]
    ends = [n]
    for i in range(min(n - 2, worded) - 1, 0, -1):
        if (low[i] or (ends[-1] - i > 2 and not low[i - 1])) and not (blank[i - 1] and blank[i]):
            ends.append(i + 1)
    return ends[::-1]


def chunk_texts(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lines and the (start, end) of each chunk. Only a text of one line, or without a word, has one that cannot go."""
    lines = text.split("\n")
    ends = chunk_ends(lines)
    return lines, list(zip([0, *ends[:-1]], ends, strict=True))


def removable(lines: list[str], a: int, b: int) -> bool:
    return b - a >= 2 and any(x and not x.isspace() for x in lines[a:b])


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """(doc_id, version, gone: chunk numbers to remove) after byte comparison, of rows (doc_id, version, text).

    The first chunk of a class by (doc_id, version, number) stays. Chunks travel as 128-bit hashes;
    counting pre-aggregates, so a chunk in every document is one row per task, and is joined back where
    its rows lie. Texts of repeated chunks are then compared as bytes, again pre-aggregated (least and
    greatest text of a hash); where texts under one hash differ, that hash removes nothing.
    """

    def hashes(lines: list[str], a: int, b: int) -> tuple[int, int]:
        h = xxhash.xxh3_128_digest("\n".join(lines[a:b]))
        return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)

    def hashed(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, version, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines, spans = chunk_texts(text)
                for k, (a, b) in enumerate(spans):
                    if removable(lines, a, b):
                        for column, x in zip(out, (*hashes(lines, a, b), key, version, k), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.int32())], names=["h1", "h2", "doc_id", "version", "k"])

    place = F.struct("doc_id", "version", "k")
    chunks = Stored(rows.mapInArrow(hashed, "h1 long, h2 long, doc_id long, version long, k int"), "chunks")
    first = Stored(chunks.df.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "first")
    found = Stored(join_hot(chunks.df, first.df, ["h1", "h2"], chunks.df.count()).select("h1", "h2", "doc_id", "version", "k", (place != F.col("first")).alias("again")), "repeats")

    def texts(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines, spans = chunk_texts(text)
                for w in wanted:
                    if w["k"] >= len(spans) or hashes(lines, *spans[w["k"]]) != (w["h1"], w["h2"]):
                        continue  # another text of this doc_id with an equal version
                    a, b = spans[w["k"]]
                    for column, x in zip(out, (w["h1"], w["h2"], "\n".join(lines[a:b]).encode()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["h1", "h2", "chunk"])

    wanted = found.df.groupBy("doc_id", "version").agg(F.collect_list(F.struct("h1", "h2", "k")).alias("wanted"))
    seen = rows.join(wanted.hint("shuffle_hash"), ["doc_id", "version"]).select("text", "wanted").mapInArrow(texts, "h1 long, h2 long, chunk binary")
    unlike = Stored(seen.groupBy("h1", "h2").agg((F.min("chunk") != F.max("chunk")).alias("unlike")).where("unlike").drop("unlike"), "unlike")
    again = found.df.where("again")
    if not unlike.df.isEmpty():
        again = again.join(unlike.df, ["h1", "h2"], "left_anti")
    gone = Stored(again.groupBy("doc_id", "version").agg(F.collect_set("k").alias("gone")), "gone")
    for x in (chunks, first, found, unlike):
        x.drop()
    return gone.df


def _applied(docs: DataFrame) -> DataFrame:
    """row: all columns of ``docs`` but the text; done: the text that stays and the counts."""
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("version"), docs["text"])
    gone = repeated_chunks(rows.where("doc_id is not null and text is not null").select("doc_id", "version", "text"))

    @F.pandas_udf("text string, n_lines long, n_removed_lines long, n_removed_chunks long")
    def apply(text, gone):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, ks in zip(text, gone, strict=True):
            if t is None:
                out.append((None, 0, 0, 0))
            elif ks is None:
                out.append((t, t.count("\n") + 1, 0, 0))
            else:
                lines, spans = chunk_texts(t)
                drop = set(ks)
                kept = [x for k, (a, b) in enumerate(spans) if k not in drop for x in lines[a:b]]
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept), len(drop)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed_lines", "n_removed_chunks"])

    apply = apply.asNondeterministic()  # else a filter on its results runs it a second time
    joined = rows.join(gone.hint("shuffle_hash"), ["doc_id", "version"], "left")
    return joined.select("row", apply("text", "gone").alias("done"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("done.text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]


COUNTS = ["n_lines", "n_removed_lines", "n_removed_chunks"]


def line_dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the lines that stay in ``text``, then counts of lines and chunks.

    A null text stays null. Rows with a null doc_id take no part and stay whole. Rows that repeat a
    doc_id and its text count as one document; other texts under the same doc_id are documents of their
    own, in the order of their hashes. Single lines are never removed. Columns of ``docs`` that are named
    as the counts make way for them; all other names are free. Empty tables give no rows.
    """
    own = [c for c, name in zip(_columns(docs), docs.columns, strict=True) if name not in COUNTS]
    return _applied(docs).select(*own, *[F.col(f"done.{c}").alias(c) for c in COUNTS])


def cleaned(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the lines that stay, without rows that lost their whole text; n_chars follows."""
    left = _applied(docs).where("done.n_removed_lines = 0 or done.text <> ''")
    size = F.length("done.text").cast("long").alias("n_chars")
    return left.select(*[size if name == "n_chars" else c for c, name in zip(_columns(docs), docs.columns, strict=True)])


def digest(out: DataFrame) -> DataFrame:
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *COUNTS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
