"""Operator 4: quality scores from random Fourier features of document statistics."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Stored

#: Byte classes whose shares are features.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"#$%&*@^~", b"|<>=[]{}\\/", b".,;:", b" \t", b"\n\r", bytes(range(128, 256))]
TABLE = np.array([[b in c for c in CLASSES] for b in range(256)], dtype=np.float64)
N_FEATURES = len(CLASSES) + 8


def statistics(text: str) -> np.ndarray:
    """Numbers that describe a whole text; all zero for an empty one."""
    raw = text.encode()
    if not raw:
        return np.zeros(N_FEATURES)
    shares = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ TABLE / len(raw)
    words, lines = text.split(), text.split("\n")
    n = len(words) or 1
    distinct = len(set(words))
    again = sum(map(eq, words, words[1:]))
    other = [
        np.log1p(len(raw)),
        np.log1p(n),
        len(raw) / n,
        distinct / n,
        np.log1p(n) - np.log1p(distinct),
        again / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(raw) / len(lines)),
    ]
    return np.concatenate([shares, other])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.waves + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.ones(len(x))
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)

    def score_texts(self, texts) -> np.ndarray:
        return self.score(np.array([statistics(t or "") for t in texts]).reshape(-1, N_FEATURES))


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing rates by pooling adjacent violators; x ascending. Knots are pools' mean x."""
    pools: list[list[float]] = []
    for xi, ni, pi in zip(x, n, positive, strict=True):
        pools.append([xi * ni, ni, pi])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, fold (crc32 of the id's text, mod 4; null for a null id) and statistics; no shuffle."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    d = docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, x array<double>")
    return d.withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)).cast("int"))


def fit(stats: DataFrame, labels: DataFrame, waves: int = 256, ridge: float = 1e-3, most: int = 200_000, seed: int = 7) -> Model:
    """Model of ``labels.quality`` from rows outside fold 2.

    At most about ``most`` labelled rows are used: where there are more, those whose hashed id falls
    under a threshold. Folds 0 and 1 give the ridge weights: each partition sums its normal
    equations, those are summed by matrix row, and the driver solves one system of fixed size. Fold 3
    gives the isotonic calibration, through counts in score bins of fixed number. A document with
    several labels has the smallest; null labels are ignored. Without usable labels every score is 1.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    known = stats.where("fold <> 2").join(marks, "doc_id").select("x", F.col("y").cast("double").alias("y"), "fold", F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), rng.normal(size=(N_FEATURES, waves)) / np.sqrt(N_FEATURES), rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.empty(0), np.empty(0))
    stored = Stored(known, "labelled")
    known, total = stored.df, stored.df.count()
    if not total:
        return model
    if total > most:
        known = known.where(F.abs(F.col("h") % 1_000_000) < int(1_000_000 * most / total))
    known = known.coalesce(32)
    moments = known.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(N_FEATURES)]).first()
    model.mean = np.array(moments[:N_FEATURES], dtype=float)
    model.scale = np.maximum(np.array(moments[N_FEATURES:], dtype=float), 1e-6)
    size = waves + 1

    def arrays(batch):
        return model.features(np.array(batch.column(0).to_pylist()).reshape(-1, N_FEATURES)), batch.column(1).to_numpy(zero_copy_only=False)

    def equations(batches):
        a = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z, y = arrays(batch)
                a[:, :size] += z.T @ z
                a[:, size] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in a], pa.binary())], names=["i", "row"])

    def add(key, t):
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([sum(np.frombuffer(r, dtype=float) for r in t.column("row").to_pylist()).tobytes()], pa.binary())})

    fitted = known.where("fold <> 3") if known.where("fold <> 3").limit(1).count() else known
    rows = fitted.select("x", "y").mapInArrow(equations, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").collect()
    a = np.array([np.frombuffer(bytes(r["row"]), dtype=float) for r in sorted(rows, key=lambda r: r["i"])])
    penalty = ridge * max(1.0, float(np.trace(a[:, :size])) / size)
    model.weights = np.linalg.solve(a[:, :size] + penalty * np.eye(size), a[:, size])

    def raw(batches):
        for batch in batches:
            if batch.num_rows:
                z, y = arrays(batch)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(z @ model.weights, -1, 2) * 500).astype(np.int32)), pa.array(y)], names=["bin", "y"])

    spare = known.where("fold = 3") if known.where("fold = 3").limit(1).count() else known
    bins = spare.select("x", "y").mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()
    model.knots, model.values = isotonic(np.array([r["bin"] / 500 for r in bins]), np.array([float(r["n"]) for r in bins]), np.array([r["p"] for r in bins]))
    stored.drop()
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of :func:`document_statistics` rows; no shuffle."""

    def run(batches):
        for batch in batches:
            s = model.score(np.array(batch.column(1).to_pylist()).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = stats.select("doc_id", "x", F.coalesce(F.col("fold") == 2, F.lit(False)).alias("held_out"))
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Calibrated quality of every whole text.

    Statistics are computed once, written to the shared folder, and used for fitting and scoring.
    A null or empty text gets the score of all-zero statistics; a null doc_id is never held out or
    learnt from; repeated rows get equal scores; other columns are ignored; empty tables are fine.
    """
    stats = Stored(document_statistics(docs), "statistics").df
    return score(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Documents, with all their columns, whose score reaches the threshold; texts are not shuffled."""
    stats = Stored(document_statistics(docs), "statistics")
    model = fit(stats.df, labels)
    stats.drop()

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score_texts(text))

    return docs.where(scored(docs["text"]) >= threshold)
