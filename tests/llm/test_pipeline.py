"""The classifier and the whole pipeline against plain versions on one machine."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strandlake.llm import quality_classifier
from strandlake.llm.common import table
from tests.llm.test_text_dedup import brute_jaccard, brute_lines
from tests.llm.test_tokens import WORDS

SMALL = "/root/testdata/sf0.001"


def plain_statistics(text):
    """Shares of byte classes, then counts of words and lines, by counting one by one."""
    raw = list(text.encode())
    if not raw:
        return [0.0] * 18
    classes = [range(65, 91), range(97, 123), range(48, 58), b"!?", b"#$%&*@^~", b"|<>=[]{}\\/", b".,;:", b" \t", b"\n\r", range(128, 256)]
    shares = [sum(1 for b in raw if b in set(c)) / len(raw) for c in classes]
    words, lines = text.split(), text.split("\n")
    n, kinds = max(1, len(words)), Counter(words)
    again = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return [*shares, math.log(1 + len(raw)), math.log(1 + n), len(raw) / n, len(kinds) / n, math.log((1 + n) / (1 + len(kinds))), again / n, 1 - len(Counter(lines)) / len(lines), math.log(1 + len(raw) / len(lines))]


def plain_isotonic(x, n, p):
    """The least-squares rates by their min-max formula; equal neighbours are one pool."""
    mean = lambda a, b: sum(p[a : b + 1]) / sum(n[a : b + 1])
    rate = [max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))]
    knots, values = [], []
    for i in range(len(x)):
        if i and abs(rate[i] - rate[i - 1]) < 1e-12:
            knots[-1] = (knots[-1][0] + x[i] * n[i], knots[-1][1] + n[i])
        else:
            knots.append((x[i] * n[i], n[i]))
            values.append(rate[i])
    return [a / b for a, b in knots], values


def plain_scores(docs, labels, waves=256, ridge=1e-3, seed=7):
    """Scores of (doc_id, text) rows: Fourier features, one ridge system, isotonic rates on fold 3."""
    marks = {}
    for key, quality in labels:
        if quality is not None:
            marks[key] = min(marks.get(key, 1), quality)
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    x = np.array([plain_statistics(t or "") for _, t in docs])
    known = [i for i, (k, _) in enumerate(docs) if k in marks and fold(k) != 2]
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(18, waves)) / np.sqrt(18)
    phase = rng.uniform(0, 2 * np.pi, waves)
    scale = np.maximum(x[known].std(axis=0), 1e-6)
    z = np.cos(np.clip((x - x[known].mean(axis=0)) / scale, -8, 8) @ w + phase) * np.sqrt(2 / waves)
    z = np.c_[z, np.ones(len(z))]
    y = np.array([float(marks.get(k, 0)) for k, _ in docs])
    rows = [i for i in known if fold(docs[i][0]) != 3]
    gram = z[rows].T @ z[rows]
    weights = np.linalg.inv(gram + ridge * max(1.0, np.trace(gram) / len(gram)) * np.eye(len(gram))) @ (z[rows].T @ y[rows])
    raw = z @ weights
    bins = {}
    for i in known:
        if fold(docs[i][0]) == 3:
            b = round(float(np.clip(raw[i], -1, 2)) * 500)
            n, p = bins.get(b, (0, 0.0))
            bins[b] = (n + 1, p + y[i])
    at = sorted(bins)
    knots, values = plain_isotonic([b / 500 for b in at], [bins[b][0] for b in at], [bins[b][1] for b in at])
    return np.clip(np.interp(raw, knots, values), 0, 1)


def read(name, *columns):
    return list(pd.read_parquet(f"{SMALL}/{name}.parquet")[list(columns)].astype(object).itertuples(index=False, name=None))


def test_isotonic_against_its_formula():
    rng = np.random.default_rng(1)
    for size in (1, 2, 9, 40):
        x, n = np.sort(rng.normal(size=size)), rng.integers(1, 5, size).astype(float)
        p = np.array([rng.integers(0, k + 1) for k in n]).astype(float)
        knots, values = quality_classifier.isotonic(x, n, p)
        want = plain_isotonic(list(x), list(n), list(p))
        assert knots == pytest.approx(want[0]) and values == pytest.approx(want[1])


def test_scores_against_a_plain_version(spark):
    docs = read("documents", "doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).collect()}
    want = plain_scores(docs, read("labels", "doc_id", "quality"))
    assert len(got) == len(docs) and [got[k] for k, _ in docs] == pytest.approx(want.tolist(), abs=1e-6)


def cut_repeats(rows, length=100):
    """Texts without strings of 100 bytes that start earlier, whole characters only."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = [True] * length
            seen.add(raw[s : s + length])
        at, kept = 0, b""
        for c in text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept += c.encode()
            at += n
        if not text or kept:
            out.append((key, kept.decode()))
    return out


def test_pipeline_against_a_plain_version(spark):
    """Every stage on all its predecessor kept, down to the checksums of the packed pieces."""
    docs = read("documents", "doc_id", "text")
    scores = plain_scores(docs, read("labels", "doc_id", "quality"))
    docs = [d for d, s in zip(docs, scores, strict=True) if s >= 0.7]
    docs = [(k, t) for (k, t), (_, was) in zip(brute_lines(docs), docs, strict=True) if t or not was]
    group = brute_jaccard(docs)
    docs = [(k, t) for k, t in docs if group[k][1] == k]
    docs = cut_repeats(docs)
    library, want = Tokenizer.from_file(WORDS), []
    for key, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for length in [2048] * (len(ids) // 2048) + [1 << b for b in range(11, -1, -1) if len(ids) % 2048 >> b & 1]:
            want.append((key, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids)))
            at += length
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(want) and 0 < len(docs) < 200
