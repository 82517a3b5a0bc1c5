"""Chunkers that need a loop per text (CHK-3, CHK-4); one text is one row's work."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LADDER = ("\n\n", "\n", " ", "")


def recursive_chunks(text: str, size: int = 3000, overlap: int = 600, ladder: tuple[str, ...] = LADDER) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that works, overlapping."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    sep = next((s for s in ladder if s in text), "")
    finer = ladder[ladder.index(sep) + 1 :]
    parts = text.split(sep) if sep else list(text)
    out: list[str] = []
    held: deque[str] = deque()
    size_held = 0  # characters of the held parts with a separator after each
    for p in (p for p in parts if p):
        if len(p) > size:
            if held:
                out.append(sep.join(held))
                held.clear()
                size_held = 0
            out += recursive_chunks(p, size, overlap, finer or ("",))
            continue
        if held and size_held + len(p) > size:
            out.append(sep.join(held))
            while held and (size_held - len(sep) > overlap or size_held + len(p) > size):
                size_held -= len(held.popleft()) + len(sep)
        held.append(p)
        size_held += len(p) + len(sep)
    if held:
        out.append(sep.join(held))
    return [x.strip() for x in out if x.strip()]


def token_chunks(text: str, budget: int = 300, overlap: int = 50, tokens: Callable[[str], int] = lambda s: len(s.split())) -> list[str]:
    """Whole sentences up to a budget of tokens; trailing sentences within the overlap begin the next."""
    out: list[list[str]] = []
    held: list[tuple[str, int]] = []
    total = 0
    for s in (s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()):
        n = tokens(s)
        if held and total + n > budget:
            out.append([x for x, _ in held])
            kept, first = 0, len(held)
            while first and kept + held[first - 1][1] <= overlap:
                first -= 1
                kept += held[first][1]
            held, total = (held[first:], kept) if kept + n <= budget else ([], 0)
        held.append((s, n))
        total += n
    if held:
        out.append([x for x, _ in held])
    return [" ".join(x) for x in out]


def chunked(docs: DataFrame, split: Callable[[str], list[str]]) -> DataFrame:
    """doc_id, chunk_no, chunk of every text; null texts give no chunk."""

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return pd.Series([split(t) if t else [] for t in text])

    return docs.select("doc_id", F.posexplode(cut("text")).alias("chunk_no", "chunk"))
