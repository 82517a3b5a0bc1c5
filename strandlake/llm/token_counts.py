"""Operator 2: token counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.common import slices
from strandlake.llm.word_bpe import word_bpe

OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    No shuffle: each scan partition is counted where it is read. A null text counts as empty (0
    bytes, 0 tokens); a null doc_id stays null; repeated rows give repeated results; other columns
    are pruned, whatever their names; an empty table gives no rows.
    """

    def count(batches):
        bpe = word_bpe(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = []
            for part in slices(texts):
                tokens += [len(ids) // 4 for ids in bpe.encode_batch([texts[i] for i in part])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(count, OUT)
