import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm import packing, piece_codec, token_counts
from strandlake.llm.word_bpe import WordBpe
from tests.llm.corpus import frame, texts

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY, MINE = Tokenizer.from_file(WORDS), WordBpe(WORDS)
MODEL, CODEC = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES)
ODD = ["a", "b", "'s", "'LL", "Σ", "ΑΣ", "é", "é", "İ", "\x1c", "\x1f", "\x85", "\xa0", " ", "  ", "\n", "\t", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "1", "½", "日", "😀", "!!", ".", "ß", "ǅ", "▁", "</s>", "the", "aaaa", "\x00", "_", "word,"]


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_odd_texts_match_the_libraries():
    rnd = random.Random(8)
    odd = ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(0, 40))) for _ in range(1500)]
    assert [ids(x) for x in MINE.encode_batch(odd)] == [e.ids for e in LIBRARY.encode_batch(odd, add_special_tokens=False)]
    for t in odd:
        want = MODEL.encode(t, add_eos=True)
        assert CODEC.encode(t) == want and CODEC.decode(want) == MODEL.decode(want)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_matches_the_libraries(t):
    assert ids(MINE.encode_batch([t])[0]) == LIBRARY.encode(t, add_special_tokens=False).ids
    want = MODEL.encode(t, add_eos=True)
    assert CODEC.encode(t) == want and CODEC.digest(t)[2] == MODEL.decode(want)


UNBROKEN = {
    "letters": lambda rnd, n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
    "one letter": lambda rnd, n: "a" * n,
    "two letters": lambda rnd, n: "ab" * (n // 2),
    "words": lambda rnd, n: "".join(rnd.choice(["the", "under", "standing", "qua", "lity", "er"]) for _ in range(n // 4)),
    "digits": lambda rnd, n: "0123456789" * (n // 10),
    "mixed": lambda rnd, n: "".join(rnd.choice(["a", "é", "日", "aa", "ing", "ß"]) for _ in range(n)),
}


@pytest.mark.parametrize("kind", UNBROKEN)
def test_unbroken_texts_match_the_libraries(kind):
    rnd = random.Random(3)
    for n in (60, 65, 70, 200, 5000, 20_000):
        t = UNBROKEN[kind](rnd, n)
        assert ids(MINE.encode_batch([t])[0]) == LIBRARY.encode(t, add_special_tokens=False).ids
        want = MODEL.encode(t, add_eos=True)
        assert CODEC.encode(t) == want and CODEC.digest(t)[2] == MODEL.decode(want)


def test_a_megabyte_without_a_break_takes_seconds():
    t = UNBROKEN["letters"](random.Random(5), 1_000_000)
    start = time.process_time()
    got, shown = ids(MINE.encode_batch([t])[0]), CODEC.digest(t)
    assert time.process_time() - start < 60
    assert got == LIBRARY.encode(t, add_special_tokens=False).ids and shown[2] == t
    assert t not in MINE.cache and not any(len(x) > piece_codec.KEPT for x in CODEC.words)


def test_counts_and_codec(spark):
    rows = list(enumerate(texts())) + [(None, "long text " * 3000)]
    for r in token_counts.token_counts(frame(spark, rows), WORDS).collect():
        t = dict(rows)[r["doc_id"]] or ""
        n = len(LIBRARY.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)
    for r in piece_codec.encode_decode(frame(spark, rows), PIECES).collect():
        want = MODEL.encode(dict(rows)[r["doc_id"]] or "", add_eos=True)
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(MODEL.decode(want).encode()).hexdigest()
    assert token_counts.token_counts(frame(spark, []), WORDS).count() == piece_codec.encode_decode(frame(spark, []), PIECES).count() == 0


def test_packing(spark):
    rows = list(enumerate(texts())) + [(9000, "many words here " * 2000), (9000, "again"), (None, "no id")]
    out = packing.pack(frame(spark, rows).repartition(3), WORDS).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in out)
    pieces = {}
    for r in out:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for key, t in rows:
        want = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[key, len(want)], key=lambda r: r["start"])
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
        assert ids(b"".join(bytes(r["ids"]) for r in mine)) == want
    assert packing.pack(frame(spark, []), WORDS).count() == 0
