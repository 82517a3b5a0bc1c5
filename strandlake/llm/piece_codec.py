"""Operator 7: SentencePiece (BPE) encoding and decoding by backtracking.

A segmentation is what merging by score gives exactly if every two neighbours, merged alone, give
themselves: the first merge across a boundary would be the same in the whole text and in the two
pieces around it. An Aho-Corasick automaton reads the text once and reports the pieces that end at each
position, and so those that begin at each. The encoder takes the longest of them that is compatible with
the one before it, a shorter one when it is not, and steps back when none is left; a bitfield holds the
positions from which no segmentation can go on, so each fails once.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from strandlake.llm.common import slices

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE_WORDS = 200_000
CACHE_PAIRS = 1_000_000
#: Characters that the automaton reads at a time, and of the longest chunk that is kept.
READ, KEPT = 4096, 1000
SPACE = "▁"
#: No piece goes on from another character into a space, and none holds a line feed: merges stay inside these.
CHUNK = re.compile(" *[^ \n]+|\n| +")


class PieceCodec:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        self.surface: dict[int, str | int] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte[b], self.surface[i] = i, b
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace(SPACE, " ")
                self.id[piece], self.score[piece] = i, model.get_score(i)
                self.surface[i] = piece
        self.letters = {p for p in self.id if len(p) == 1}
        self.splits = not any("\n" in p or " " in p.lstrip(" ") for p in self.id)
        self.width = max(map(len, self.id), default=1)
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1:  # every letter begins at its own place
                self.automaton.add_word(p, (p, len(p) - 1))
        self.automaton.make_automaton()
        self.shown = {p: str(i) for p, i in self.id.items()}
        self.words: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def compatible(self, a: str, b: str) -> bool:
        """Whether the two, merged anew from characters, come out as they are."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            symbols = list(a + b)
            while len(symbols) > 1:
                best, at = None, -1
                for k in range(len(symbols) - 1):
                    s = self.score.get(symbols[k] + symbols[k + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, k
                if best is None:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            got = self.pairs[a, b] = symbols == ([a, b] if a else [b])
        return got

    def beginning(self, text: str, low: int) -> list[list[str]]:
        """For the ``READ`` positions from ``low``, the pieces that begin there, shortest first."""
        high = min(len(text), low + READ)
        found = [[c] for c in text[low:high]]
        if not low and high == len(text):
            for last, (piece, back) in self.automaton.iter(text):
                found[last - back].append(piece)
            return found
        for last, (piece, back) in self.automaton.iter(text, low, min(len(text), high + self.width - 1)):
            if last - back < high:
                found[last - back - low].append(piece)
        return found

    def segment(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        whole, pairs, pos, before = len(text), self.pairs, 0, ""
        failed = bytearray(whole // 8 + 1)
        block, read = 0, self.beginning(text, 0)
        here = read[0].copy()
        out: list[str] = []
        tried: list[list[str]] = []  # of each piece in ``out``, the shorter ones at its place
        while True:
            while here:
                piece = here.pop()
                stop = pos + len(piece)
                if failed[stop >> 3] >> (stop & 7) & 1:
                    continue
                fits = pairs.get((before, piece))
                if fits is None:
                    fits = self.compatible(before, piece)
                if fits:
                    break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                here = tried.pop()
                pos -= len(out.pop())
                before = out[-1] if out else ""
                continue
            out.append(piece)
            if stop == whole:
                return out
            tried.append(here)
            pos, before = stop, piece
            if pos // READ != block:
                block = pos // READ
                read = self.beginning(text, block * READ)
            here = read[pos - block * READ].copy()

    def encode_part(self, text: str) -> list[int]:
        """Ids of a chunk; characters outside the vocabulary become their bytes."""
        if self.letters.issuperset(text):
            return [self.id[p] for p in self.segment(text)]
        ids: list[int] = []
        known = ""
        for c in [*text, None]:
            if c in self.letters:
                known += c
                continue
            if known:
                ids += [self.id[p] for p in self.segment(known)]
                known = ""
            if c is not None:
                ids += [self.byte[b] for b in c.encode()]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts in front; the end id has none."""
        return self._join(ids).removeprefix(" ")

    def _join(self, ids: list[int]) -> str:
        shown = [self.surface.get(i, "") for i in ids]
        if int not in map(type, shown):
            return "".join(shown)
        out, run = [], bytearray()
        for i in ids:
            s = self.surface.get(i, "")
            if isinstance(s, int):
                run.append(s)
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(s)
        return "".join(out) + run.decode(errors="replace")

    def encode(self, text: str) -> list[int]:
        """All ids of a text with the end id."""
        shown = self.digest(text)[0]
        return list(map(int, shown.split()))

    def _learnt(self, chunk: str) -> tuple[str, int, str]:
        if self.letters.issuperset(chunk):
            pieces = self.segment(chunk)
            return " ".join(map(self.shown.__getitem__, pieces)), len(pieces), chunk
        ids = self.encode_part(chunk)
        return " ".join(map(str, ids)), len(ids), self._join(ids)

    def digest(self, text: str) -> tuple[str, int, str]:
        """Ids joined by spaces, their number, the decoded text."""
        if not text:
            return str(self.end), 1, ""
        text = " " + text.replace(SPACE, " ")
        chunks = CHUNK.findall(text) if self.splits else [text]
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        words = self.words
        found = list(map(words.get, chunks))
        for k, got in enumerate(found):
            if got is None:
                chunk = chunks[k]
                got = words.get(chunk) or self.older.get(chunk) or self._learnt(chunk)
                found[k] = got
                if len(chunk) <= KEPT:
                    words[chunk] = got
        shown, n, decoded = zip(*found, strict=True)
        return f"{' '.join(shown)} {self.end}", sum(n) + 1, "".join(decoded).removeprefix(" ")


@lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    """One per worker process and model file."""
    return PieceCodec(path)


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """Ids (with an end id) and decoded text of every whole text, as digests.

    No shuffle. A null or empty text has the end id alone and decodes to the empty text. A null
    doc_id stays null; repeated rows give repeated results; other columns are pruned; an empty table
    gives no rows. :class:`PieceCodec` has the ids and texts themselves.
    """

    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, decoded = [], [], []
            for part in slices(texts):
                for i in part:
                    shown, count, text = codec.digest(texts[i])
                    n.append(count)
                    ids.append(hashlib.sha256(shown.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, OUT)
