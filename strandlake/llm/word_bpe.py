"""Word-end BPE by rank-synchronous merging over ragged arrays.

Distinct pre-tokens of a batch lie end to end in one id array. A round looks up the rank of every
adjacent pair, takes the lowest rank of each pre-token with one segmented minimum, and applies that
pair in all pre-tokens at once; a pre-token without a known pair leaves the arrays. In a long pre-token
a round applies every pair that is the lowest within its reach: a pair of lower rank farther off would
first have to grow into a token that spans the distance, and tokens of lower rank are not that long.
Encoded pre-tokens are kept in a bounded dictionary of packed little-endian 32-bit ids.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

NONE = np.int64(1) << 40
CACHE_WORDS = 900_000
#: Pre-tokens of more bytes are merged by reach; chunks of more characters are not kept.
LONG, KEPT = 64, 1000
MARKS = ".,;:!?"
#: Beyond these characters, case mapping, composition and letter classes are left to the tokenizer's own parts.
PLAIN = re.compile(r"[^\x00-\x1b\x20-ɏ]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if visible Latin-1, else the next letter from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.split = Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.normalizer = Tokenizer.from_file(path).normalizer
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in letters], dtype=np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [(vocab[a] * int(self.width) + vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([k for k, _ in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([m for _, m in pairs], dtype=np.int64)
        made_bytes = [len((a + b).removesuffix(end) if end else a + b) for a, b in model["merges"]]
        #: By rank, the bytes of the longest token of a lower or equal rank.
        self.reach = np.maximum.accumulate(np.array(made_bytes, dtype=np.int64))
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        #: Keyed with a space in front, which no chunk of ordinary text can hold.
        self.special = {f" {k}": np.uint32(v).tobytes() for k, v in special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._merge(words, self._lowest)
        apart = set(long)
        short = [i for i in range(len(words)) if i not in apart]
        packed = self._merge([words[i] for i in short], self._lowest) + self._merge([words[i] for i in long], self._lowest_in_reach)
        found = dict(zip(short + long, packed, strict=True))
        return [found[i] for i in range(len(words))]

    @staticmethod
    def _lowest(rank: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs to apply, and where no pair is known in the whole pre-token."""
        least = np.repeat(np.minimum.reduceat(rank, first), size)
        idle = least == NONE
        return (rank == least) & ~idle, idle

    def _lowest_in_reach(self, rank: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        idle = np.repeat(np.minimum.reduceat(rank, first) == NONE, size)
        known = np.flatnonzero(rank != NONE)
        reach = np.zeros(len(rank), np.int64)
        reach[known] = self.reach[rank[known]]
        hit = np.zeros(len(rank), bool)
        least, stride, radius = rank, 1, 0
        while len(known):
            # minimum within the radius: 1, 4, 13, 40, ... places on both sides
            wide = least.copy()
            np.minimum(wide[stride:], least[:-stride], out=wide[stride:])
            np.minimum(wide[:-stride], least[stride:], out=wide[:-stride])
            radius += stride
            least, stride = wide, stride * 3
            known = known[rank[known] == least[known]]
            done = (reach[known] <= radius) | (radius >= len(rank))
            hit[known[done]] = True
            known = known[~done]
        # "aaa": a run of overlapping places goes as a whole or waits
        run = np.flatnonzero(np.r_[True, (rank[1:] != rank[:-1]) | (rank[1:] == NONE)])
        whole = np.minimum.reduceat(hit, run)
        return np.repeat(whole, np.diff(np.r_[run, len(rank)])), idle

    def _merge(self, words: list[bytes], lowest) -> list[bytes]:
        lens = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(lens) - 1
        full = lens > 0
        ids[ends[full]] = self.last[flat[ends[full]]]
        row = np.repeat(np.arange(len(words)), lens)
        row, ids = row[ids >= 0], ids[ids >= 0]
        done_rows, done_ids = [], []
        while len(ids):
            key = np.empty(len(ids), dtype=np.int64)
            key[:-1] = np.where(row[:-1] == row[1:], ids[:-1] * self.width + ids[1:], -1)
            key[-1] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NONE)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            hit, idle = lowest(rank, first, np.diff(np.r_[first, len(row)]))
            if idle.any():
                done_rows.append(row[idle])
                done_ids.append(ids[idle])
                live = ~idle
                row, ids, rank, hit = row[live], ids[live], rank[live], hit[live]
                if not len(ids):
                    break
            # "aaa": of overlapping places, every second one from the left
            here = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], here, -1))
            hit &= (here - start) % 2 == 0
            ids[hit] = self.made[rank[hit]]
            keep = ~np.r_[False, hit[:-1]]
            row, ids = row[keep], ids[keep]
        if not done_ids:
            return [b""] * len(words)
        row, ids = np.concatenate(done_rows), np.concatenate(done_ids)
        order = np.argsort(row, kind="stable")
        packed = ids[order].astype("<u4").tobytes()
        stop = np.cumsum(np.bincount(row, minlength=len(words))) * 4
        return [packed[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text between which no merge can happen, lower-cased; special strings stay whole."""
        if self.splitter and "<|" in text:
            out: list[str] = []
            for part in self.splitter.split(text):
                out += [f" {part}"] if f" {part}" in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() and not PLAIN.search(text):
            return text.lower().split()
        if PLAIN.search(text):
            return [f" {w}" for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return text.lower().split()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self.chunks(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.cache)
        if new:
            self._learn(list(new))
        out = [b"".join(map(self.cache.__getitem__, words)) for words in split]
        for c in new:
            if len(c) > KEPT:
                del self.cache[c]
        return out

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk: letters, with one mark after them at most, need no pattern.

        After a space stands a pre-token as the tokenizer's own pattern has cut it.
        """
        if chunk[0] == " ":
            return [chunk[1:]]
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _learn(self, chunks: list[str]) -> None:
        found = [[c] if c in self.special else self.words(c) for c in chunks]
        flat = list({w for words in found for w in words if w not in self.special}.difference(self.cache))
        packed = dict(zip(flat, self.merge([w.encode() for w in flat]), strict=True)) | self.special
        known = self.cache.get
        for c, words in zip(chunks, found, strict=True):
            self.cache[c] = b"".join([packed[w] if w in packed else known(w) for w in words])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per worker process and vocabulary file."""
    return WordBpe(path)
