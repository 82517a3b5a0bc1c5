"""Operator 1: repeated 100-byte strings by merging Burrows-Wheeler transforms.

Candidates. Every 100-byte window is assigned to the smallest hash among its ``K``-byte substrings
(its anchor), so equal windows have equal anchors. The windows of an anchor and the bytes they cover
are a snippet. Anchors that occur once hold no repeats and leave. Of equal snippets one, the earliest,
stands for all in the merge and its suffixes carry the places of the others: within a buffer equal
snippets are compared as bytes, beyond it by 96 bits of two hashes with bases of their own. An anchor
of very many distinct snippets is dealt window by window instead, each by its own hash.

Merge. The snippets of the other anchors meet by anchor. Each batch of them is a shard with
its own transform over symbols of ``STEP`` bytes. Shards are merged by refining the interleave (Holt and
McMillan 2014): a round deals the suffixes' shard numbers into the blocks of the symbols that precede
them, stably, and so sorts the merged suffixes by one more symbol; block boundaries give the common
prefixes (Egidi and Manzini 2017). After ``LENGTH / STEP`` rounds a block is an interval of equal
windows; all its places but the earliest are repeats, those of the snippets themselves after a
comparison of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Stored, parts, text_bytes
from strandlake.llm.embedding_dedup import keyed_runs

LENGTH, STEP, K = 100, 25, 28
BUFFER = 1 << 21
U = np.uint64
#: Snippets of a shard, and of a merge; distinct snippets beyond which an anchor is dealt window by window; rows of a bucket held at a time.
SHARD, MERGED, WIDE_FROM, HELD = 500, 2_500, 50_000, 200_000
BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
LETTERS = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1) for seed in (100, 101)]
#: doc_id, place of the anchor's first window, number of windows less one.
RANGE = np.dtype([("doc", "<i8"), ("at", "<u4"), ("more", "u1")])
_powers: list[tuple[np.ndarray, np.ndarray]] | None = None


def powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    global _powers
    if _powers is None:
        _powers = []
        for base in BASES:
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(BUFFER + LENGTH, b, dtype=np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            _powers.append((both[0], both[1]))
    return _powers[which]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    return h


class Hashes:
    """Hashes of all substrings of a buffer of at most ``BUFFER + LENGTH`` bytes."""

    def __init__(self, buffer: np.ndarray, which: int = 0):
        up, self.down = powers(which)
        self.sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(LETTERS[which][buffer] * up[: len(buffer)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n])


def window_groups(buffer: np.ndarray, starts: np.ndarray, lens: np.ndarray):
    """Anchor hash, first window and number of windows of each run with one anchor, and the buffer's hashes.

    ``starts`` and ``lens``: the texts in the buffer; no window crosses them.
    """
    h = Hashes(buffer)
    grams = h.every(K)
    # of equal values the leftmost counts: low bits hold the place, which has under 24 bits
    low = (grams & ~U(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    width, span = LENGTH - K + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: -(width - span)], low[width - span :])
    anchor = (low & U(0xFFFFFF)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, dtype=np.int32)
    inside = lens >= LENGTH
    np.add.at(valid, starts[inside], 1)
    np.add.at(valid, starts[inside] + lens[inside] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    a = anchor[at]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
    count = np.diff(np.r_[first, len(at)])
    start = at[first]
    return grams[anchor[start]], start, count, h


def _fill(batches, column: int = 1):
    """Texts cut and gathered into buffers: (doc ids, places in their texts, starts, lens, bytes).

    A piece of a long text overlaps the next one by ``LENGTH - 1`` bytes, so each window is in one.
    """
    keys, places, chunks, size = [], [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(column).to_pylist(), strict=True):
            raw = (text or "").encode()
            for at in range(0, max(1, len(raw) - LENGTH + 1), BUFFER // 4):
                piece = raw[at : at + BUFFER // 4 + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                if size + len(piece) > BUFFER:
                    yield keys, places, chunks
                    keys, places, chunks, size = [], [], [], 0
                keys.append(key)
                places.append(at)
                chunks.append(piece)
                size += len(piece)
    if chunks:
        yield keys, places, chunks


def _grouped(order_keys: list[np.ndarray]) -> np.ndarray:
    """First of each run of equal rows, for arrays sorted together."""
    new = np.zeros(len(order_keys[0]), bool)
    new[:1] = True
    for k in order_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _again(new: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of sorted classes, the members that start elsewhere than their first (a repeated row does not)."""
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[lead]) | (at != at[lead])


def _by_doc(ranges: np.ndarray, kind: int):
    """Rows (doc_id, kind, packed ranges, nothing), one per document, of ranges in any order."""
    ranges = ranges[np.lexsort((ranges["at"], ranges["doc"]))]
    cuts = np.r_[np.flatnonzero(_grouped([ranges["doc"]])), len(ranges)]
    return [(int(ranges["doc"][a]), kind, ranges[a:b].tobytes(), None) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)] if len(ranges) else []


REPEAT, OPEN, COPY, WIDE, MESSAGE = range(5)
#: Of a snippet on its way: hash of the anchor, two of its bytes.
KEY = np.dtype([("anchor", "<u4"), ("whole", "<u8"), ("second", "<u4")])
ROW = "key long, kind int, ranges binary, hashes binary"
ROW_SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("ranges", pa.binary()), ("hashes", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW_SCHEMA, strict=True)], schema=ROW_SCHEMA)


def _by_bucket(bucket: np.ndarray, kind: int, ranges: np.ndarray, hashes: np.ndarray) -> list[tuple]:
    """Rows (bucket, kind, packed ranges, packed hashes), one per bucket, of sorted buckets."""
    cuts = np.r_[np.flatnonzero(_grouped([bucket])), len(bucket)]
    return [(int(bucket[a]), kind, ranges[a:b].tobytes(), hashes[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _places(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All places of runs of bytes, end to end."""
    return np.repeat(start - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())


def _same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether the runs of bytes at a and b are equal."""
    same = np.ones(len(a), bool)
    for lo in range(0, len(a), 5_000):
        x, y, n = a[lo : lo + 5_000], b[lo : lo + 5_000], lens[lo : lo + 5_000]
        alike = buffer[_places(x, n)] == buffer[_places(y, n)]
        same[lo : lo + 5_000] = np.logical_and.reduceat(alike, np.r_[0, np.cumsum(n)[:-1]])
    return same


def _anchors(docs: DataFrame, buckets: int, reduce: bool) -> DataFrame:
    """Packed snippets' hashes by bucket of the anchor; by document the snippets that equal an earlier one of the buffer."""

    def run(batches):
        for keys, places, chunks in _fill(batches):
            lens = np.array([len(c) for c in chunks])
            starts = np.r_[0, np.cumsum(lens)[:-1]]
            buffer = np.frombuffer(b"".join(chunks), np.uint8)
            anchor, start, count, h = window_groups(buffer, starts, lens)
            stop = start + count - 1 + LENGTH
            owner = np.searchsorted(starts, start, side="right") - 1
            ranges = np.empty(len(start), RANGE)
            ranges["doc"] = np.array(keys, np.int64)[owner]
            ranges["at"] = start - starts[owner] + np.array(places)[owner]
            ranges["more"] = count - 1
            hashes = np.empty(len(start), KEY)
            hashes["anchor"] = anchor >> U(32)
            hashes["whole"] = h.of(start, stop)
            hashes["second"] = Hashes(buffer, 1).of(start, stop) >> U(32)
            bucket = (anchor % U(buckets)).astype(np.int64)
            order = np.lexsort((ranges["at"], ranges["doc"], hashes["second"], hashes["whole"], anchor, bucket))
            anchor, hashes, ranges, bucket, start = anchor[order], hashes[order], ranges[order], bucket[order], start[order]
            rows = []
            if reduce:
                new = _grouped([anchor, hashes["whole"], hashes["second"]])
                lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                later = np.flatnonzero(~new)
                alike = later[_same_bytes(buffer, start[later], start[lead[later]], ranges["more"][later].astype(np.int64) + LENGTH)]
                elsewhere = alike[_again(new, ranges["doc"], ranges["at"])[alike]]
                rows = _by_doc(ranges[elsewhere], REPEAT)
                stay = np.ones(len(new), bool)
                stay[alike] = False
                # a repeat of a snippet is told to the bucket by a second row of it
                told = np.zeros(len(new), bool)
                told[lead[elsewhere]] = True
                hashes, ranges, bucket, told = hashes[stay], ranges[stay], bucket[stay], told[stay]
                twice = np.repeat(np.arange(len(told)), 1 + told)
                hashes, ranges, bucket = hashes[twice], ranges[twice], bucket[twice]
            yield _rows(rows + _by_bucket(bucket, MESSAGE, ranges, hashes))

    return docs.mapInArrow(run, ROW)


class Classes:
    """Snippets of a bucket by anchor and equality; gives rows away before it holds many more than ``most``."""

    def __init__(self, bucket: int, reduce: bool, wide_from: int, most: int):
        self.bucket, self.reduce, self.wide_from, self.most = bucket, reduce, wide_from, most
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.wide = np.empty(0, np.uint32)

    def add(self, ranges: np.ndarray, hashes: np.ndarray) -> list[tuple]:
        self.held.append((ranges, hashes, np.zeros(len(ranges), bool)))
        self.size += len(ranges)
        return self._compact() if self.size > self.most else []

    def _compact(self) -> list[tuple]:
        """Copies, and snippets of wide anchors, as rows; of each class its earliest member stays, and whether it has copies.

        An anchor that turns out wide also opens its snippets that have had copies, as these know no other.
        """
        ranges, hashes, copied = (np.concatenate(x) for x in zip(*self.held, strict=True))
        wide = np.isin(hashes["anchor"], self.wide)
        rows = _by_doc(ranges[wide], WIDE)
        ranges, hashes, copied = ranges[~wide], hashes[~wide], copied[~wide]
        order = np.lexsort((ranges["at"], ranges["doc"], hashes["second"], hashes["whole"], hashes["anchor"]))
        ranges, hashes, copied = ranges[order], hashes[order], copied[order]
        if self.reduce and len(ranges):
            new = _grouped([hashes["anchor"], hashes["whole"], hashes["second"]])
            again = _again(new, ranges["doc"], ranges["at"])
            rows += _by_bucket(np.full(int(again.sum()), self.bucket), COPY, ranges[again], hashes[again])
            first = np.flatnonzero(new)
            # several rows with equal places: a snippet with a repeat in its own buffer, or a repeated document
            copied = np.logical_or.reduceat(copied, first) | (np.diff(np.r_[first, len(new)]) > 1)
            ranges, hashes = ranges[first], hashes[first]
        first = np.flatnonzero(_grouped([hashes["anchor"]]))
        count = np.diff(np.r_[first, len(ranges)])
        wide = np.repeat(count > self.wide_from, count)
        if wide.any():
            self.wide = np.union1d(self.wide, hashes["anchor"][wide])
            rows += _by_doc(ranges[wide], WIDE) + _by_doc(ranges[wide & copied], OPEN)
        self.held = [(ranges[~wide], hashes[~wide], copied[~wide])]
        self.size = int((~wide).sum())
        return rows

    def end(self) -> list[tuple]:
        """What is left: snippets to merge, of anchors that occur twice or more."""
        if not self.held:
            return []
        rows = self._compact()
        ranges, hashes, copied = self.held[0]
        same = np.zeros(len(ranges) + 1, bool)
        same[1:-1] = hashes["anchor"][1:] == hashes["anchor"][:-1]
        return rows + _by_doc(ranges[same[:-1] | same[1:] | copied], OPEN)


def _classes(messages: DataFrame, n: int, reduce: bool) -> DataFrame:
    """By document: REPEAT, snippets that equal an earlier one of their buffer; OPEN, to be merged; WIDE, to be
    dealt by window. By bucket: COPY, the places of snippets that equal a merged one."""
    wide_from, most = WIDE_FROM, HELD

    def run(batches):
        for group in keyed_runs(batches, 2):
            key, kind = group[0].column(0)[0].as_py(), group[0].column(1)[0].as_py()
            if kind != MESSAGE:
                yield from group
                continue
            classes = Classes(key, reduce, wide_from, most)
            for batch in group:
                for r, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    rows = classes.add(np.frombuffer(r, RANGE), np.frombuffer(h, KEY))
                    if rows:
                        yield _rows(rows)
            rows = classes.end()
            if rows:
                yield _rows(rows)

    return messages.repartition(n, "key").sortWithinPartitions("key", "kind").mapInArrow(run, ROW)


def _of_documents(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, text and the packed ranges of each document that has some."""
    lists = rows.groupBy(F.col("key").alias("doc_id")).agg(F.collect_list("ranges").alias("ranges"))
    return docs.join(lists.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "ranges")


def _cut(batches, each: bool):
    """Snippets of the ranges, or their windows one by one: (ranges, bytes, lens) of bounded size."""
    held, size, step = [], 0, max(1, BUFFER // (2 * (LENGTH + 255)))
    for batch in batches:
        for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            ranges = np.concatenate([np.frombuffer(p, RANGE) for p in packed])
            ranges = ranges[np.unique(ranges["at"].astype(np.int64) * 256 + ranges["more"], return_index=True)[1]]
            ranges = ranges[ranges["at"].astype(np.int64) + ranges["more"] + LENGTH <= len(raw)]
            if each:
                n = ranges["more"].astype(np.int64) + 1
                at = _places(ranges["at"].astype(np.int64), n)
                ranges = np.repeat(ranges, n)
                ranges["at"], ranges["more"] = at, 0
            for lo in range(0, len(ranges), step):
                part = ranges[lo : lo + step]
                lens = part["more"].astype(np.int64) + LENGTH
                held.append((part, raw[_places(part["at"].astype(np.int64), lens)], lens))
                size += int(lens.sum())
                if size > BUFFER // 2:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _windows(docs: DataFrame, wide: DataFrame, buckets: int) -> DataFrame:
    """Messages of single windows, by bucket of their own hash."""

    def run(batches):
        for ranges, flat, lens in _cut(batches, True):
            if not len(ranges):
                continue
            start = np.r_[0, np.cumsum(lens)[:-1]]
            hashes = np.empty(len(ranges), KEY)
            hashes["whole"] = Hashes(flat).of(start, start + lens)
            hashes["anchor"] = hashes["whole"] >> U(32)
            hashes["second"] = Hashes(flat, 1).of(start, start + lens) >> U(32)
            bucket = (hashes["whole"] % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            yield _rows(_by_bucket(bucket[order], MESSAGE, ranges[order], hashes[order]))

    return _of_documents(docs, wide).mapInArrow(run, ROW)


def _snippets(docs: DataFrame, opened: DataFrame, buckets: int, single: bool) -> DataFrame:
    """Snippets to merge: their hashes and bytes, packed by bucket of their anchors; single windows by that of their hash."""

    def run(batches):
        for ranges, flat, lens in _cut(batches, False):
            if not len(ranges):
                continue
            start = np.r_[0, np.cumsum(lens)[:-1]]
            whole, second = (Hashes(flat, which).of(start, start + lens) for which in (0, 1))
            # a snippet's first window has its anchor: the same bucket as in the first step
            anchor = whole if single else first_anchor(flat, start)
            bucket = (anchor % U(buckets)).astype(np.int64)
            hashes = np.empty(len(ranges), KEY)
            hashes["anchor"], hashes["whole"], hashes["second"] = anchor >> U(32), whole, second >> U(32)
            order = np.argsort(bucket, kind="stable")
            rows = [(*row[:3], row[3]) for row in _by_bucket(bucket[order], OPEN, ranges[order], hashes[order])]
            flats, at = [], 0
            for row in rows:
                who = order[at : at + len(row[2]) // RANGE.itemsize]
                flats.append(flat[_places(start[who], lens[who])].tobytes())
                at += len(who)
            key, kind, packed, keys = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(packed, pa.binary()), pa.array(keys, pa.binary()), pa.array(flats, pa.binary())], names=["key", "kind", "ranges", "hashes", "bytes"])

    return _of_documents(docs, opened).mapInArrow(run, f"{ROW}, bytes binary")


def first_anchor(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Anchor hash of the window at each start."""
    grams = Hashes(buffer).every(K)
    at = starts[:, None] + np.arange(LENGTH - K + 1)
    near = grams[at]
    best = np.argmin(near >> U(24), axis=1)
    return near[np.arange(len(starts)), best]


def sorted_places(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places, both under 2**32, sorted by key and place: one sort of keys with their places behind them."""
    both = (keys.astype(np.uint64) << U(32)) | places.astype(np.uint64)
    both.sort()
    return (both >> U(32)).astype(np.uint32), (both & U(0xFFFFFFFF)).astype(np.int64)


def stable_order(keys: np.ndarray) -> np.ndarray:
    return sorted_places(keys, np.arange(len(keys), dtype=np.uint64))[1]


def named(grams: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the different values, in their order."""
    order = stable_order(grams >> U(32))
    g = grams[order]
    top = np.r_[True, (g[1:] >> U(32)) != (g[:-1] >> U(32))]
    mixed_up = np.flatnonzero(~top & np.r_[False, g[1:] != g[:-1]])
    if len(mixed_up):  # different values with equal upper halves: their groups are sorted in full
        group = np.cumsum(top)
        rows = np.flatnonzero(np.isin(group, group[mixed_up]))
        order[rows] = order[rows][np.argsort(g[rows], kind="stable")]
        g = grams[order]
    names = np.empty(len(grams), np.uint32)
    names[order] = np.cumsum(np.r_[True, g[1:] != g[:-1]])
    return names


class Shard:
    """Snippets with sorted suffixes and the transform of their symbols.

    Places are the snippets' bytes and one end each. A place's symbol names its ``STEP`` bytes, 0 where
    fewer are left; its suffix is the symbols at every ``STEP``-th place from it. Suffixes are ranked by
    one symbol, then by doubling.
    """

    def __init__(self, symbols: np.ndarray, back: np.ndarray, first_place: int):
        self.n = len(symbols)
        rank, ahead = symbols, STEP
        while ahead < LENGTH:
            # a place without ``ahead`` bytes left has a rank that says so, and nothing behind it counts
            behind = np.zeros(self.n, np.uint32)
            behind[: self.n - ahead] = rank[ahead:]
            full = np.zeros(self.n, bool)
            step = symbols > 0
            full[: self.n - ahead] = step[: self.n - ahead]
            for k in range(STEP, ahead, STEP):
                full[: self.n - ahead] &= step[k : self.n - ahead + k]
            behind[~full] = 0
            order = stable_order(behind)
            r, at = sorted_places(rank[order], np.arange(self.n))
            order = order[at]
            s = behind[order]
            fresh = np.empty(self.n, np.uint32)
            fresh[order] = np.cumsum(np.r_[False, (r[1:] != r[:-1]) | (s[1:] != s[:-1])]) if self.n else 0
            rank, ahead = fresh, ahead * 2
        self.suffixes = order + first_place
        self.transform = np.where(back[order], symbols[order - STEP], 0)
        self.ends = int((symbols == 0).sum())


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all shards, sorted by ``LENGTH`` bytes, and each one's block of equal ones."""
    numbers = np.arange(len(shards), dtype=np.uint32)
    interleave = np.repeat(numbers, [s.n for s in shards])
    blocks = np.zeros(len(interleave), np.uint32)
    ends = np.repeat(numbers, [s.ends for s in shards])
    transform = np.concatenate([s.transform for s in shards])
    for _ in range(LENGTH // STEP):
        symbol = np.empty(len(interleave), transform.dtype)
        # a shard's symbols keep their order wherever the interleave puts them
        symbol[stable_order(interleave)] = transform
        known = np.flatnonzero(symbol)
        of, order = sorted_places(symbol[known], known)
        blocks, interleave = blocks[order], interleave[order]
        new = np.ones(len(order), bool)
        new[1:] = (of[1:] != of[:-1]) | (blocks[1:] != blocks[:-1])
        interleave = np.concatenate([ends, interleave])
        blocks = np.concatenate([np.zeros(len(ends), np.uint32), np.cumsum(new, dtype=np.uint32)])
    place = np.empty(len(interleave), np.int64)
    place[stable_order(interleave)] = np.concatenate([s.suffixes for s in shards])
    return place, blocks


def repeated_windows(ranges: np.ndarray, flat: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Ranges (of one window each) that repeat an earlier one, of ranges and their bytes, with ``shard`` snippets a shard."""
    lens = ranges["more"].astype(np.int64) + LENGTH
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    # one extra place per snippet for its end
    place_start = starts + np.arange(len(lens))
    size = int(lens.sum() + len(lens))
    owner = np.repeat(np.arange(len(lens)), lens + 1)
    inside = np.arange(size) - place_start[owner]
    full = inside + STEP <= lens[owner]
    grams = np.empty(len(flat) - STEP + 1, np.uint64)
    for lo in range(0, len(grams), BUFFER // 2):
        hi = min(len(grams), lo + BUFFER // 2)
        grams[lo:hi] = Hashes(flat[lo : hi + STEP - 1]).every(STEP)
    symbols = np.zeros(size, np.uint32)
    byte = np.arange(size) - owner
    symbols[full] = named(grams[byte[full]])
    shards = []
    for lo in range(0, len(lens), shard):
        at, stop = place_start[lo], place_start[lo + shard] if lo + shard < len(lens) else size
        shards.append(Shard(symbols[at:stop], inside[at:stop] >= STEP, at))
    place, blocks = merge(shards)
    window = inside[place] + LENGTH <= lens[owner[place]]
    place, blocks = place[window], blocks[window]
    doc, text_at = ranges["doc"][owner[place]], ranges["at"][owner[place]].astype(np.int64) + inside[place]
    many = np.r_[False, blocks[1:] == blocks[:-1]]
    many |= np.r_[many[1:], False]
    place, blocks, doc, text_at = place[many], blocks[many], doc[many], text_at[many]
    order = np.lexsort((text_at, doc, blocks))
    place, blocks, doc, text_at = place[order], blocks[order], doc[order], text_at[order]
    new = _grouped([blocks]) if len(blocks) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = np.flatnonzero(_again(new, doc, text_at))
    alike = np.ones(len(again), bool)
    for lo in range(0, len(again), 20_000):
        part = again[lo : lo + 20_000]
        span = np.arange(LENGTH)
        alike[lo : lo + 20_000] = (flat[byte[place[part]][:, None] + span] == flat[byte[place[lead[part]]][:, None] + span]).all(axis=1)
    again = again[alike]
    out = np.empty(len(again), RANGE)
    out["doc"], out["at"], out["more"] = doc[again], text_at[again], 0
    return out


def joined_ranges(ranges: np.ndarray) -> np.ndarray:
    """Neighbouring windows as ranges of at most 256."""
    ranges = ranges[np.lexsort((ranges["at"], ranges["doc"]))]
    at = ranges["at"].astype(np.int64)
    new = np.r_[True, (ranges["doc"][1:] != ranges["doc"][:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    run = np.arange(len(ranges)) - np.repeat(first, np.diff(np.r_[first, len(ranges)]))
    first = np.flatnonzero(run % 256 == 0)
    out = ranges[first]
    out["more"] = np.diff(np.r_[first, len(ranges)]) - 1
    return out


def _merges(packed: list[tuple[bytes, bytes, bytes]], each: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Snippets (packed ranges, hashes, bytes) of a bucket, dealt by anchor into merges of about ``each``, in the order they came."""
    ranges = np.concatenate([np.frombuffer(r, RANGE) for r, _, _ in packed])
    anchor = np.concatenate([np.frombuffer(h, KEY)["anchor"] for _, h, _ in packed])
    flat = np.concatenate([np.frombuffer(b, np.uint8) for _, _, b in packed])
    lens = ranges["more"].astype(np.int64) + LENGTH
    start = np.r_[0, np.cumsum(lens)[:-1]]
    merge_of = anchor % np.uint32(-(-len(ranges) // each))
    order = stable_order(merge_of)
    cuts = np.r_[np.flatnonzero(_grouped([merge_of[order]])), len(order)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        who = order[a:b]
        yield ranges[who], flat[_places(start[who], lens[who])]


def _merged(snippets: DataFrame, copies: DataFrame, n: int) -> DataFrame:
    """(doc_id, ranges): the windows of merged snippets that repeat an earlier one, and the copies of merged snippets."""
    shard, each = SHARD, MERGED

    def rows(part: np.ndarray) -> pa.RecordBatch:
        doc, _, packed, _ = zip(*_by_doc(part, REPEAT), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "ranges"])

    def run(batches):
        for group in keyed_runs(batches, 1):
            kinds = [b.column(1).to_numpy() for b in group]
            of = lambda kind, *columns: [x for b, k in zip(group, kinds, strict=True) for x in zip(*(b.filter(pa.array(k == kind)).column(i).to_pylist() for i in columns), strict=True)]  # noqa: E731, B023
            packed = of(OPEN, 2, 3, 4)
            if not packed:
                continue
            for ranges, flat in _merges(packed, each):
                found = repeated_windows(ranges, flat, shard)
                if len(found):
                    yield rows(joined_ranges(found))
            merged = np.concatenate([np.frombuffer(h, KEY) for _, h, _ in packed])
            known = np.unique(merged["whole"] ^ merged["second"])
            for r, h in of(COPY, 2, 3):
                places, keys = np.frombuffer(r, RANGE), np.frombuffer(h, KEY)
                places = places[np.isin(keys["whole"] ^ keys["second"], known)]
                if len(places):
                    yield rows(places)

    both = snippets.unionByName(copies.select("key", "kind", "ranges", "hashes", F.lit(None).cast("binary").alias("bytes")))
    return both.repartition(n, "key").sortWithinPartitions("key", "kind").mapInArrow(run, "doc_id long, ranges binary")


def spans(packed: list[bytes]) -> list[tuple[int, int]]:
    """Maximal covered runs (start, stop) of bytes, from packed ranges of window starts."""
    if not packed:
        return []
    r = np.concatenate([np.frombuffer(p, RANGE) for p in packed])
    start = r["at"].astype(np.int64)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], (start + r["more"] + LENGTH)[order]
    reach = np.maximum.accumulate(stop)
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return list(zip(start[first].tolist(), reach[np.r_[first[1:] - 1, len(start) - 1]].tolist(), strict=True))


def repeated_ranges(docs: DataFrame, reduce: bool = True) -> DataFrame:
    """Stored (doc_id, gone: packed ranges of the windows that also start earlier) of documents that have some.

    Without ``reduce`` every snippet is merged, also those that equal others: the same result at more cost.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).where("doc_id is not null and text is not null")
    n = parts(spark, text_bytes(docs), 24e6)
    version = F.xxhash64("text")
    several = Stored(docs.groupBy("doc_id").agg(F.min(version).alias("a"), F.max(version).alias("b")).where("a < b").select("doc_id"), "several")
    if not several.df.isEmpty():
        docs = docs.join(several.df, "doc_id", "left_anti")
    done = [several, Stored(_classes(_anchors(docs, 4 * n, reduce), n, reduce), "ranges")]
    rows = done[-1].df
    of = lambda df, kind: df.where(F.col("kind") == kind)
    done.append(Stored(_merged(_snippets(docs, of(rows, OPEN), 4 * n, False), of(rows, COPY), n), "merged"))
    found = of(rows, REPEAT).select(F.col("key").alias("doc_id"), "ranges").union(done[-1].df)
    wide = of(rows, WIDE)
    if not wide.isEmpty():
        done.append(Stored(_classes(_windows(docs, wide, 4 * n), n, True), "windows"))
        single = done[-1].df
        done.append(Stored(_merged(_snippets(docs, of(single, OPEN), 4 * n, True), of(single, COPY), n), "merged"))
        found = found.union(done[-1].df)
    gone = Stored(found.groupBy("doc_id").agg(F.collect_list("ranges").alias("gone")), "gone").df
    for x in done:
        x.drop()
    return gone


def remaining(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in cut:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def suffix_digest(docs: DataFrame, reduce: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; a text under ``LENGTH`` bytes loses nothing. Rows with a null doc_id take no
    part and lose nothing, nor do those of a doc_id with several different texts, whose places would be
    ambiguous. Rows that repeat a doc_id and its text are one document: they lose what earlier documents,
    or an earlier place of the text, hold. Other columns are ignored; an empty table gives no rows.
    """
    gone = repeated_ranges(docs, reduce)

    def run(batches):
        for batch in batches:
            rows = []
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                cut = spans(packed)
                rows.append((len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(remaining(raw, cut)).hexdigest()))
            n, removed, count, sha = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).join(gone.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "gone")
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with what stays in ``text``; a character goes only if all its bytes do.

    A document that loses its whole text stays with an empty one.
    """
    gone = repeated_ranges(docs).withColumnRenamed("doc_id", "gone_id")

    @F.pandas_udf("string")
    def cut(text, packed):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, p in zip(text, packed, strict=True):
            if t is None or p is None:
                out.append(t)
                continue
            raw = t.encode()
            whole = []
            for a, b in spans(list(p)):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                whole.append((a, b))
            out.append(remaining(raw, whole).decode())
        return pd.Series(out, dtype=object)

    cut = cut.asNondeterministic()  # else a filter on the text runs it a second time
    joined = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == gone["gone_id"], "left")
    return joined.select(*[cut(docs["text"], gone["gone"]).alias("text") if c == "text" else docs[c] for c in docs.columns])
