import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import common, components, jaccard_join, line_dedup, suffix_dedup
from tests.llm.corpus import frame, texts


def brute_suffix(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_matches_brute_force(spark, seed):
    rows = list(enumerate(texts(seed=seed)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_digest(frame(spark, rows).repartition(5)).collect()}
    assert got == brute_suffix(rows)
    assert any(v[1] for v in got.values())


def test_suffix_reduction_changes_nothing(spark):
    """Merging every snippet, also those that equal others, gives the same."""
    rows = list(enumerate(texts(seed=4)))
    got = [sorted(map(tuple, suffix_dedup.suffix_digest(frame(spark, rows).repartition(5), reduce).collect())) for reduce in (True, False)]
    assert got[0] == got[1] and {r[0]: r[1:] for r in got[0]} == brute_suffix(rows)


def test_suffix_hot_anchors(spark, monkeypatch):
    """A string that many texts hold between different words: its windows are dealt one by one."""
    import random

    for name, value in (("WIDE_FROM", 6), ("HELD", 40), ("SHARD", 5), ("MERGED", 30)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefghijkl ") for _ in range(n))
    common, pairs = word(45), [(word(40), word(40)) for _ in range(12)]
    rows = [(k, word(30) + a + common + b + word(20)) for k, (a, b) in enumerate(rnd.choice(pairs) if k % 3 else (word(60), word(60)) for k in range(90))]
    rows += [(200 + k, common * 4 + word(9)) for k in range(20)] + [(300 + k, rows[k][1]) for k in range(30)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_digest(frame(spark, rows).repartition(6)).collect()}
    assert got == brute_suffix(rows)


def test_suffix_classes_find_wide_anchors():
    """A bucket holds few rows of an anchor at a time, and sends it away by window once it is wide."""
    import numpy as np

    classes = suffix_dedup.Classes(3, True, 10, 20)
    kinds = []
    for k in range(30):
        ranges, hashes = np.zeros(5, suffix_dedup.RANGE), np.zeros(5, suffix_dedup.KEY)
        ranges["doc"] = np.arange(5) + 5 * k
        hashes["anchor"], hashes["whole"] = 7, np.arange(5) + 5 * k
        kinds += [r[1] for r in classes.add(ranges, hashes)]
        assert classes.size <= 25
    kinds += [r[1] for r in classes.end()]
    assert set(kinds) == {suffix_dedup.WIDE} and classes.wide.tolist() == [7]


def test_suffix_merge_alone(monkeypatch):
    """Every group of windows goes through the merge, over many small shards."""
    rows = [(i, t) for i, t in enumerate(texts(60, seed=9)) if t]
    import numpy as np

    batches = []
    for i, t in rows:
        raw = t.encode()
        if len(raw) < suffix_dedup.LENGTH:
            continue
        n = len(raw) - suffix_dedup.LENGTH + 1
        at = np.arange(0, n, 256)
        r = np.empty(len(at), suffix_dedup.RANGE)
        r["doc"], r["at"], r["more"] = i, at, np.minimum(256, n - at) - 1
        pieces = b"".join(raw[a : a + int(m) + suffix_dedup.LENGTH] for a, m in zip(at.tolist(), r["more"], strict=True))
        batches.append((r, np.frombuffer(pieces, np.uint8)))
    merge, made = suffix_dedup.merge, []
    monkeypatch.setattr(suffix_dedup, "merge", lambda shards: made.append(len(shards)) or merge(shards))
    want, seen = set(), set()
    for i, t in rows:
        raw = t.encode()
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                want.add((i, s))
            seen.add(raw[s : s + 100])
    for shard in (2, 15, 1000):
        found = suffix_dedup.repeated_windows(*(np.concatenate(x) for x in zip(*batches, strict=True)), shard)
        assert set(zip(found["doc"].tolist(), found["at"].tolist(), strict=True)) == want
    assert made[0] >= 30 and made[1] >= 3


def test_suffix_names_of_symbols():
    import numpy as np

    rng = np.random.default_rng(1)
    grams = (rng.integers(0, 4, 500, dtype=np.uint64) << np.uint64(32)) | rng.integers(0, 9, 500, dtype=np.uint64)
    assert (suffix_dedup.named(grams) == np.unique(grams, return_inverse=True)[1] + 1).all()


def test_suffix_long_text_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1 << 12)
    monkeypatch.setattr(suffix_dedup, "_powers", None)
    import random

    rnd = random.Random(5)
    block = "".join(rnd.choice("abcdef ") for _ in range(900))
    long = "".join(rnd.choice("abcdefgh ") for _ in range(5000)) + block + "".join(rnd.choice("abc") for _ in range(300)) + block
    anchors = list(suffix_dedup._fill([_batch([1], [long])]))
    assert len(anchors) > 1
    rows = [(1, long), (2, block)]
    starts = defaultdict(set)
    for keys, places, chunks in anchors:
        for place, chunk in zip(places, chunks, strict=True):
            starts[keys[0]].update(range(place, place + len(chunk) - 99))
    assert starts[1] == set(range(len(long.encode()) - 99))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_digest(frame(spark, rows)).collect()}
    assert got == {k: v[1] for k, v in brute_suffix(rows).items()}
    twice = suffix_dedup.suffix_digest(frame(spark, [(7, block), (7, block), (None, block)])).collect()
    assert sorted(r["n_removed"] for r in twice) == [0, 0, 0]
    other = suffix_dedup.suffix_digest(frame(spark, [(6, block), (7, block), (7, block[::-1]), (8, block), (8, block)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in other) == [(6, 0), (7, 0), (7, 0), (8, 900), (8, 900)]


def _batch(keys, values):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.string())], names=["doc_id", "text"])


def test_suffix_text_keeps_whole_characters(spark):
    rows = [(1, "é" * 120 + "a"), (2, "b" + "é" * 120)]
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert out[1].startswith("é") and out[2].startswith("b")
    assert suffix_dedup.suffix_dedup(frame(spark, rows)).columns == frame(spark, rows).columns


def brute_jaccard(rows):
    def sets(text):
        w = [x for x in (text or "").encode().translate(jaccard_join.FOLD).split(b" ") if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    s = {k: sets(t) for k, t in rows}
    comp = {k: k for k in s}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    keys = sorted(s)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {k: (len(s[k]), find(k)) for k in keys}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_matches_brute_force(spark, seed):
    rows = list(enumerate(texts(160, seed=seed)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(frame(spark, rows).repartition(4)).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_chains_and_families(spark):
    """A chain of small changes and a family of near copies: found through leaders and the matrix."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):
        w = base.copy()
        w[:k] = [f"v{i}" for i in range(k)]
        rows.append((k, " ".join(w)))
    for k in range(60):
        w = [f"u{i}" for i in range(150)]
        w[(k * 7) % 150] = f"x{k}"
        w[(k * 11 + 3) % 150] = f"y{k}"
        rows.append((100 + k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(frame(spark, rows)).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_hot_tokens_and_split_work(spark, monkeypatch):
    """Tokens dealt over all buckets, split matrix joins, small blocks, hot keys and star rounds give the same."""
    for at, name, value in [(jaccard_join, "HOT", 3), (jaccard_join, "HOT_TIMES", 0), (jaccard_join, "SPLIT", 5), (jaccard_join, "BLOCK", 8), (common, "KEY_ROWS", 4), (components, "TASK_EDGES", 5)]:
        monkeypatch.setattr(at, name, value)
    base = [f"u{i}" for i in range(60)]
    rows = list(enumerate(texts(60, seed=5)))
    for k in range(80):
        w = base.copy()
        w[k * 7 % 60] = f"x{k}"
        w[k * 11 % 60] = f"y{k % 9}"
        rows.append((1000 + k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(frame(spark, rows).repartition(4)).collect()}
    assert got == brute_jaccard(rows)


@pytest.mark.parametrize("task_edges", [7, 1_000_000])
def test_components(spark, monkeypatch, task_edges):
    import random

    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    rnd = random.Random(4)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(500 + k, 501 + k) for k in range(40)] + [(900, 901 + k) for k in range(40)] + [(3, 3), (None, 4)]
    low = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}
    for _ in range(len(low)):
        for a, b in pairs:
            if a in low and b in low and a != b:
                low[a] = low[b] = min(low[a], low[b])
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    assert {(r["node"], r["component"]) for r in components.components(edges).collect()} == set(low.items())
    assert components.components(edges.limit(0)).count() == 0


def test_jaccard_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(30))
    out = jaccard_join.jaccard_groups(frame(spark, [(3, same), (3, same), (None, same), (5, same.upper())])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [(0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False)]
    assert jaccard_join.jaccard_groups(frame(spark, [])).count() == 0


def test_jaccard_of_two_texts_under_one_id(spark):
    """Each text is compared as it is, whichever row of its id comes first; only the copy's row goes."""
    same, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(40))
    near = other.replace("v39", "x")
    docs = frame(spark, [(1, same), (5, other), (5, same), (7, near), (8, near), (5, other)])
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in jaccard_join.jaccard_groups(docs).collect())
    assert out == [(1, 26, 1, True), (5, 26, 1, False), (5, 36, 5, True), (5, 36, 5, True), (7, 36, 5, False), (8, 36, 5, False)]
    left = jaccard_join.unlike(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, same), (5, other), (5, other)]


def brute_chunks(lines):
    """Boundaries from their definition, found from the end of the text by recursion."""
    import xxhash

    n = len(lines)
    h = [xxhash.xxh3_64_intdigest(x) for x in lines]
    worded = [i for i in range(n) if lines[i].strip()]

    def least(i):
        return 0 < i < n - 1 and h[i] < h[i - 1] and h[i] < h[i + 1]

    def allowed(start):
        """A chunk may begin at a line that leaves two lines on each side, words after it and before it no two blank lines."""
        return 2 <= start <= n - 2 and worded and start <= worded[-1] and (lines[start - 1].strip() or lines[start - 2].strip())

    def cut(end):
        for start in range(end - 1, 1, -1):
            if allowed(start) and (least(start - 1) or (start <= end - 2 and not least(start - 2))):
                return [*cut(start), (start, end)]
        return [(0, end)]

    return cut(n)


def brute_lines(rows):
    """Text that stays in each row, by whole chunk texts; equal rows are one document."""
    import xxhash

    seen, out = {}, {}
    version = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)
    for key, text in sorted({(k, t) for k, t in rows if k is not None and t is not None}, key=lambda r: (r[0], version(r[1]))):
        lines = text.split("\n")
        kept = []
        for k, (a, b) in enumerate(brute_chunks(lines)):
            chunk = "\n".join(lines[a:b])
            if b - a < 2 or not chunk.strip() or seen.setdefault(chunk, (key, text, k)) == (key, text, k):
                kept += lines[a:b]
        out[key, text] = "\n".join(kept)
    return [(k, out.get((k, t), t)) for k, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_brute_force(spark, seed):
    rows = list(enumerate(texts(150, seed=seed)))
    rows += [(5, rows[9][1]), (5, rows[9][1]), (40, rows[7][1]), (None, rows[7][1])]
    out = line_dedup.line_dedup(frame(spark, rows).repartition(3))
    assert out.columns[:6] == frame(spark, rows).columns
    got = sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect())))
    assert got == sorted(map(str, brute_lines(rows)))
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in brute_lines(rows))
    assert sorted(r["kept_sha256"] for r in line_dedup.digest(out).collect()) == want
    assert out.where("n_removed_chunks > 0").count()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "e", "f", "", " "]), min_size=1, max_size=30))
def test_line_boundaries_follow_their_definition(body):
    assert line_dedup.chunk_texts("\n".join(body)) == (body, brute_chunks(body))


def test_line_dedup_odd_rows(spark):
    t = "\n".join(f"a line {i} of this text" for i in range(30))
    out = line_dedup.line_dedup(frame(spark, [(1, t), (1, t), (None, t), (2, None), (3, "")])).collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(1, t), (None, t), (2, None), (3, "")} and len(out) == 5
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_of_two_texts_under_one_id(spark):
    t = "\n".join(f"a line {i} of this text" for i in range(30))
    out = line_dedup.line_dedup(frame(spark, [(1, t), (2, t), (5, t), (5, "another\ntext\nof\nlines")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, t), (2, ""), (5, ""), (5, "another\ntext\nof\nlines")]


@pytest.mark.parametrize("name", ["n_lines", "n_removed_lines", "done", "done__", "row", "gone", "gone_id", "version", "k", "h1", "wanted", "a.b"])
def test_line_dedup_with_clashing_names(spark, name):
    import corpus_pipeline

    t = "a b\nc d\ne f\ng h"
    docs = spark.createDataFrame([(1, t, 7), (2, t, 8), (3, None, 9)], f"doc_id long, text string, `{name}` int")
    out = line_dedup.line_dedup(docs)
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed_lines"]) for r in line_dedup.digest(out).collect()) == [(1, 4, 0), (2, 4, 4), (3, 0, 0)]
    if name not in line_dedup.COUNTS:
        assert sorted((r["doc_id"], r[name]) for r in out.collect()) == [(1, 7), (2, 8), (3, 9)]
    kept = corpus_pipeline.lines(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"] or "", r[name]) for r in kept.collect()) == [(1, t, 7), (3, "", 9)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=8), st.integers(0, 1000))
def test_line_boundaries_resist_shifts(before, seed):
    """From the second boundary on, lines put in front change nothing."""
    import random

    rnd = random.Random(seed)
    body = [str(rnd.random()) for _ in range(40)]
    head = [str(x) for x in before]
    ends = {e for e in line_dedup.chunk_ends(body) if e > 2}
    moved = {e - len(head) for e in line_dedup.chunk_ends(head + body) if e - len(head) > 2}
    assert ends == moved


def test_line_dedup_removes_whole_copies(spark):
    """A later copy of any text of two lines or more with a word keeps no line."""
    import random

    rnd = random.Random(11)
    made = ["\n".join(rnd.choice([str(rnd.random()), "again", "", " "]) for _ in range(rnd.randrange(2, 14))) for _ in range(200)]
    whole = sorted({t for t in made if t.strip()})
    out = line_dedup.line_dedup(frame(spark, list(enumerate(whole + whole))).repartition(3)).where(f"doc_id >= {len(whole)}").collect()
    assert len(out) == len(whole) and all(r["text"] == "" and r["n_removed_lines"] == r["n_lines"] for r in out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "e", "", " "]), min_size=2, max_size=30))
def test_line_chunks_can_all_go(body):
    lines, spans = line_dedup.chunk_texts("\n".join(body))
    assert spans[0][0] == 0 and spans[-1][1] == len(lines) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(line_dedup.removable(lines, a, b) for a, b in spans) or not "".join(body).strip()


def test_line_dedup_finds_passages_and_runs(spark):
    """A line repeated in one text goes but for a few; shared passages of eight lines mostly go."""
    import random

    rnd = random.Random(12)
    fresh = lambda n: [f"line {rnd.random()}" for _ in range(n)]
    rows = []
    for k in range(100):
        passage = fresh(8)
        rows += [(2 * k, "\n".join(fresh(3) + passage + fresh(3))), (2 * k + 1, "\n".join(fresh(4) + passage + fresh(2)))]
    rows += [(1000 + k, "\n".join([*fresh(3), *[f"same {k}"] * (40 + k % 2), *fresh(3)])) for k in range(20)]
    out = {r["doc_id"]: r["n_removed_lines"] for r in line_dedup.line_dedup(frame(spark, rows).repartition(3)).collect()}
    assert all(out[2 * k] == 0 for k in range(100)) and sum(out[2 * k + 1] for k in range(100)) > 0.6 * 800
    assert all(out[1000 + k] >= 34 for k in range(20))


def test_suffix_stage_keeps_rows_it_took_nothing_from(spark):
    import corpus_pipeline

    block = "".join(chr(97 + k * k % 26) + str(k) for k in range(100))
    rows = [(1, block), (2, block), (3, None), (4, ""), (None, ""), (None, None)]
    out = corpus_pipeline.suffixes(spark, frame(spark, rows), "")
    assert out.columns == frame(spark, rows).columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, (r for r in rows if r[0] != 2)))
