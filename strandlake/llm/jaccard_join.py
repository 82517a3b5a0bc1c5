"""Operator 8: exact Jaccard join of word shingles with a token-group matrix.

Documents with equal shingle sets are one node. Of each node only its prefix travels: the rarest
tokens, so many that two similar sets must share one (Chaudhuri et al. 2006). A first round links each
token's nodes to one leader and verifies these few pairs; the resulting components, and the nodes that
have a leader but no link, are the groups of similar documents. The token-group matrix then holds, per
token and group, bounds over the group's members (sizes, positions, components); a query node opens a
group only where the bound on their overlap allows a link to another component. An opened group stores
the union of its members' tokens: a query that shares too few of them is done, and the others get their
overlaps with all members at once.

A token that many documents hold is dealt over all buckets, each with a leader of its own; these leaders
are verified against the smallest of them, and the matrix joins the token's entries again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Stored, join_hot, parts, text_bytes
from strandlake.llm.components import components, local_roots
from strandlake.llm.embedding_dedup import keyed_runs

WORDS = 5
#: Similarity: NUM / DEN. Overlap of sets x and y must be at least NUM (x + y) / (NUM + DEN).
NUM, DEN = 4, 5
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SLICE = 1024
BLOCK = 256
#: A token is hot beyond this many documents and ``HOT_TIMES`` the mean of the table of counts.
HOT, HOT_TIMES, HOT_LEVEL = 500_000, 64, 255
#: Entries of a token that meet the matrix in one task.
SPLIT = 20_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; of a short text, of all its words."""
    words = (text or "").encode().translate(FOLD).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - WORDS + 1
    out = h[:n].copy()
    for k in range(1, WORDS):
        out = out * M1 + h[k : k + n]
    return np.unique(mixed(out))


def node_of(tokens: np.ndarray) -> int:
    """A set's identity: 63 bits of the hash of its sorted tokens."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


def sketch_bits(n_bytes: int) -> int:
    """Size of the table of token counts: about 32 tokens an entry, 2**22 entries at most."""
    return min(22, max(12, (n_bytes // (6 * 32)).bit_length()))


def slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _sets(docs: DataFrame, bits: int) -> Stored:
    """kind 0: doc_id, version, n, node of each document; kind 1: a scan partition's token counts, in slices."""

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            n, node = [], []
            for text in batch.column(1).to_pylist():
                tokens = shingles(text)
                n.append(len(tokens))
                node.append(node_of(tokens) if len(tokens) else None)
                np.add.at(counts, slots(tokens, bits), 1)
            size = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([0] * size, pa.int32()), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array([None] * size, pa.binary())], names=["kind", "doc_id", "version", "n", "node", "counts"])
        rows = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, SLICE)
        at = np.flatnonzero(rows.any(axis=1))
        if len(at):
            void = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(at), pa.int32()), pa.array(at), void, pa.array([0] * len(at), pa.int64()), void, pa.array([rows[k].tobytes() for k in at], pa.binary())], names=["kind", "doc_id", "version", "n", "node", "counts"])

    return Stored(docs.mapInArrow(run, "kind int, doc_id long, version long, n long, node long, counts binary"), "sets")


def _rarity(stored: DataFrame, bits: int, tokens: int, n: int) -> np.ndarray:
    """Order classes of tokens by document count: a table of bounded size (4 MB), summed by slice.

    A slice's rows, one a scan partition, are added up as they stream by. A partition's counts are cut at
    65,535: any order of tokens gives the same result. Level ``HOT_LEVEL`` marks hot tokens.
    """
    hot = max(HOT, HOT_TIMES * (tokens >> bits))

    def add(batches):
        for group in keyed_runs(batches, 1):
            total = np.zeros(SLICE, np.int64)
            for batch in group:
                for r in batch.column(1).to_pylist():
                    total += np.frombuffer(r, np.uint16)
            level = np.minimum(8 * np.log2(1 + total), HOT_LEVEL - 1).astype(np.uint8)
            level[total > hot] = HOT_LEVEL
            yield pa.RecordBatch.from_arrays([group[0].column(0).slice(0, 1), pa.array([level.tobytes()], pa.binary())], names=["slice", "level"])

    rows = stored.where("kind = 1").select(F.col("doc_id").alias("slice"), "counts")
    dealt = rows.repartition(n, "slice").sortWithinPartitions("slice")
    level = np.zeros(((1 << bits) // SLICE, SLICE), np.uint8)
    for r in dealt.mapInArrow(add, "slice long, level binary").collect():
        level[r["slice"]] = np.frombuffer(r["level"], np.uint8)
    return level.ravel()


def _messages(docs: DataFrame, rarity: np.ndarray, buckets: int) -> DataFrame:
    """Prefixes of distinct sets, packed per bucket of tokens: token, node, size, position.

    The bucket of a hot token depends on the node as well.
    """

    bits = len(rarity).bit_length() - 1

    def flush(tokens, node, size):
        token = np.concatenate(tokens)
        lens = [len(t) for t in tokens]
        pos = np.concatenate([np.arange(k, dtype=np.uint32) for k in lens])
        who = np.repeat(np.arange(len(lens), dtype=np.uint32), lens)
        node, size = np.array(node, np.int64), np.array(size, np.uint32)
        hot = rarity[slots(token, bits)] == HOT_LEVEL
        bucket = (np.where(hot, token ^ mixed(node[who].view(np.uint64)), token) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        token, pos, who, bucket = token[order], pos[order], who[order], bucket[order]
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        cols: list[list] = [[], [], [], []]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            used, local = np.unique(who[a:b], return_inverse=True)
            cols[0].append(int(bucket[a]))
            cols[1].append(token[a:b].tobytes())
            cols[2].append(local.astype(np.uint32).tobytes() + pos[a:b].tobytes())
            cols[3].append(node[used].tobytes() + size[used].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "tokens", "places", "nodes"])

    def run(batches):
        tokens, node, size, seen, held = [], [], [], set(), 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = shingles(text)
                if key is None or not len(t) or (name := node_of(t)) in seen:
                    continue
                seen.add(name)
                level = rarity[slots(t, bits)]
                p = prefix_length(len(t))
                tokens.append(t[np.argsort(level, kind="stable")[:p]])
                node.append(name)
                size.append(len(t))
                held += p
                if held > 400_000:
                    yield flush(tokens, node, size)
                    tokens, node, size, seen, held = [], [], [], set(), 0
        if tokens:
            yield flush(tokens, node, size)

    return docs.mapInArrow(run, "bucket long, tokens binary, places binary, nodes binary")


def _lists(messages: DataFrame, rarity: np.ndarray, n: int) -> DataFrame:
    """Tokens of two or more nodes. kind 0: leader and node to verify; kind 1: entries for the matrix; kind 2: a hot token's leader here.

    A token's leader is its smallest node; where sizes and positions rule a pair out, it is no pair.
    Lists of two need no matrix: their only pair is tested here. Entries of a hot token all go on.
    """
    bits = len(rarity).bit_length() - 1

    def run(batches):
        for group in keyed_runs(batches, 1):
            token, node, size, pos = [], [], [], []
            for batch in group:
                for t, places, nodes in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    t = np.frombuffer(t, np.uint64)
                    who, p = np.frombuffer(places, np.uint32).reshape(2, -1)
                    k = len(nodes) // 12
                    token.append(t)
                    node.append(np.frombuffer(nodes, np.int64, k)[who])
                    size.append(np.frombuffer(nodes, np.uint32, k, offset=8 * k)[who])
                    pos.append(p)
            token, node, size, pos = map(np.concatenate, (token, node, size, pos))
            order = np.lexsort((node, token))
            token, node, size, pos = token[order], node[order], size[order].astype(np.int64), pos[order].astype(np.int64)
            new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
            token, node, size, pos = token[new], node[new], size[new], pos[new]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            count = np.diff(np.r_[first, len(token)])
            lead = np.repeat(first, count)
            length = np.repeat(count, count)
            both = np.flatnonzero((lead != np.arange(len(lead))) & _possible(size[lead], pos[lead], size, pos))
            pairs = np.unique(np.stack([node[lead[both]], node[both]], axis=1), axis=0)
            hot = rarity[slots(token, bits)] == HOT_LEVEL
            rest = np.flatnonzero((length > 2) | hot)
            top = first[hot[first]]
            kind = np.repeat(np.arange(3, dtype=np.int32), [len(pairs), len(rest), len(top)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kind),
                    pa.array(np.r_[pairs[:, 0], token[rest].view(np.int64), token[top].view(np.int64)]),
                    pa.array(np.r_[pairs[:, 1], node[rest], node[top]]),
                    pa.array(np.r_[np.zeros(len(pairs), np.int64), size[rest], size[top]]),
                    pa.array(np.r_[np.zeros(len(pairs), np.int64), pos[rest], pos[top]]),
                ],
                names=["kind", "a", "b", "size", "pos"],
            )

    return messages.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "kind int, a long, b long, size long, pos long")


def _possible(n, i, m, j):
    """Whether sets of n and m tokens that share the tokens at i and j can reach the threshold."""
    need = -(-NUM * (n + m) // (NUM + DEN))
    most = np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1)
    return (NUM * np.maximum(n, m) <= DEN * np.minimum(n, m)) & (most >= need)


def overlaps(members: list[np.ndarray], query: np.ndarray, union: np.ndarray, heads: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Common tokens of a query with each member, through the group's union of tokens.

    ``owners[heads[k]:heads[k + 1]]`` are the members that hold the union's token k.
    """
    at = np.minimum(np.searchsorted(union, query), len(union) - 1)
    at = at[union[at] == query]
    if NUM * len(query) > DEN * len(at):  # the bound: no member shares more than the union does
        return np.zeros(len(members), np.int64)
    lens = heads[at + 1] - heads[at]
    places = np.repeat(heads[at] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
    return np.bincount(owners[places], minlength=len(members))


def _compared(opens: DataFrame, members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Edges between queries and similar members of the groups they open: opens (g, q), members (g, x).

    Groups and their queries are cut into blocks of about ``BLOCK``; each pair of blocks meets once, with
    whole texts, and is compared through its union of tokens. A block gives a forest of its links.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    size = Stored(opens.groupBy("g").agg(F.count("*").alias("nq")).join(members.groupBy("g").agg(F.count("*").alias("nm")), "g"), "sizes").df
    of = lambda c: size.select("g", F.col(c).alias("n"), blocks("nq").alias("qs"), blocks("nm").alias("ms"))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    left = join_hot(opens, of("nq"), ["g"], opens.count()).select("g", place("q", "qs").alias("i"), every("ms").alias("j"), F.lit(1).alias("role"), F.col("q").alias("node"))
    right = join_hot(members, of("nm"), ["g"], members.count()).select("g", every("qs").alias("i"), place("x", "ms").alias("j"), F.lit(0).alias("role"), F.col("x").alias("node"))
    rows = left.union(right).join(texts, "node").select("g", "i", "j", "role", "node", "text")

    def run(batches):
        for group in keyed_runs(batches, 3):
            role, node = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in group]) for c in (3, 4))
            text = [t for b in group for t in b.column(5).to_pylist()]
            inner = [k for k in range(len(role)) if role[k] == 0]
            sets = [shingles(text[k]) for k in inner]
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            union, heads = np.unique(flat[order], return_index=True)
            heads, owner = np.r_[heads, len(flat)], owner[order]
            sizes, names = np.array([len(x) for x in sets]), node[inner]
            links: list[tuple[int, int]] = []
            for k in range(len(role)):
                if role[k] == 0 or not len(union):
                    continue
                query = shingles(text[k])
                common = overlaps(sets, query, union, heads, owner)
                hit = DEN * common >= NUM * (len(query) + sizes - common)
                links += [(int(node[k]), int(x)) for x in names[hit] if x != node[k]]
            if links:
                ends = np.array(links)
                nodes, roots = local_roots(ends[:, 0], ends[:, 1])
                other = nodes != roots
                yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(roots[other])], names=["a", "b"])

    dealt = rows.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document (kept: it is its component's smallest id).

    Exact: no candidate is capped or sampled. A null text or one without words has an empty set and
    links with nothing; a text of under five words is one shingle. Equal sets link whatever the order
    of their words. A row with a null doc_id links with nothing and is kept. Rows that repeat a doc_id
    and its text repeat its result; other texts under the same doc_id are compared as they are. Other
    columns are ignored; an empty table gives no rows. The rows are stored; all other tables are dropped.
    """
    return jaccard_rows(docs).drop("version")


def unlike(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    gone = jaccard_rows(docs).where("not kept").select(F.col("doc_id").alias("gone__"), F.col("version").alias("version__")).distinct()
    same = (docs["doc_id"].cast("long") == gone["gone__"]) & (F.xxhash64(docs["text"]) == gone["version__"])
    return docs.join(gone, same, "left_anti").select(docs.columns)


def jaccard_rows(docs: DataFrame) -> DataFrame:
    """:func:`jaccard_groups` with the version (64-bit hash) of each row's text."""
    spark = docs.sparkSession
    done: dict[str, Stored] = {}

    def store(df: DataFrame, name: str) -> DataFrame:
        done[name] = Stored(df, name)
        return done[name].df

    def drop(*names: str) -> None:
        """Tables whose readers have all been stored themselves."""
        for x in names:
            done.pop(x).drop()

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(docs["text"]).alias("version"))
    bits = sketch_bits(text_bytes(docs))
    done["sets"] = _sets(docs, bits)
    stored = done["sets"].df
    sets = stored.where("kind = 0").select("doc_id", "version", "n", "node")
    first_row = F.min(F.struct("doc_id", "version")).alias("first")
    reps = sets.where("node is not null and doc_id is not null").groupBy("node").agg(first_row, F.count("*").alias("docs"))
    reps = store(reps.select("node", F.col("first.doc_id").alias("rep"), F.col("first.version").alias("version"), "docs"), "reps")
    tokens, rows = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n = parts(spark, tokens / DEN, 500_000)
    rarity = _rarity(stored, bits, tokens, n)
    lists = store(_lists(_messages(docs, rarity, 4 * n), rarity, n), "lists")
    tops = lists.where("kind = 2").select("a", "b")
    top = tops.groupBy("a").agg(F.min("b").alias("lead"))
    between = tops.join(top, "a").where("b <> lead").select(F.col("lead").alias("a"), "b")
    first = store(lists.where("kind = 0").select("a", "b").union(between).distinct(), "first")
    rest = lists.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), "size", "pos")
    wanted = first.select(F.col("a").alias("node")).union(first.select("b")).union(rest.select("node")).distinct()
    wanted = wanted.join(reps, "node").select("node", F.col("rep").alias("doc_id"), "version")
    found = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "version"]).select("node", "text")
    texts = store(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
    opens = first.select(F.col("a").alias("g"), F.col("b").alias("q"))
    leaders = opens.select("g").distinct().select("g", F.col("g").alias("x"))
    labels = store(components(store(_compared(opens, leaders, texts, n), "links")), "labels")
    drop("links")

    # Groups: components so far; a node without one goes to the group of its smallest leader.
    home = opens.groupBy(F.col("q").alias("node")).agg(F.min("g").alias("home"))
    of_home = labels.select(F.col("node").alias("home"), F.col("component").alias("of_home"))
    group = rest.select("node").distinct().join(labels, "node", "left").join(home, "node", "left").join(of_home, "home", "left")
    group = group.select("node", F.coalesce("component", "node").alias("label"), F.coalesce("component", "of_home", "home", "node").alias("g"))
    group = store(group, "grouped")
    member = store(rest.join(group, "node"), "entries")
    drop("lists", "first")
    several = member.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    several = store(several.where("lo < hi").select("token", "n"), "several")
    groups = labels
    if not several.isEmpty():
        member = store(join_hot(member, several, ["token"], member.count()), "matrix")
        drop("entries", "several")
        tail = F.col("size") - F.col("pos") - 1
        bounds = {"least": F.min("size"), "most": F.max("size"), "far": F.max("pos"), "tail": F.max(tail), "lo": F.min("label"), "hi": F.max("label")}
        # a token of many entries meets its part of the matrix in several tasks
        split = F.ceil(F.col("n") / SPLIT).cast("long")
        every = F.explode(F.sequence(F.lit(0).cast("long"), split - 1))
        matrix = member.groupBy("token", "g", "n").agg(*[v.alias(k) for k, v in bounds.items()]).withColumn("part", every).drop("n")
        query = member.select("token", F.pmod(F.xxhash64("node"), split).alias("part"), F.col("node").alias("q"), F.col("size").alias("qn"), F.col("pos").alias("qi"), F.col("g").alias("qg"), F.col("label").alias("ql"))
        fits = (NUM * F.col("qn") <= DEN * F.col("most")) & (NUM * F.col("least") <= DEN * F.col("qn"))
        other = (F.col("lo") != F.col("ql")) | (F.col("hi") != F.col("ql"))
        bound = F.least("qi", "far") + 1 + F.least(F.col("qn") - F.col("qi") - 1, F.col("tail"))
        needed = F.ceil(NUM * (F.col("qn") + F.greatest(F.col("least"), NUM * F.col("qn") / DEN)) / (NUM + DEN) - F.lit(1e-6))
        opened = query.join(matrix, ["token", "part"]).where((F.col("g") <= F.col("qg")) & fits & other & (bound >= needed)).select("g", "q").distinct()
        opened = store(opened, "opened")
        drop("matrix")
        inside = store(group.select("g", F.col("node").alias("x")).join(opened.select("g").distinct(), "g"), "inside")
        more = store(_compared(opened, inside, texts, n), "more")
        drop("texts", "opened", "inside", "grouped")
        if not more.isEmpty():
            groups = components(more.union(labels.select("node", "component")))
    named = store(reps.join(groups, "node", "left").select("node", "rep", "docs", F.coalesce("component", "node").alias("g")), "members")
    low = store(named.groupBy("g").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "low")
    named = store(join_hot(named, low, ["g"], rows).select("node", "component_id", F.col("docs").alias("n")), "named")
    known = join_hot(sets.where("node is not null").withColumnRenamed("n", "size"), named, ["node"], rows, "left")
    known = known.select("doc_id", "version", F.col("size").alias("n"), "component_id")
    out = known.unionByName(sets.where("node is null").select("doc_id", "version", "n", F.lit(None).cast("long").alias("component_id")))
    found_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "version", F.col("n").alias("n_shingles"), found_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = Stored(out, "classes").df
    drop(*done)
    return out
