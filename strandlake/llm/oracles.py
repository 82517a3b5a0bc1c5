"""DuckDB SQL for operators that SQL can express on whole tables, though not at their speed."""

from __future__ import annotations

#: A label per node: the smallest id that reaches it. ``links`` (a, b) holds each link both ways, ``nodes`` (id).
REACH = """reach AS (SELECT id, id AS low FROM nodes UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id WHERE r.low < l.b)"""

#: Every 100-byte window is grouped with its equals; all but the first of a group cover their bytes.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 200) AS w FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99)) AS i FROM d)),
again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 100 THEN 0 ELSE 1 END AS fresh FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), max(length(h)) // 2 FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT g.doc_id, sha256(unhex(coalesce(string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a), ''))) AS kept_sha256 FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM spans GROUP BY doc_id) s ON s.doc_id = d.doc_id"""

#: All pairs of usable vectors; what the hashing finds must be all of them for the results to agree.
NEAR_VECTORS = f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (SELECT vec_id, v, len(v) AS n FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.n = b.n AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
nodes AS (SELECT vec_id AS id FROM e), {REACH},
c AS (SELECT id, min(low) AS low FROM reach GROUP BY id), k AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, low AS component_id, id = low AS kept FROM c LEFT JOIN k ON k.a = c.id"""

#: An index of shingles counts what two documents share; documents with one set are one node of it.
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
rep AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
i AS (SELECT node, n, unnest(s) AS t FROM rep),
p AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c FROM i a JOIN i b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)), links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
nodes AS (SELECT node AS id FROM rep), {REACH},
c AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept
FROM s LEFT JOIN rep ON rep.s = s.s LEFT JOIN c ON c.id = rep.node"""


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, folded byte by byte through the table of its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(c)
    h = f"hex(encode({text}))"
    data = f"list_transform(range(0, length({h}) // 2), lambda i: CAST('0x' || substr({h}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _hilbert(source: str, bits: int, dims: int) -> list[str]:
    """Common table expressions h0, h1, ...: columns x0, x1, ... of ``source`` turned into ``curve``, after Skilling (2004)."""
    steps, at = [], source

    def step(**new: str) -> None:
        nonlocal at
        steps.append(f"h{len(steps)} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in new.items())}) FROM {at})")
        at = f"h{len(steps) - 1}"

    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        step(x0=f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {p}) ELSE x0 END")
        for i in range(1, dims):
            swap = f"xor(x0, x{i}) & {p}"
            step(**{"x0": f"xor(x0, CASE WHEN x{i} & {q} <> 0 THEN {p} ELSE {swap} END)", f"x{i}": f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END"})
    for i in range(1, dims):
        step(**{f"x{i}": f"xor(x{i}, x{i - 1})"})
    turn = "0"
    for b in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN x{dims - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    step(**{f"x{i}": f"xor(x{i}, {turn})" for i in range(dims)})
    index = " + ".join(f"(((x{i} >> {b}) & 1) << {b * dims + dims - 1 - i})" for b in range(bits) for i in range(dims))
    steps.append(f"curved AS (SELECT *, {index} AS curve FROM {at})")
    return steps


def sharding(bits: int, shards: int = 16) -> str:
    """Law ``rows``: ranks along the curve, cut into runs whose lengths differ by one at most."""
    cell = f"{_crc32('coalesce({}, chr(0))')} % {1 << bits}"
    start = "CASE WHEN shard < r THEN shard * (q + 1) ELSE r * (q + 1) + (shard - r) * q END"
    return f"""WITH m AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32, {cell.format("lang", "lang")} AS x1, {cell.format("source", "source")} AS x2 FROM documents),
p AS (SELECT *, least(length(ltrim(CAST(CAST(size AS BIT) AS VARCHAR), '0')) - 1, {(1 << bits) - 1}) AS x0 FROM m),
{", ".join(_hilbert("p", bits, 3))},
k AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id) - 1 AS rank, count(*) OVER () // {shards} AS q, count(*) OVER () % {shards} AS r FROM curved),
s AS (SELECT *, CASE WHEN q = 0 THEN rank WHEN rank < r * (q + 1) THEN rank // (q + 1) ELSE r + (rank - r * (q + 1)) // q END AS shard FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(rank - ({start}) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""
