"""Operator 9: quality rules as a bitmask ledger, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the ledger, one per rule. A rule keeps its bit for good; new rules get new bits.
RULES = {"few_words": 0, "repeated_words": 1, "symbols": 2, "repeated_lines": 3, "word_length": 4, "capitals": 5}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {"base-1": BASE, "standard-1": (*BASE, "symbols", "repeated_lines"), "standard-2": tuple(RULES)}
SPACES = "\t\n\x0b\f\r"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r] for r in rules)


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _neighbours(a: Column, n: Column, f) -> Column:
    return F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), f)


def ledger(docs: DataFrame) -> DataFrame:
    """Every rule once: doc_id, measurements, and failure bits in ``fail_bits``.

    No shuffle and no Python. Words are runs of anything but space and U+0009 to U+000D. Repeated
    words come from the document's three-word windows, hashed to 64 bits and sorted within the row
    only where some window repeats. A null text is an empty one: no words, so ``few_words`` fails. A
    null doc_id stays null; repeated rows give repeated results; other columns are pruned; an empty
    table gives no rows.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    d = d.select(
        "doc_id",
        F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES + " ", "")) > 0).alias("lines"),
        F.length(F.translate("text", SPACES + " ", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        _count(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
    )
    words = F.col("words")
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(repeats, placed))
    n = F.size("placed") - 1
    pairs = _neighbours(F.col("placed"), n, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("at", F.when(F.col("placed").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))))
    covered = F.aggregate(_neighbours(F.col("at"), F.size("at") - 1, lambda a, b: F.least(F.lit(3), b - a)), F.lit(3), lambda s, x: s + x)
    d = d.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), covered).otherwise(F.lit(0)).cast("long")).drop("windows", "placed", "at")
    fails = {
        "few_words": F.col("n_words") < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 20 * F.col("n_words"),
        "repeated_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "capitals": 100 * F.col("n_capitals") > 60 * F.col("word_chars"),
    }
    bits = [F.when(f, F.lit(1 << RULES[r])).otherwise(F.lit(0)) for r, f in fails.items()]
    return d.withColumn("fail_bits", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """``base_failed`` and ``kept`` under a policy; the ledger is not evaluated again."""
    base, all_ = mask(BASE), mask(POLICIES[version]) | mask(BASE)
    return rows.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(base) != 0, "kept": F.col("fail_bits").bitwiseAND(all_) == 0})


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    Counts failure masks first (at most 2**rules rows), then reads the rules from the masks.
    """
    m = mask(POLICIES[version])
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(m).alias("mask")).count()
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in POLICIES[version]])
    failed = counts.select("mask", "count", F.inline(rules))
    return failed.groupBy("rule").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, tri) > 1),
n AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN n USING (rid)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT
        + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
        + 32 * (100 * n_capitals > 60 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
