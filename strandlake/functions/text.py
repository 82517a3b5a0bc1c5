"""String expressions: normalisation, extraction, sentence and paragraph chunks (STR-1..9, CHK-1..2, JSN-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 ASCII punctuation characters as a class, the articles, the sentinel of an unreadable
#: number and the digits beyond which a number counts as one.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")
INVALID = -9999999
DIGITS = 4300
SENTENCE = r"(?<=\.)\s*(?=[A-Z]|\n)"


def spaced(s: Column) -> Column:
    """Lower case, without ASCII punctuation, a blank for any run of white space.

    A split by a pattern compiles it for every row, a replacement once; single blanks are left as they are.
    """
    return F.regexp_replace(F.regexp_replace(F.lower(s), PUNCTUATION, ""), r"(?U)\s{2,}|[^\S ]", " ")


def answer_tokens(s: Column) -> Column:
    """Lower-case words without ASCII punctuation and articles."""
    return F.filter(F.split(spaced(s), " "), lambda w: ~w.isin("", *ARTICLES))


def normalize_answer(s: Column) -> Column:
    return F.array_join(answer_tokens(s), " ")


def normalize_evidence(s: Column) -> Column:
    """As an answer, but articles stay."""
    return F.trim(spaced(s))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def assistant_reply(s: Column) -> Column:
    """What follows the first role line, stripped; empty without one."""
    return strip(F.regexp_extract(s, r"(?s)assistant\n{1,2}(.*)", 1))


def marked_parts(s: Column, marker: str = "##") -> Column:
    """Non-empty stripped parts between markers."""
    return F.filter(F.transform(F.split(s, marker), strip), lambda x: x != "")


def sub_questions(s: Column, marker: str = "##") -> Column:
    """Stripped parts after the first marker; empty ones stay."""
    parts = F.split(s, marker)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), strip)


def after_thinking(s: Column) -> Column:
    return F.substring_index(s, "</think>\n\n", -1)


def answer_value(s: Column) -> Column:
    """The last run of digits, commas dropped, as decimal text; INVALID if there is none or another number starts with a 0.

    Text, since a number may have any length up to ``DIGITS``; cast it where a type holds it.
    """
    found = F.regexp_extract_all(F.regexp_replace(s, ",", ""), F.lit(r"(\d+)"), F.lit(1))
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    zeros = last.rlike("^0+$")
    bad = last.isNull() | (F.length(last) > DIGITS) | (last.startswith("0") & ~zeros)
    return F.when(bad, F.lit(str(INVALID))).when(zeros, F.lit("0")).otherwise(last)


def detailed_instruct(task: Column, query: Column) -> Column:
    return F.format_string("Instruct: %s\nQuery: %s", task, query)


def sentences(text: Column) -> Column:
    """Split after '.', optional space, before a capital or a line feed; zero-width splits count."""
    return F.split(text, SENTENCE)


def paragraph_sentences(text: Column) -> Column:
    return F.flatten(F.transform(F.split(text, "\n\n"), sentences))


def stride_chunks(text: Column, size: int = 3000, overlap: int = 600) -> Column:
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
