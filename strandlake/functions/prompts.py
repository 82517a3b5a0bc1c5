"""Prompt templates and their columns (PRM-1..8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The templates' texts; {} marks a place.
SIMPLE_RAG = """
Answer the question based on the given document.
Only give me the answer and do not output any other words.
The following are given documents:
<documents> 
{}.
</documents>

Address the following question: {}.
"""
DOCUMENT = "\n{}\n"
SIMPLE_COT = """
Q: {}
A: Let's think step by step.

**IMPORTANT**
- Structure each thought in paragraphs.
"""
FIRST_RAT = """
With the provided information as context: 
{}.

Address the following question in a step-by-step manner: {}.

**IMPORTANT**
- Structure each thought in paragraphs, ensuring each is clearly separated by "##". 
- Refrain from using digits or numbered lists. Limit the response to a maximum of {} paragraphs.
"""
REVISE = """
With the provided information:
{},

and your previous revised answers: 
{},

modify your following answer: 
{}.

**IMPORTANT**
- Just output the revised answer directly. DO NOT add additional explanations or introducement in the answer unless you are asked to.
- You need to check whether the answer is correct.
- If you find some errors in the answer, revise the answer to make it better.
- If you find some necessary details are ignored, add it to make the answer more plausible according to the related text.
- If you find the answer is right and do not need to add more details, just output the original answer directly.
"""
SUMMARIZE = """
Given the following related information:
{},

and your revised answer chain:
{},

Summarize and structure your answer to the following question: {}.

**IMPORTANT**
- DO NOT add additional explanations or introducement in the answer unless you are asked to.
- You need to check whether the answer is correct.
- Start with "In summary,"
- If you find some errors in the answer, revise the answer to make it better.
- If you find some necessary details are ignored, add it to make the answer more plausible according to the related text.
- If you find the answer is right and do not need to add more details, just output the original answer directly.
"""
BASE = """
With provided related documents:
<documents_section>
{}
</documents_section>

Answer the question:
<question_section>
{}
</question_section>"""
RANKED = (
    BASE
    + """

The importance ranking of documents for this query is:
<importance_ranking_section>
{}
</importance_ranking_section>

Please prioritize information from higher-ranked documents when there are conflicts or overlapping information."""
)

SUB_QUESTIONS = """
    Here is the question: {}  
    Before answering this question, what sub-questions need to be addressed? 
    Please list them one by one and add ## before you state these questions.
    Do not assign numbers as the bullet points.
    """
SHORT_ANSWER = "Using the folloing information: {}. Answer the following question in less than 5-7 words, if possible: {}"
QA_SYSTEM = (
    "You are a helpful assistant that answers questions directly without description based on provided documents.\n"
    "1. Please directly answer the question without description. If the answer is Yes or No, just say Yes or No\n"
    "2. Do not include any special characters like <answer> or </answer>.\n"
    "3. If there is insufficient information, just say 'Insufficient information'."
)
QA_USER = "Please answer a question according to given documents.\n{}"
QA_CHAT = QA_SYSTEM + "\n\n" + QA_USER
QA_TOKENS = 5
QUERY_TASK = "Given a question, retrieve passages that answer the question"


def fill(template: str, *values: Column) -> Column:
    """The template with its places filled in order; nothing in a value is read as a place."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:], strict=True):
        out += [v, F.lit(p)]
    return F.concat(*out)


def documents_section(docs: Column) -> Column:
    """array of struct(id, text), in order, as '[Doc id] text' paragraphs."""
    return F.regexp_replace(F.array_join(F.transform(docs, lambda d: F.concat(F.lit("[Doc "), d["id"].cast("string"), F.lit("] "), d["text"])), "\n\n"), r"(?U)^\s+|\s+$", "")


def importance(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("[Doc "), i.cast("string"), F.lit("]"))), " > ")


def simple_rag(texts: Column, question: Column) -> Column:
    return fill(SIMPLE_RAG, F.array_join(F.transform(texts, lambda t: fill(DOCUMENT, t)), ""), question)


def chat(system: Column, user: Column) -> Column:
    """array of struct(role, content)."""
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user))


def document_turns(prompt: Column) -> Column:
    """The turns that ask a request's prompt under the multi-document instructions."""
    return chat(F.lit(QA_SYSTEM), fill(QA_USER, prompt))


class RankedPrompts:
    """Prompts over a corpus (chunk_id, text), or over a mapping of ids to texts that is not empty.

    Batches join requests (position, question, doc_ids, ranking) by row, so no part of one can run out before
    another; ids without a text are skipped among the documents, but stay in the ranking.
    """

    def __init__(self, spark=None, corpus: DataFrame | dict[int, str] | None = None):
        if corpus is None or corpus == {}:
            raise ValueError("a corpus is needed: a table (chunk_id, text) or a mapping with at least one text")
        if isinstance(corpus, dict):
            if spark is None:
                raise ValueError("a mapping needs a session")
            corpus = spark.createDataFrame(list(corpus.items()), "chunk_id long, text string")
        self.corpus = corpus.select("chunk_id", "text")

    def _sections(self, requests: DataFrame, ids: str) -> DataFrame:
        """Requests with the texts of the documents that a column lists, in its order."""
        items = requests.select("position", F.posexplode(ids).alias("at", "chunk_id")).join(self.corpus, "chunk_id")
        texts = F.array_sort(F.collect_list(F.struct("at", F.col("chunk_id").alias("id"), "text")))
        none = F.array().cast("array<struct<id:bigint,text:string>>")
        docs = items.groupBy("position").agg(F.transform(texts, lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"))).alias("docs"))
        return requests.join(docs, "position", "left").withColumn("section", documents_section(F.coalesce("docs", none))).drop("docs")

    def ranked(self, requests: DataFrame) -> DataFrame:
        """position, prompt: the documents in list order and the ranking."""
        return self._sections(requests, "doc_ids").select("position", fill(RANKED, F.col("section"), F.col("question"), importance(F.col("ranking"))).alias("prompt"))

    def original_order(self, requests: DataFrame) -> DataFrame:
        """position, prompt: the documents in the order of the ranking, without it."""
        return self._sections(requests, "ranking").select("position", fill(BASE, F.col("section"), F.col("question")).alias("prompt"))
