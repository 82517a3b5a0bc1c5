"""The evaluation driver, staged answers, dendrograms and entry points."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.functions import text
from strandlake.operators import evaluate, rag, tree
from strandlake.plans.catalog import QUERIES


def files(at, ids):
    gold = [
        {"_id": "a", "answer": "New York", "answer_id": "Q1", "supporting_facts": [["T", 0], ["U", 2]], "evidences": [["Bob", "city", "New York"]], "evidences_id": [ids]},
        {"_id": "b", "answer": "no", "answer_id": None, "supporting_facts": [["T", 1]], "evidences": [["x", "r", "y"]], "evidences_id": []},
    ]
    pred = {"answer": {"a": "the big apple"}, "sp": {"a": [["t", 0], ["V", 2]], "b": [["T", 1]]}, "evidence": {"a": [["bob", "city", "Big Apple"]]}}
    (at / "gold.json").write_text(json.dumps(gold))
    (at / "pred.json").write_text(json.dumps(pred))
    (at / "alias.jsonl").write_text(json.dumps({"Q_id": "Q1", "aliases": ["Big Apple"], "demonyms": ["New Yorker"]}) + "\n")
    return ["eval", *[str(at / f) for f in ("pred.json", "gold.json", "alias.jsonl")]]


def test_eval(spark, tmp_path):
    got = cli.main(files(tmp_path, ["Q2", "city", "Q1"]), spark)
    assert (got["em"], got["f1"], got["prec"], got["recall"]) == (50, 50, 50, 50)
    assert (got["sp_em"], got["sp_f1"], got["sp_prec"], got["sp_recall"]) == (50, 75, 75, 75)
    assert (got["evi_em"], got["evi_f1"]) == (50, 50)
    assert (got["joint_em"], got["joint_f1"], got["joint_prec"], got["joint_recall"]) == (0, 25, 25, 25)


def test_eval_refuses_ids_that_do_not_fit(spark, tmp_path):
    with pytest.raises(PySparkException):
        cli.main(files(tmp_path, ["Q2", "other", "Q1"]), spark)


def test_eval_counts_each_gold(spark, tmp_path):
    """A gold that is listed twice counts twice, and a prediction once, though it fits two triples; names may be many."""
    gold = spark.createDataFrame(
        [("a", "x", None, [["T", "0"]], [["p", "r", "q"], ["P.", "r", "q"]], [["Q1", "r", "Q2"]] * 2)] * 2 + [("b", "y", "Q1", [], [["u", "r", "v"]], [])],
        "_id string, answer string, answer_id string, supporting_facts array<array<string>>, evidences array<array<string>>, evidences_id array<array<string>>",
    )
    answers = spark.createDataFrame([("a", "x"), ("b", "the Alias")], "_id string, pred string")
    facts = spark.createDataFrame([("a", [["t", "0"]])], "_id string, pred array<array<string>>")
    evidences = spark.createDataFrame([("a", [["alias", "r", "Q"], ["p", "r", "other"], ["p", "s", "q"]])], "_id string, pred array<array<string>>")
    names = spark.createDataFrame([("Q1", ["alias"]), ("Q2", ["else", "Other!"])], "Q_id string, names array<string>")
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = evaluate.evaluation(gold, answers, facts, evidences, names).first()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert (got["em"], got["sp_em"], got["evi_prec"], got["evi_recall"]) == (100, 66.67, 44.44, 66.67), limit
        assert (got["joint_em"], got["joint_prec"], got["joint_recall"]) == (0, 44.44, 66.67), limit


def test_evaluation_deals_lines_once(spark):
    """Few alias ids name all triples: dealt by id, they would go to as many tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        plan = QUERIES["evaluation"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(s_id" not in plan and "hashpartitioning(o_id" not in plan
    assert plan.count("hashpartitioning(") == 2 and plan.count("lineitem.parquet") == 1


def test_odd_white_space(spark):
    rows = ["", " ", "a", "The  cat.\tsat", "x\u00a0y", " \u2003an  A-b\n", "\u3000 \x85z\x1f!", "q\r\n , w ", ". a . b", "\u0130 x"]
    got = spark.createDataFrame([(r,) for r in [*rows, None]], "s string").select("s", text.normalize_evidence(F.col("s")).alias("e"), text.answer_tokens(F.col("s")).alias("t"), F.filter(F.split(F.regexp_replace(F.lower("s"), text.PUNCTUATION, ""), r"(?U)\s+"), lambda w: w != "").alias("w")).collect()
    for r in got:
        assert r["e"] == (" ".join(r["w"]) if r["w"] is not None else None), r
        assert r["t"] == ([w for w in r["w"] if w not in text.ARTICLES] if r["w"] is not None else None), r


def test_label_sets(spark):
    rows = [("x</think>\n\nyes", ["no", "Yes"]), ("a b", ["b"]), ("lost", []), (None, ["q"])]
    got = evaluate.label_set_means(spark.createDataFrame(rows, "answer string, labels array<string>")).first()
    assert (got["n"], got["em"], got["f1"]) == (2, 1.0, 1.0)


class Sub:
    def chat(self, prompts, max_new_tokens=1024):
        return ["assistant\nhere ## one ## two" if "sub-questions" in p else "assistant\nA" + str(p.count("Q: ")) for p in prompts]


def test_cot_rag(spark):
    corpus = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "chunk_id long, text string")
    q = spark.createDataFrame([(0, "why"), (1, "how")], "idx long, question string")
    rows = rag.cot_rag(q, corpus, 2, rag.StubEmbedding, Sub).orderBy("idx").collect()
    assert [(r["chain"], r["response"], r["error"]) for r in rows] == [("Q: one\nA: A0\nQ: two\nA: A2", "A3", None)] * 2


def test_dendrogram(spark):
    rows = [[1, 2, 3], [3, 2, 1], [1, 2, 4], [9], []]
    nodes = tree.dendrogram(spark.createDataFrame(list(enumerate(rows)), "idx long, doc_ids array<long>"), "direct").collect()
    assert sorted(n["node_id"] for n in nodes if n["is_query"]) == [0, 1, 2, 3]
    inner = {tuple(n["original_indices"]): (n["content"], n["frequency"]) for n in nodes if not n["is_query"]}
    assert inner == {(0, 1): ([1, 2, 3], 2), (0, 1, 2): ([1, 2], 0)}
    by = {n["node_id"]: n for n in nodes}
    assert by[3]["parent"] is None and by[by[0]["parent"]]["parent"] == by[2]["parent"]


def test_topk_and_qa(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text(json.dumps({"qid": "q", "question": "text 3", "title": "t", "answers": ["x"]}) + "\n")
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"text": f"text {i} in 't'"}) + "\n" for i in range(5)))
    stub = "strandlake.operators.rag:StubEmbedding"
    assert cli.main(["topk", str(tmp_path / "q.jsonl"), str(tmp_path / "c.jsonl"), str(tmp_path / "o"), "--k", "2", "--embeddings", stub], spark)["written"]
    out = spark.read.json(str(tmp_path / "o")).first()
    assert out["qid"] == "q" and len(out["top_k_doc_id"]) == 2 and out["text"] == "text 3 in 't'"
    (tmp_path / "d.jsonl").write_text(json.dumps({"prompt": "say this", "answer": ["say this ## stub"]}) + "\n")
    for _ in range(2):
        got = cli.main(["qa", "--data-path", str(tmp_path / "d.jsonl"), "--chat", "strandlake.operators.rag:StubChat", "--result-file", str(tmp_path / "r")], spark)
    assert got["n"] == 1 and got["em"] == 1.0 and spark.read.json(str(tmp_path / "r")).where(F.col("latency") >= 0).count() == 2
