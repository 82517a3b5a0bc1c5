"""Staged answers against a plain loop, providers, prompts, and the stored vector index."""

import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import costs, prompts, similarity, text, vectors
from strandlake.operators import chunking, graph, knn, overlap, placement, rag, ranks, reorder, tree, vector_index
from strandlake.sources import jsonl


class Echo:
    """A chat provider that tells what it was asked, so that answers show every prompt before them."""

    parts = {"q0": 7, "q1": 2, "q2": 0}

    def chat(self, asked, max_new_tokens=1024):
        out = []
        for p in asked:
            if "step-by-step" in p:
                q = p.split("step-by-step manner: ")[1].split(".")[0]
                out.append("assistant\n" + "".join(f"## {q}part{k} " for k in range(self.parts[q])))
            else:
                out.append("assistant\n" + f"[{len(p)}:{sum(p.encode()) % 9973}]" + p.strip().splitlines()[-1][:9])
        return out


def loop_rat(question, corpus, vecs, k):
    """The same one query at a time, as plain text."""
    embed, chat = rag.StubEmbedding(), Echo()
    ask = lambda p: chat.chat([p])[0].removeprefix("assistant\n").strip()

    def search(t):
        q = np.array(embed.encode([t], True)[0])
        d = np.round([((np.array(v) - q) ** 2).sum() for v in vecs], 9)
        return [corpus[i] for i in sorted(range(len(corpus)), key=lambda i: (d[i], i))[:k]]

    fill = lambda template, *values: "".join(a + b for a, b in zip(template.split("{}"), [*values, ""], strict=True))
    draft = ask(fill(prompts.FIRST_RAT, ", ".join(search(question)), question, "5"))
    parts = [x.strip() for x in draft.split("##") if x.strip()]
    revised, found = [], []
    for part in parts:
        found.append("\n\n- ".join(search("\n\n".join([question, *revised, part]))))
        revised.append(ask(fill(prompts.REVISE, "\n\n".join(found), "\n\n".join(revised), part)))
    return revised, ask(fill(prompts.SUMMARIZE, "\n\n".join(found), "\n\n".join(revised), question))


def test_rat_matches_a_plain_loop(spark):
    """All parts are revised, seven of them too; findings and answers accumulate; the question leads each search."""
    corpus = [f"text number {i} about q{i % 3}part{i % 7}" for i in range(30)]
    embed = rag.StubEmbedding()
    docs = spark.createDataFrame(list(enumerate(corpus)), "chunk_id long, text string")
    q = spark.createDataFrame([(k, f"q{k}") for k in range(3)], "idx long, question string")
    vecs = embed.encode(corpus, False)
    got = {r["question"]: (r["chain"], r["response"], r["error"]) for r in rag.rat(q, docs, 2, rag.StubEmbedding, Echo).collect()}
    for question in ("q0", "q1", "q2"):
        chain, answer = loop_rat(question, corpus, vecs, 2)
        assert got[question] == (chain, answer, None) and len(chain) == Echo.parts[question]


def test_engine_embeds_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "chunk_id long, text string")
    q = spark.createDataFrame([(0, "text 3"), (1, "text 5")], "idx long, question string")
    engine = rag.Engine(docs, rag.StubEmbedding, rag.StubChat)
    assert "ArrowEvalPython" not in engine.vectors._jdf.queryExecution().executedPlan().toString()
    assert {r["docs"][0]["id"] for r in engine.search(q, 1).collect()} == {3, 5}
    engine.upsert(spark.createDataFrame([(3, "other words"), (9, "text 3")], "chunk_id long, text string"))
    assert {r["docs"][0]["id"] for r in engine.search(q, 1).collect()} == {9, 5}
    assert engine.chunks.count() == engine.vectors.count() == 7
    assert engine.rag(q, 2).where("error is null").count() == engine.rag_cot(q, 2).count() == engine.cot_rag(q, 2).count() == engine.rat(q, 2).count() == 2
    assert engine.rag_cot(q, 2).where("prompt like '%step by step%'").count() == 2
    spent = rag.timing(engine.cot_rag(q.limit(1), 2), q).first()
    assert spent["n"] == 2 and spent["total"] > 0 and spent["mean"] == pytest.approx(spent["total"] / 2)
    assert engine.embed_queries(q).where("size(v) = 16").count() == 2 and engine.chat(q.withColumn("prompt", F.col("question"))).count() == 2


def test_engine_over_a_cache_and_an_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} word{i % 5}") for i in range(40)], "chunk_id long, text string")
    q = spark.createDataFrame([(0, "text 3 word3"), (1, "text 21 word1")], "idx long, question string")
    calls = spark.sparkContext.accumulator(0)

    def counted():
        calls.add(1)
        return rag.StubEmbedding()

    for _ in range(2):
        engine = rag.Engine(docs, counted, rag.StubChat, cache=str(tmp_path / "v"), dim=16)
    assert calls.value > 0 and (tmp_path / "v_dim=16").exists()
    before = calls.value
    rag.Engine(docs, counted, rag.StubChat, cache=str(tmp_path / "v"), dim=16)
    assert calls.value == before
    exact = {r["idx"]: [d["id"] for d in r["docs"]] for r in engine.search(q, 3).collect()}
    index = vector_index.VectorIndex.build(engine.vectors, str(tmp_path / "i"), lists=4)
    indexed = rag.Engine(docs, rag.StubEmbedding, rag.StubChat, index)
    assert {r["idx"]: [d["id"] for d in r["docs"]] for r in indexed.search(q, 3).collect()} == exact and exact[0][0] == 3
    indexed.upsert(spark.createDataFrame([(77, "text 3 word3"), (3, "gone")], "chunk_id long, text string"))
    # hashed words collide, so other texts can tie with the new one
    after = {r["idx"]: [d["id"] for d in r["docs"]] for r in indexed.search(q, 3).collect()}
    assert 77 in after[0] and 3 not in after[0] and after[1] == exact[1]
    assert indexed.rat(q, 2).where("error is null").count() == 2


class Picky:
    def chat(self, asked, max_new_tokens=1024):
        def one(p):
            if "bad" in p:
                raise ValueError("refused")
            return f"assistant\n{p} {max_new_tokens}"

        return rag.concurrently(one, asked, 3)


def test_failures_are_dropped_and_order_is_kept(spark):
    rows = spark.createDataFrame([(i, "bad" if i % 4 == 1 else f"p{i}") for i in range(12)], "position long, prompt string").repartition(3)
    out = rag.generate(rows, Picky, max_new_tokens=7)
    assert [r["error"] for r in out.where("error is not null").collect()] == ["refused"] * 3
    assert [r["response"] for r in rag.answered(out, "position").collect()] == [f"p{i} 7" for i in range(12) if i % 4 != 1]
    remote = rag.RemoteChat(lambda p, n: f"{p}{n}").chat(["a", "b"], 3)
    assert remote == ["a3", "b3"]


def test_http_embeddings(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if asked["input"] == "broken" or self.path != "/embeddings":
                self.send_error(500)
                return
            body = json.dumps({"data": [{"embedding": [float(len(asked["input"])), 1.0]}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            return

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(0, "abc"), (1, "broken"), (2, "abcde")], "i long, t string")
    got = rag.embed(rows, lambda: rag.HttpEmbedding(url, "model", workers=2), "t").orderBy("i").collect()
    server.shutdown()
    assert [r["v"] for r in got] == [[3.0, 1.0], None, [5.0, 1.0]]


def test_query_instruction_and_truncation():
    seen = []

    class Spy:
        def encode(self, texts, is_query, max_length=4096):
            seen.extend(texts)
            return [[0.0]] * len(texts)

    rag.Instructed(Spy()).encode(["who?"], True)
    rag.Instructed(Spy()).encode(["a passage"], False)
    assert seen == ["Instruct: Given a question, retrieve passages that answer the question\nQuery: who?", "a passage"]
    stub = rag.StubEmbedding()
    assert stub.encode(["a b c d"], False, 2) == stub.encode(["a b"], False)


def test_prompt_object(spark, tmp_path):
    with pytest.raises(ValueError):
        prompts.RankedPrompts(spark)
    with pytest.raises(ValueError):
        prompts.RankedPrompts(spark, {})
    p = prompts.RankedPrompts(spark, {1: "one", 2: "two"})
    asked = spark.createDataFrame([(0, "why", [2, 7, 1], [7, 1, 2]), (1, "how", [], [])], "position long, question string, doc_ids array<long>, ranking array<long>")
    ranked = {r["position"]: r["prompt"] for r in p.ranked(asked).collect()}
    assert "[Doc 2] two\n\n[Doc 1] one\n</documents_section>" in ranked[0] and "[Doc 7] > [Doc 1] > [Doc 2]" in ranked[0] and "higher-ranked" in ranked[1]
    plain = {r["position"]: r["prompt"] for r in p.original_order(asked).collect()}
    assert "[Doc 1] one\n\n[Doc 2] two\n</documents_section>" in plain[0] and "ranking" not in plain[0]
    questions = spark.createDataFrame([(0, "why", ["a"]), (1, "how", [])], "position long, question string, answer array<string>")
    assert jsonl.write_prompts(p.ranked(asked), questions, str(tmp_path / "p"))
    lines = [json.loads(x) for f in sorted((tmp_path / "p").glob("part*")) for x in f.read_text().splitlines()]
    assert [(x["prompt"], x["question"], x["answer"]) for x in lines] == [(ranked[0], "why", ["a"]), (ranked[1], "how", [])]
    turns = spark.range(1).select(prompts.document_turns(F.lit("docs and a question")).alias("t")).first()["t"]
    assert [t["role"] for t in turns] == ["system", "user"] and turns[1]["content"].endswith("docs and a question")


def test_templates_are_whole():
    for template, ends in ((prompts.REVISE, "just output the original answer directly.\n"), (prompts.SUMMARIZE, "just output the original answer directly.\n")):
        assert template.endswith(ends) and template.count("\n- ") >= 5 and template.count("{}") == 3
    assert '- Start with "In summary,"' in prompts.SUMMARIZE


def test_answer_values_of_any_length(spark):
    rows = ["no", "it is 1,234", "05", "000", "7" * 40, "8" * 4301]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(text.answer_value(F.col("s"))).collect()]
    assert got == ["-9999999", "1234", "-9999999", "0", "7" * 40, "-9999999"]


def test_multiset_overlap(spark):
    from collections import Counter

    rows = [(["a", "b", "b", "c"], ["b", "b", "b", "d", "a"]), ([], ["a"]), (["x"], ["y"]), (["z"] * 9, ["z"] * 4)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(similarity.multiset_overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [sum((Counter(a) & Counter(b)).values()) for a, b in rows]


def test_recursive_chunks_against_a_plain_version():
    def plain(t, size, overlap, ladder=chunking.LADDER):
        if len(t) <= size:
            return [t.strip()] if t.strip() else []
        sep = next((s for s in ladder if s in t), "")
        finer = ladder[ladder.index(sep) + 1 :]
        out, held = [], []
        for p in [x for x in (t.split(sep) if sep else list(t)) if x]:
            if len(p) > size:
                out += [sep.join(held)] * bool(held) + plain(p, size, overlap, finer or ("",))
                held = []
                continue
            if held and len(sep.join([*held, p])) > size:
                out.append(sep.join(held))
                while held and (len(sep.join(held)) > overlap or len(sep.join([*held, p])) > size):
                    held = held[1:]
            held = [*held, p]
        return [x.strip() for x in out + [sep.join(held)] * bool(held) if x.strip()]

    import random

    rnd = random.Random(7)
    for _ in range(60):
        t = "".join(rnd.choice(["word", " ", "\n", "\n\n", "x" * rnd.randrange(40)]) for _ in range(rnd.randrange(200)))
        assert chunking.recursive_chunks(t, 60, 20) == plain(t, 60, 20)


def test_ranks(spark, monkeypatch):
    rows = spark.createDataFrame([(i * 7 % 50, "hot" if i % 3 else "x") for i in range(50)], "i long, g string").repartition(4)
    got = ranks.ranked(rows, [F.col("g"), F.desc("i")]).collect()
    want = sorted([(r["g"], -r["i"]) for r in got])
    assert [(r["g"], -r["i"]) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(50))
    assert ranks.ranked(rows.limit(0), [F.col("i")]).count() == 0


@pytest.mark.parametrize("tasks", [6, 1_000_000])
def test_graph_components(spark, monkeypatch, tasks):
    import random

    monkeypatch.setattr(graph, "TASK_EDGES", tasks)
    rnd = random.Random(3)
    pairs = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(90)] + [(300 + k, 301 + k) for k in range(30)] + [(5, 5), (None, 7)]
    low = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in low:
        for a, b in pairs:
            if a in low and b in low and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {(r["node"], r["low"]) for r in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == set(low.items())


def test_reordering_has_no_single_partition(spark):
    rows = spark.createDataFrame([(i, [i % 3, i % 7, 100 + i]) for i in range(60)] + [(99, [])], "idx long, doc_ids array<long>")
    out = reorder.rewrite(rows)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["new_pos"] for r in out.collect()) == list(range(61))


def test_frequent_ids_are_split(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [1, 10 + i % 4, 20 + i]) for i in range(40)], "idx long, doc_ids array<long>")
    whole = sorted(map(tuple, overlap.pair_overlap(rows).collect()))
    monkeypatch.setattr(overlap, "SPLIT", 3)
    assert sorted(map(tuple, overlap.pair_overlap(rows).collect())) == whole and len(whole) == 40 * 39 // 2


def test_linkage_against_a_plain_search():
    import random

    def plain(dist, method):
        d = {(i, j): dist[i][j] for i in range(len(dist)) for j in range(i + 1, len(dist))}
        alive, size, names, out = list(range(len(dist))), [1] * len(dist), list(range(len(dist))), []
        get = lambda i, j: d[min(i, j), max(i, j)]
        while len(alive) > 1:
            i, j = min(((i, j) for i in alive for j in alive if i < j), key=lambda p: (get(*p), p))
            if get(i, j) >= 1:
                break
            out.append((names[i], names[j], get(i, j), size[i] + size[j]))
            for m in alive:
                if m not in (i, j):
                    a, b = get(i, m), get(j, m)
                    d[min(i, m), max(i, m)] = {"single": min(a, b), "complete": max(a, b), "weighted": (a + b) / 2, "average": (size[i] * a + size[j] * b) / (size[i] + size[j])}[method]
            alive.remove(j)
            size[i] += size[j]
            names[i] = len(dist) + len(out) - 1
        return out

    rnd = random.Random(9)
    for method in tree.BOUNDED:
        for n in (0, 1, 2, 12, 25):
            x = np.array([[rnd.choice([0.2, 0.4, 0.5, 0.75, 1.0]) for _ in range(n)] for _ in range(n)]).reshape(n, n)
            x = np.minimum(x, x.T)
            assert tree.linkage(x, method) == plain(x, method)


def test_dendrogram_with_one_root(spark):
    rows = [[1, 2], [1, 3], [7], [8, 9], [8, 9], [20], []]
    nodes = {n["node_id"]: n for n in tree.dendrogram(spark.createDataFrame(list(enumerate(rows)), "idx long, doc_ids array<long>"), one_root=True).collect()}
    assert len(nodes) == 6 + 5
    (root,) = (n for n in nodes.values() if n["parent"] is None)
    assert root["original_indices"] == list(range(6)) and root["content"] == [] and root["frequency"] == 0 and root["distance"] == 1
    for n in nodes.values():
        kids = [m for m in nodes.values() if m["parent"] == n["node_id"]]
        assert len(kids) == (0 if n["is_query"] else 2) and sorted(i for m in kids for i in m["original_indices"]) == (n["original_indices"] if kids else [])


def test_closest_path(spark):
    nodes = spark.createDataFrame([(1, [1], None), (2, [1, 2], 1), (3, [1, 2, 3], 2), (4, [9], None)], "node_id long, content array<long>, parent long")
    new = spark.createDataFrame([(0, [1, 2, 3]), (1, [9]), (2, [50])], "idx long, doc_ids array<long>")
    assert sorted((r["idx"], r["node_id"], r["path"]) for r in overlap.closest_path(new, nodes).collect()) == [(0, 3, [3, 2, 1]), (1, 4, [4]), (2, 1, [1])]


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 24))
    x = [(i, (base[i % 30] + rng.normal(size=24) * 0.7).tolist()) for i in range(3000)]
    v = spark.createDataFrame(x, "id long, v array<double>")
    q = v.where("id % 100 = 0").withColumnRenamed("id", "qid")
    exact = knn.knn(q, v, 10)
    index = vector_index.VectorIndex.open_or_build(v, str(tmp_path / "i"), lists=40)
    again = vector_index.VectorIndex.open_or_build(v, str(tmp_path / "i"), lists=40)
    assert (again.centroids == index.centroids).all()
    seen = vector_index.recall(again.search(q, 10), exact).agg(F.avg("recall"), F.count("*")).first()
    assert seen[0] >= 0.9 and seen[1] == 30
    assert index.vectors().count() == 3000
    assert sorted(map(tuple, index.search(q, 10, probes=40).collect())) == sorted(map(tuple, exact.collect()))
    index.append(spark.createDataFrame([(5000, x[0][1])], "id long, v array<double>"))
    assert [r["id"] for r in index.search(q.where("qid = 0"), 2).orderBy("rank").collect()] == [0, 5000]
    other = index.upsert(spark.createDataFrame([(0, x[1][1]), (6000, x[0][1])], "id long, v array<double>"), str(tmp_path / "j"))
    assert [r["id"] for r in other.search(q.where("qid = 0"), 2).orderBy("rank").collect()] == [5000, 6000]
    other.drop()
    assert not (tmp_path / "j").exists()


def test_caches_are_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for size in (300, 300, 600):
        assert jsonl.cached(spark, str(tmp_path / "chunks"), build, size=size).count() == 3
    assert len(built) == 2


def test_small_sources(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"input_data": [{"query_id": "a", "query": "q"}, {"query_id": "b", "query": "r"}]}))
    assert [r["query_id"] for r in jsonl.read_nested(spark, str(tmp_path / "n.json"), "query_id string, query string").collect()] == ["a", "b"]
    (tmp_path / "t.md").write_text("# a\n\nb")
    assert jsonl.read_text(spark, str(tmp_path / "t.md")).first()[0] == "# a\n\nb"
    rows, means = spark.createDataFrame([(1, None)], "id long, v string"), spark.createDataFrame([(0.5,)], "em double")
    jsonl.write_results(rows, means, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "metrics")).first()["em"] == 0.5 and spark.read.json(str(tmp_path / "r" / "results")).count() == 1
    many = spark.range(10).withColumnRenamed("id", "position")
    assert [r[0] for r in jsonl.first_rows(many, "position", 3).collect()] == [0, 1, 2] and jsonl.first_rows(many, "position", None).count() == 10
    found = spark.createDataFrame([(0, 1, 2, 0.1), (0, 2, -1, 9.0)], "qid long, rank int, id long, dist double")
    assert [r["text"] for r in knn.lookup(found, spark.createDataFrame([(2, "two")], "chunk_id long, text string")).collect()] == ["two"]
    tangled = spark.createDataFrame([(1, [], None), (2, [5], 1), (3, [5, 6], 2)], "node_id long, content array<long>, parent long")
    assert sorted((r["node_id"], r["parent"]) for r in tree.prune_empty(tangled).collect()) == [(2, None), (3, 2)]
    price = spark.range(1).select(costs.lambda_price(F.lit(1024))).first()[0]
    assert price == costs.MEMORY_TIERS[1024]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vectors.l2_normalize(F.col("v"))).collect()
    assert [r[0] for r in unit] == [[0.6, 0.8], [0.0, 0.0]]
    pair = spark.createDataFrame([([1.0, 2.0], [3.0, 1.0])], "a array<double>, b array<double>")
    assert [pair.select(vectors.distance(F.col("a"), F.col("b"), m)).first()[0] for m in ("l2", "dot")] == [5.0, -5.0]


def test_files_for_others(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("".join(json.dumps({"v": x}) + "\n" for x in "abc"))
    order = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "ord long, idx long")
    out = reorder.reorder_file(spark, str(tmp_path / "r.jsonl"), "v string", order, str(tmp_path / "o"))
    assert [r["v"] for r in out.collect()] == ["c", "a", "b"]
    assert [json.loads(x)["v"] for f in sorted((tmp_path / "o").glob("part*")) for x in f.read_text().splitlines()] == ["c", "a", "b"]
    answers = spark.createDataFrame([("q", "why", "so", "thus", ["t", "u"])], "query_id string, query string, gt_answer string, response string, texts array<string>")
    assert jsonl.write_checker(answers, str(tmp_path / "c"))
    (line,) = [json.loads(x) for f in (tmp_path / "c").glob("part*") for x in f.read_text().splitlines()]
    assert line == {"query_id": "q", "query": "why", "gt_answer": "so", "response": "thus", "retrieved_context": [{"text": "t"}, {"text": "u"}]}


def test_merges_and_frequencies(spark):
    rows = [[1, 2, 3], [1, 2, 4], [1, 2, 3]]
    nodes = tree.dendrogram(spark.createDataFrame(list(enumerate(rows)), "idx long, doc_ids array<long>"), "direct")
    got = [(r["left"], r["right"], round(r["distance"], 6), r["size"]) for r in tree.merges(nodes).collect()]
    assert got[0] == (0, 2, 0.0, 2) and got[1][0] == 1 and got[1][2:] == (0.333333, 3)
    assert {r["frequency"]: r["nodes"] for r in tree.frequencies(nodes).collect()} == {1: 3, 2: 1, 0: 1}


def test_linkages_on_squares():
    """Points on a line: distances of centroids, of midpoints, and Ward's, worked out by hand."""
    x = np.abs(np.subtract.outer([0.0, 0.2, 1.0], [0.0, 0.2, 1.0]))
    assert [round(m[2], 9) for m in tree.linkage(x, "centroid")] == [0.2, 0.9] == [round(m[2], 9) for m in tree.linkage(x, "median")]
    assert [round(m[2], 9) for m in tree.linkage(x, "ward")] == [0.2, round(0.9 * (4 / 3) ** 0.5, 9)]


def test_prepared_nodes(spark):
    rows = [(1, 2, None, 9), (2, 4, 1, 5), (3, 5, 2, 4)]
    got = {r["node_id"]: r for r in placement.prepared(spark.createDataFrame(rows, "node_id long, size int, parent long, frequency long")).collect()}
    assert got[3]["path"] == [3, 2, 1] and got[1]["path"] == [1] and [got[k]["is_leaf"] for k in (1, 2, 3)] == [False, False, True]
    assert got[2]["bytes"] == 4 * costs.BLOCK_BYTES


@pytest.mark.parametrize("method", tree.BOUNDED)
def test_linkage_without_the_matrix(method, monkeypatch):
    """The same merges, also when hardly a row is kept, in less memory than the matrix."""
    import random
    import tracemalloc

    from strandlake.operators import linkage

    rnd = random.Random(3)
    scaled = lambda x: 1 - tree.similarity(x, "sharp")
    for n, ids, most, kept in ((1, 5, 2, 1), (30, 8, 4, 1), (150, 40, 25, 5_000), (200, 9_000, 6, 40_000), (150, 20, 3, 1 << 20)):
        monkeypatch.setattr(linkage, "KEPT_BYTES", kept)
        sets = [frozenset(rnd.sample(range(ids), rnd.randrange(1, most + 1))) for _ in range(n)]
        for wide in (None, 3):
            assert list(linkage.merges(sets, scaled, method, wide)) == tree.linkage(scaled(tree.overlaps(sets)), method)
    monkeypatch.setattr(linkage, "KEPT_BYTES", 1 << 20)
    sets = [frozenset(rnd.sample(range(40), 25)) for _ in range(1_200)]
    tracemalloc.start()
    got = sum(1 for _ in zip(range(300), tree.linked_sets(sets, "sharp", method)))
    assert got == 300 and tracemalloc.get_traced_memory()[1] < 8 * len(sets) ** 2
    tracemalloc.stop()


def test_large_components_give_the_same_nodes(spark, monkeypatch):
    """Nodes of trees and dendrograms do not depend on how their merges were found."""
    import random

    rnd = random.Random(8)
    sets = [frozenset(rnd.sample(range(12), rnd.randrange(1, 6))) for _ in range(tree.MATRIX + 20)]
    nodes = {n["node_id"]: n for n in tree.dendrogram(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "idx long, doc_ids array<long>"), "square", "single").collect()}
    below, want = [[i] for i in range(len(sets))], []
    for left, right, dist, _ in tree.linkage(1 - tree.similarity(tree.overlaps(sets), "square"), "single"):
        below.append(sorted(below[left] + below[right]))
        content = frozenset.intersection(*(sets[i] for i in below[-1]))
        want.append((below[-1], sorted(content), sum(sets[i] == content for i in below[-1]), dist))
    assert sorted((n["original_indices"], n["content"], n["frequency"], n["distance"]) for n in nodes.values() if not n["is_query"]) == sorted(want)
    few = list(dict.fromkeys(sets))[:80]
    built = [tree.build(few, list(range(80)), [[i] for i in range(80)], "sharp", "average")]
    monkeypatch.setattr(tree, "MATRIX", 1)
    assert [tree.build(few, list(range(80)), [[i] for i in range(80)], "sharp", "average")] == built


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_nearest_rows_in_slices(metric, monkeypatch):
    """Distances are worked out slice by slice: the same neighbours, and memory that the vectors' number does not set."""
    import tracemalloc

    import pyarrow as pa

    table = lambda keys, v: pa.table({"key": pa.array(keys, pa.int64()), "v": pa.array(list(v), pa.list_(pa.float64()))})
    rng = np.random.default_rng(2)
    q, x = rng.integers(1, 4, (70, 4)).astype(float), rng.integers(1, 4, (5_000, 4)).astype(float)
    a, b = table(np.arange(70), q), table(rng.permutation(5_000), x)
    find = knn.nearest_rows(3, metric, 9)
    tracemalloc.start()
    monkeypatch.setattr(knn, "SLICE", 1 << 13)
    got = find(a, b)
    assert tracemalloc.get_traced_memory()[1] < 8 * knn.ROWS * len(x) / 2
    tracemalloc.stop()
    d, ids = np.round(knn.distances(q, x, metric), 9) + 0.0, b.column("key").to_numpy()
    want = [(i, int(ids[j]), d[i, j]) for i in range(70) for j in sorted(range(5_000), key=lambda j: (d[i, j], ids[j]))[:3]]
    assert list(zip(*(got.column(c).to_pylist() for c in ("qid", "id", "dist")), strict=True)) == want


def test_closest_does_not_pair_all_holders_of_an_id(spark, monkeypatch):
    """An id in every list is no reason to meet every node; long lists and nodes give what a plain search gives."""
    met, join = [], overlap.shared_ids

    def counted(*args, **more):
        out = join(*args, **more)
        met.append(out.count())
        return out

    monkeypatch.setattr(overlap, "shared_ids", counted)
    rows = [[0, 1000 + i, 2000 + i] for i in range(100)]
    frame = lambda rs: spark.createDataFrame(list(enumerate(rs)), "idx long, doc_ids array<long>")
    nodes = lambda rs: overlap.contents(frame(rs)).withColumnRenamed("idx", "node_id")
    got = overlap.closest(frame(rows), nodes(rows)).collect()
    assert sorted((r["idx"], r["node_id"], r["dist"]) for r in got) == [(i, i, 0.0) for i in range(100)] and sum(met) < 1_000
    monkeypatch.setattr(overlap, "shared_ids", join)
    lists = [[1, 2, 3], [7], list(range(12)), [1, 1], []]
    sets = [[2], [1, 2, 3, 4], list(range(10)), [3], [7, 50]]
    far = lambda a, b: round(max(0.0, 1 - float(tree.similarity(np.array(len(a & b) / max(len(a), len(b))), "sharp"))), 9) if a and b else 1.0
    want = [(i, *min((far(set(a), set(b)), j) for j, b in enumerate(sets))) for i, a in enumerate(lists)]
    assert sorted((r["idx"], r["dist"], r["node_id"]) for r in overlap.closest(frame(lists), nodes(sets)).collect()) == want


def test_pairs_are_counted_where_they_meet(spark):
    rows = spark.createDataFrame([(i, [i % 3, i % 4, 9]) for i in range(20)], "idx long, doc_ids array<long>")
    pairs = overlap.pair_overlap(rows)
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    sets = [{i % 3, i % 4, 9} for i in range(20)]
    assert sorted((r["i"], r["j"], r["same_items"]) for r in pairs.collect()) == [(i, j, len(sets[i] & sets[j])) for i in range(20) for j in range(i + 1, 20)]
