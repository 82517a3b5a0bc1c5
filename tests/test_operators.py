"""Values worked out by hand, and properties."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import costs, metrics, similarity
from strandlake.operators import chunking, knn, overlap, placement, rag, records, reorder, tree
from strandlake.sources import jsonl
from strandlake.streaming.assign import assign_stream


def lists(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "idx long, doc_ids array<long>")


def test_sharp_similarity(spark):
    base = list(range(10))
    for n, want in ((0, 0.0), (5, 0.101536), (8, 0.406420), (9, 0.634380), (10, 1.0)):
        other = base[:n] + list(range(100, 110 - n))
        d = spark.createDataFrame([(base, other)], "a array<long>, b array<long>")
        got = d.select(similarity.overlap_similarity(F.col("a"), F.col("b"))).first()[0]
        assert got == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError):
        similarity.scale(F.lit(0.5), "other")


def test_prefix_rewrite(spark):
    out = reorder.rewrite(lists(spark, [[1, 2, 3], [1, 2, 4], [5, 6]])).orderBy("new_pos").collect()
    assert [(r["idx"], r["new_ids"], r["strength"]) for r in out] == [(0, [1, 2, 3], 2), (1, [1, 2, 4], 2), (2, [5, 6], 0)]
    out = reorder.rewrite(lists(spark, [[3, 1], [3, 2, 1]])).orderBy("new_pos").collect()
    assert [(r["idx"], r["new_ids"]) for r in out] == [(1, [1, 3, 2]), (0, [1, 3])]


def test_tree_has_no_cycle(spark):
    nodes = tree.shared_tree(lists(spark, [[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 6], [1, 2, 3, 7]])).collect()
    inner = [n for n in nodes if not n["is_query"]]
    assert [(n["content"], n["frequency"]) for n in inner] == [([1, 2, 3], 4)]


@pytest.mark.parametrize("link", tree.LINKAGES)
def test_tree_properties(spark, link):
    rnd = random.Random(4)
    rows = [rnd.sample(range(12), rnd.randrange(1, 5)) for _ in range(30)]
    nodes = tree.shared_tree(lists(spark, rows), "direct", link)
    tree.ancestors(nodes.select("node_id", "parent"))
    sets = {i: set(r) for i, r in enumerate(rows)}
    for n in nodes.collect():
        assert set(n["content"]) == set.intersection(*(sets[i] for i in n["original_indices"]))
        assert n["frequency"] == len(n["original_indices"]) and n["content"]
    out = rag.optimize_lists(lists(spark, rows)).collect()
    assert sorted(r["new_pos"] for r in out) == list(range(30))
    assert all(sorted(r["new_ids"]) == sorted(rows[r["idx"]]) for r in out)


def test_answer_metrics(spark):
    rows = [("the Cat.", "cat", 1.0, 1.0), ("yes", "no", 0.0, 0.0), ("", "", 1.0, 0.0), ("a b b c", "b b d", 0.0, 2 / 3)]
    d = spark.createDataFrame(rows, "p string, g string, em double, f1 double")
    for r in d.select("em", "f1", metrics.exact_match(F.col("p"), F.col("g")).alias("x"), metrics.token_f1(F.col("p"), F.col("g"))["f1"].alias("y")).collect():
        assert (r["x"], r["y"]) == (r["em"], pytest.approx(r["f1"]))


def test_costs(spark):
    d = spark.range(1)
    cost = lambda size, tier: d.select(costs.tier_cost(F.lit(size), F.lit(tier), F.lit(10))).first()[0]
    assert cost(0, "not_stored") == pytest.approx(2.4) and cost(8, "gpu") == pytest.approx(0.48001)
    assert placement.node_cost(8, "disk", 10) == pytest.approx(cost(8, "disk"))
    assert d.select(costs.lambda_memory(F.lit(20000))).first()[0] is None
    assert d.select(costs.knn_cost(F.lit(1e6), F.lit(8192), F.lit(1024.0), F.lit(10240.0))).first()[0] == pytest.approx(0.0768)


def test_reorder(spark):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(3)], "position long, v string")
    order = lambda idx: [r["v"] for r in reorder.reorder_rows(rows, spark.createDataFrame(list(enumerate(idx)), "ord long, idx long")).orderBy("new_position").collect()]
    assert order([2, 0, 1]) == ["r2", "r0", "r1"] and order([2, 2, 0]) == ["r2", "r0"]
    assert order([0, 5]) == order([]) == ["r0", "r1", "r2"]


def brute_placement(nodes, leaves, k, room):
    return min(
        placement._total(dict(zip(nodes, t, strict=True)), nodes, leaves, k, 1200)[0]
        for t in itertools.product(placement.TIERS, repeat=len(nodes))
        if all(sum(nodes[i] for i, x in zip(nodes, t, strict=True) if x == tier) <= int(g * 1024**3 // costs.BLOCK_BYTES) for tier, g in room.items())
    )


def test_solver_is_optimal():
    nodes, leaves = {1: 3, 2: 4, 3: 2}, [(1, 2, [1, 3]), (2, 5, [2, 3])]
    room = {"gpu": 2.0, "dram": 1.3, "disk": 1.0}
    a, route, cost, status, bound = placement.solve(nodes, leaves, 5, room)
    assert status == "optimal" and cost == bound == pytest.approx(brute_placement(nodes, leaves, 5, room)) and set(route) == {1, 2}


def random_trees(n=25):
    rnd = random.Random(4)
    for _ in range(n):
        inner, outer = rnd.randrange(1, 3), rnd.randrange(3, 5)
        nodes = {i: rnd.randrange(1, 4) for i in range(inner)} | {i: rnd.randrange(3, 11) for i in range(inner, inner + outer)}
        leaves = [(i, rnd.randrange(1, 30), [i, rnd.randrange(inner)]) for i in range(inner, inner + outer)]
        yield nodes, leaves, {t: rnd.randrange(1, 12) * costs.BLOCK_BYTES / 1024**3 + 1e-6 for t in placement.TIERS[:3]}


def test_solver_against_all_plans():
    """Enough steps give the optimum; none give a plan near it, and say so with a bound that holds."""
    gaps = []
    for nodes, leaves, room in random_trees():
        best = brute_placement(nodes, leaves, 10, room)
        _, _, cost, status, _ = placement.solve(nodes, leaves, 10, room)
        assert status == "optimal" and cost == pytest.approx(best)
        a, _, cost, status, bound = placement.solve(nodes, leaves, 10, room, steps=0)
        none = sum(freq for _, freq, _ in leaves) * placement.node_cost(0, "not_stored", 10)
        assert status == "feasible" and bound - 1e-9 <= best <= cost + 1e-9
        assert all(sum(nodes[i] for i in nodes if a[i] == t) <= int(room[t] * 1024**3 // costs.BLOCK_BYTES) for t in room)
        gaps.append((cost - best) / (none - best))
    assert sum(gaps) / len(gaps) < 0.02 and max(gaps) < 0.15


def test_placement_of_a_node_table(spark):
    rows = [(1, 2, None, 9), (2, 4, 1, 5), (3, 5, 1, 4), (4, 3, None, 2)]
    nodes = spark.createDataFrame(rows, "node_id long, size int, parent long, frequency long")
    ways = placement.candidates(nodes, 10).collect()
    assert {(r["leaf"], r["server"], r["level"]) for r in ways} == {(2, 2, 0), (2, 1, 1), (3, 3, 0), (3, 1, 1), (4, 4, 0)} and len(ways) == 20
    room = {"gpu": 4.5 * costs.BLOCK_BYTES / 1024**3, "dram": 3.5 * costs.BLOCK_BYTES / 1024**3, "disk": 0.0}
    assigned, routes, report = placement.plan(nodes, 10, room)
    best = brute_placement({r[0]: r[1] for r in rows}, [(2, 5, [2, 1]), (3, 4, [3, 1]), (4, 2, [4])], 10, room)
    assert report["status"] == "optimal" and report["cost"] == pytest.approx(best)
    assert sum(r["frequency"] * r["cost"] for r in routes.collect()) == pytest.approx(best)
    assert {r["node_id"] for r in assigned.where("is_leaf").collect()} == {2, 3, 4}


def test_large_node_does_not_displace_many_small_ones():
    nodes = {0: 40} | {i: 4 for i in range(1, 11)}
    leaves = [(i, 11 if i == 0 else 10, [i]) for i in nodes]
    a, _, _, status, _ = placement.solve(nodes, leaves, 10, {"gpu": 40 * costs.BLOCK_BYTES / 1024**3 + 1e-6, "dram": 0, "disk": 0})
    assert status == "optimal" and [i for i in nodes if a[i] == "gpu"] == list(range(1, 11))


def test_closest_answers_every_list(spark):
    new = lists(spark, [[1, 2], [9], []])
    nodes = spark.createDataFrame([(5, [1, 2]), (7, [1, 2, 3]), (4, [3])], "node_id long, content array<long>")
    assert sorted(map(tuple, overlap.closest(new, nodes).collect())) == [(0, 5, 0.0), (1, 4, 1.0), (2, 4, 1.0)]
    assert overlap.closest(new, nodes.limit(0)).count() == 0


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"chunk_id": 1, "text": "a"}\n\nnot json\n{"chunk_id": 1, "text": "b"}\n')
    d = jsonl.read_jsonl(spark, str(p), "chunk_id long, text string")
    assert [tuple(r) for r in d.collect()] == [(1, "a"), (1, "b")]
    assert [tuple(r) for r in jsonl.keyed_corpus(d).collect()] == [(1, "b")]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0
    assert jsonl.write_jsonl(d, str(tmp_path / "out")) and jsonl.read_jsonl(spark, str(tmp_path / "out"), "chunk_id long, text string").count() == 2


def test_chunkers():
    t = " ".join(f"Word{i} goes here." for i in range(400))
    for c in chunking.recursive_chunks(t, 300, 60), chunking.token_chunks(t, 30, 6):
        assert len(c) > 5 and all(x in t for x in c)
    assert max(map(len, chunking.recursive_chunks("x" * 1000, 300, 60))) <= 300


def test_combine_takes_the_last(spark):
    left = spark.createDataFrame([("q", "old", 0), ("q", "new", 1)], "qid string, v string, o int")
    right = spark.createDataFrame([("q", 5)], "question_id string, k int")
    assert [tuple(r) for r in records.combine(left, right, order="o").select("qid", "v", "k").collect()] == [("q", "new", 5)]


def test_stages(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"text number {i} about topic{i % 3}") for i in range(12)], "chunk_id long, text string")
    q = spark.createDataFrame([(0, "about topic1"), (1, "number 7")], "idx long, question string")
    assert rag.rag(q, corpus, 2, rag.StubEmbedding, rag.StubChat).where("error is null").count() == 2
    assert rag.rat(q, corpus, 2, rag.StubEmbedding, rag.StubChat, 2).count() == 2
    assert rag.decompose(q, rag.StubChat).count() == 2
    s = rag.synthetic_queries(spark, 20, 50, 5).collect()
    assert all(len(set(r["doc_ids"])) == 5 for r in s)
    data = lists(spark, [[1, 2], [2, 3]])
    data.write.parquet(str(tmp_path / "in"))
    nodes = overlap.contents(data).withColumnRenamed("idx", "node_id")
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    assign_stream(stream, nodes, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        knn.knn(q, q, 1, "other")
