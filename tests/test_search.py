"""Follow-ups, the fallback of tier 1 and seed pruning on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.engine import Engine
from foliomill.functions import text as T
from foliomill.operators import graph, search


def test_followups_name_the_rewritten_query(spark):
    texts = ["Tell me of Tesla revenue", " what about 2020 ", "and 2021", "Who", None, "it is"]
    turns = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)] + [(2, 0, "user", "and this"), (2, 1, "assistant", "x"), (2, 2, "user", "That one")], "conv_id int, turn int, role string, text string")
    found = {(r.conv_id, r.turn): r.rewritten_query for r in search.analyse(turns).collect()}
    second = "what about 2020 Context from previous turn: Tell me of Tesla revenue"
    assert [found[1, i] for i in range(5)] == [texts[0], second, f"and 2021 Context from previous turn: {second}", "Who", ""]
    assert found[2, 0] == "and this" and found[2, 2] == "That one Context from previous turn: and this"
    assert search.analyse(turns.limit(0)).count() == 0


def test_fallback_takes_nodes_without_a_shared_token(spark):
    nodes = spark.createDataFrame([(d, f"{d}:{i}", i, t) for d, held in ((1, "x x a x x"), (2, "x x x x"), (3, "a"), (4, "x x x ab")) for i, t in enumerate(held.split())], "doc_id int, node_id string, preorder int, text string")
    queries = spark.createDataFrame([(1, "a b c d"), (2, "zz")], "query_id int, text string")
    scores = search.with_zeros(search.tier1_scores(queries, nodes), queries, nodes)
    found = {(r.query_id, r.node_id) for r in search.tier1_selected(scores, 0.5).collect()}
    everything = [(r.doc_id, r.preorder, r.node_id, set(r.text.split())) for r in nodes.collect()]
    want = set()
    for q, words in ((1, set("abcd")), (2, {"zz"})):
        for doc in (1, 2, 3, 4):
            ranked = sorted((-len(words & held) / len(words), at, node) for d, at, node, held in everything if d == doc)
            want |= {(q, node) for s, _, node in ranked if -s >= 0.5} or {(q, node) for _, _, node in ranked[:3]}
    assert found == want


def test_seed_prune(spark):
    children = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("b", "b1"), ("c", "c1")], "node_id string, descendant string")
    seeds = spark.createDataFrame([("a2",), ("c",)], "node_id string")
    kept = lambda s: {r.node_id for r in search.seed_prune(children, s).collect()}
    assert kept(seeds) == {"a", "c"} and kept(seeds.limit(0)) == {"a", "b", "c"}


def test_references_end_at_a_word(spark):
    row = spark.createDataFrame([("See Table A- and table  2.1, Section 3.",)], "text string").select(T.cross_references(F.col("text")).alias("x")).first()
    assert row.x == ["Section 3", "Table A", "table 2.1"]


def test_walk_by_the_types_of_each_query(spark):
    edges = spark.createDataFrame([("a", "b", "REFERENCES"), ("b", "c", "ELABORATES"), ("a", "d", "ELABORATES"), ("b", "e", "REFERENCES")], "src string, dst string, edge_type string")
    seeds = spark.createDataFrame([(1, "a", ["REFERENCES"]), (2, "a", ["REFERENCES", "ELABORATES"]), (3, "a", [])], "query_id int, node string, edge_types array<string>")
    found = {(r.query_id, r.node, r.hops) for r in graph.bfs(seeds, edges).collect()}
    assert found == {(1, "a", 0), (1, "b", 1), (1, "e", 2), (2, "a", 0), (2, "b", 1), (2, "d", 1), (2, "c", 2), (2, "e", 2), (3, "a", 0)}


def test_index_holds_references_within_documents(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    texts = ["See Table 5 for Revenue.", "Plain words here.", "Table 5 lists Revenue by year."]
    rows = [(doc, f"sec_{i:04d}", i, t) for doc in (1, 2) for i, t in enumerate(texts if doc == 1 else [texts[2]], 1)]
    engine.index(spark.createDataFrame(rows, "doc_id long, section_id string, page_number int, content string"))
    nodes = engine.store.read("entities").where("entity = 'Table 5'")
    held = {(r.doc_id, f"{r.doc_id}:{r.node_id}") for r in nodes.collect()}
    edges = {(r.src, r.dst) for r in engine.store.read("edges").where("edge_type = 'REFERENCES'").collect()}
    assert edges == {(a, b) for x, a in held for y, b in held if x == y and a != b}
