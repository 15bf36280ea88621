"""Sessions, cache, adaptation, evaluation, several documents and extraction with a model."""

from __future__ import annotations

import json
import logging
import random

import pytest
from pyspark.sql import functions as F

from foliomill.engine import Engine
from foliomill.operators import adaptive, evaluation, extract, multi, search, sessions, structured
from foliomill.operators.llm_hooks import FakeClient


def test_turns_are_numbered_on(spark):
    held = spark.createDataFrame([("a", 1), ("a", 2)], "session_id string, turn_id long")
    new = spark.createDataFrame([("a", 9, "x"), ("a", 8, None), ("b", 1, "y")], "session_id string, asked_at int, original_query string")
    found = {(r.session_id, r.asked_at): r.turn_id for r in sessions.numbered(held, new).collect()}
    assert found == {("a", 8): 3, ("a", 9): 4, ("b", 1): 1}
    assert {r.session_id: r.turn_id for r in sessions.recent(held, 1).collect()} == {"a": 2}


def test_cache_is_of_one_version(spark):
    schema = "cache_key string, doc_id long, doc_version int, value string"
    cache = sessions.put(spark.createDataFrame([("k", 1, 1, "old"), ("l", 2, 1, "v")], schema), spark.createDataFrame([("k", 1, 2, "new")], schema))
    asked = spark.createDataFrame([("k", 1, 1), ("k", 1, 2), ("l", 2, 1)], "cache_key string, doc_id long, doc_version int")
    assert sorted(r.value for r in sessions.cached(cache, asked).collect()) == ["new", "v"]
    gone = sessions.invalidated(cache, spark.createDataFrame([(2,)], "doc_id long"))
    assert [r.value for r in sessions.cached(gone, asked).collect()] == ["new"]


def test_adaptive_update(spark):
    nodes = spark.createDataFrame([(1, "n1", "One", 1, 2, "old"), (1, "n2", "Two", 3, 3, "old"), (2, "n1", "Three", 1, 1, "old")], "doc_id long, node_id string, title string, start_page int, end_page int, summary string")
    events = spark.createDataFrame([(1, "n1", True, False)] * 3 + [(1, "n2", True, True)], "doc_id long, node_id string, visited boolean, used boolean")
    rows = spark.createDataFrame([(1, 1, "s1", " first \n text"), (1, 2, "s2", "second"), (1, 3, "s3", "third")], "doc_id long, page_number int, section_id string, content string")
    queue = adaptive.enqueued(nodes, F.lit(0.0)).limit(0)
    renewed, misled, after = adaptive.update(nodes, events, queue, rows, F.lit(1.0))
    assert [(r.doc_id, r.node_id) for r in misled.collect()] == [(1, "n1")]
    assert {(r.doc_id, r.node_id): (r.summary, r.visits) for r in renewed.collect()} == {(1, "n1"): ("One: first text second", 3), (1, "n2"): ("old", 1), (2, "n1"): ("old", 0)}
    row = after.first()
    assert (row.status, row.new_summary, row.prompt) == ("done", "One: first text second", "Rewrite summary for node n1 to strictly describe pages 1-2.")
    assert adaptive.pending(after).count() == 0
    empty = adaptive.regenerated(nodes.where("doc_id = 2"), nodes, rows).first()
    assert empty.new_summary == "Three: No textual content available"


def test_cases_gates_and_files(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"query": "a", "intent": "graph"}, {"query": "b", "expected_keywords": ["x"]}]))
    asked = evaluation.cases(spark, str(path))
    assert [tuple(r) for r in asked.orderBy("case_no").collect()] == [(0, "a", [], "graph"), (1, "b", ["x"], "single_doc")]
    schema = "case_no int, intent_type string, n_sources int, latency_ms int, tier1_calls int, tier2_calls int, cache_hit boolean"
    told = spark.createDataFrame([(0, "graph", 2, 10, 1, 1, False), (1, "graph", 0, 21, 1, 0, True)], schema)
    board = evaluation.dashboard(evaluation.paired(asked, told))
    row = evaluation.write_json(board, tmp_path / "kpi.json")
    assert json.loads((tmp_path / "kpi.json").read_text()) == row
    assert (row["total_eval_cases"], row["intent_accuracy"], row["citation_coverage"], row["avg_latency_ms"], row["p95_latency_ms"], row["avg_cost_usd"]) == (2, 0.5, 0.5, 15.5, 10.0, 0.0004)
    assert {r.gate: r.passed for r in evaluation.gates(board, {"intent_accuracy": 0.6}).collect()} == {"intent_accuracy": False, "citation_coverage": True, "p95_latency_ms": True, "avg_cost_usd": True}
    with pytest.raises(Exception, match="lacks its result"):
        evaluation.paired(asked, told.where("case_no = 0")).collect()


def test_log_spans(caplog):
    with caplog.at_level(logging.INFO, "foliomill"), evaluation.Log().span("index", doc=1):
        pass
    first, last = (json.loads(r.getMessage()) for r in caplog.records)
    assert (first["event"], last["event"], first["trace_id"]) == ("index_start", "index_end", last["trace_id"]) and last["duration_ms"] >= 0


def test_selection_and_merge(spark):
    asked = spark.createDataFrame([(1, 5), (2, 1)], "query_id int, seed_doc_id long")
    picked = multi.selected(asked, spark.createDataFrame([(x,) for x in (1, 2, 3, 5)], "doc_id long"))
    assert sorted(tuple(r) for r in picked.collect()) == [(1, 1, 1), (1, 2, 2), (1, 5, 0), (2, 1, 0), (2, 2, 1), (2, 3, 2)]
    best = multi.best(spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (1, 9, 0.9)], "query_id int, doc_id long, score double"))
    assert sorted((r.place, r.doc_id) for r in best.collect()) == [(1, 9), (2, 3)]
    answers = spark.createDataFrame([(1, 9, 1, "x\n- last", 0.4), (1, 3, 2, "one", 0.2)], "query_id int, doc_id long, place int, answer string, confidence double")
    sources = spark.createDataFrame([(1, d, p, f"n{i}", i) for d, p in ((9, 1), (3, 2)) for i in range(1, 5)], "query_id int, doc_id long, place int, node_id string, rank int")
    row = multi.merged(spark.createDataFrame([(1, "q")], "query_id int, text string"), answers, sources).first()
    assert row.answer == "Query: q\n\nCross-document summary:\n- [9] - last\n- [3] one" and row.confidence == 0.3
    assert [tuple(x) for x in row.source_nodes] == [(9, "n1"), (9, "n2"), (9, "n3"), (9, "n4"), (3, "n1"), (3, "n2")]


def test_many_short_examples(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abÄ𝄞.") for _ in range(rng.randint(1, 15)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(40)] + ["", None]
    needles = [word()[: rng.randint(1, 15)] for _ in range(25)] + [t[3:18] for t in texts[:10] if len(t) > 20]
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, section_id string, content string")
    wanted = spark.createDataFrame(list(enumerate(needles)), "item_id int, text string")
    tried = sorted(map(tuple, extract.literal(rows, wanted).collect()))
    monkeypatch.setattr(extract, "MOST_SHORT", 3)
    assert sorted(map(tuple, extract.literal(rows, wanted).collect())) == tried and tried


EXAMPLES = [("Ann pays 5 dollars", [{"extraction_class": "person", "extraction_text": "Ann"}])]


def _sections(spark):
    rows = [(1, "s1", 1, "Bob met Carol."), (1, "s2", 2, "Carol left. Ann stayed."), (2, "s1", 1, "Nobody here"), (2, "s2", 2, None)]
    return spark.createDataFrame(rows, "doc_id long, section_id string, page_number int, content string")


def test_extraction_with_a_model(spark):
    reply = json.dumps({"extractions": [{"extraction_class": "person", "extraction_text": "Bob", "attributes": {"n": 1}}, {"extraction_class": "person", "extraction_text": "Carol left"}, {"extraction_class": "person", "extraction_text": "Zzyzx Qwv"}, {"extraction_class": ""}, 3]})
    found = structured.structured(_sections(spark), lambda: FakeClient({"Input:\nBob": reply}, "no json"), "people", EXAMPLES, passes=2)
    got = sorted(((r.doc_id, r.section_id, r.page_number, r.extraction_text, r.char_start, r.char_end, r.alignment, r.pass_index) for r in found.collect()), key=str)
    assert got == [(1, "s1", 1, "Bob", 0, 3, "exact", 0), (1, "s2", 2, "Carol left", 0, 10, "exact", 0), (1, None, None, "Zzyzx Qwv", None, None, "unaligned", 0)]
    assert [tuple(r) for r in structured.counts(found).collect()] == [(1, 2, 0, 1)]


def test_extraction_without_a_model(spark):
    found = structured.structured(_sections(spark), None, "people", EXAMPLES, passes=3).collect()
    assert [(r.doc_id, r.section_id, r.char_start, r.char_end, r.extraction_class) for r in found] == [(1, "s2", 12, 15, "person")]


def test_prompts_pieces_and_replies(spark):
    text = spark.range(1).select(structured.prompt("find", EXAMPLES, F.lit("T")).alias("p")).first().p
    assert text == 'Task: find\n\nInput:\nAnn pays 5 dollars\nOutput:\n{"extractions": [{"extraction_class": "person", "extraction_text": "Ann", "attributes": {}}]}\n\nInput:\nT\nOutput:'
    assert structured.items('[{"extraction_class": "a", "extraction_text": " b "}]') == [("a", "b", {})] and structured.items("none") == [] == structured.items('"x"')
    pieces = [{"chunk_offset": 0, "length": 3, "section_offset": 5, "section_id": "s", "page_number": 1}, {"chunk_offset": 5, "length": 2, "section_offset": 0, "section_id": "t", "page_number": 2}]
    assert [structured.locate(pieces, at) and structured.locate(pieces, at)["section_id"] for at in (0, 2, 3, 4, 5, 7)] == ["s", "s", None, None, "t", None]
    assert structured.ground(pieces, "abc\n\nde", "bc\n\nd") == ("s", 1, 6, 8, "exact")


def test_deep_trees_are_searched_to_the_end(spark):
    depth = 15
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None, i, "word" if i else "", "word") for i in range(depth)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id string, parent_id string, preorder int, title string, text string")
    asked = spark.createDataFrame([(1, "word")], "query_id int, text string")
    found = search.tier2(asked, nodes, nodes.where("preorder = 0").withColumn("query_id", F.lit(1)), keep=99)
    assert found.count() == depth


def test_engine_sessions_feedback_and_runs(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    texts = {1: "Tesla revenue grew in 2020", 2: "Rivian revenue fell in 2020", 3: "Bread needs flour"}
    rows = spark.createDataFrame([(d, "sec_0001", 1, t) for d, t in texts.items()], "doc_id long, section_id string, page_number int, content string")
    engine.index(rows)
    turn = "query_id int, session_id string, asked_at int, text string"
    told = {r.query_id: r for r in engine.ask(spark.createDataFrame([(1, "a", 1, "Compare revenue of Tesla and Rivian in 2020")], turn)).collect()}
    assert told[1].intent_type == "multi_doc" and "Cross-document summary:" in told[1].answer and "- [1] " in told[1].answer and "- [2] " in told[1].answer and told[1].n_sources >= 2
    engine.ask(spark.createDataFrame([(2, "a", 2, "what about flour")], turn))
    held = {r.turn_id: r.rewritten_query for r in engine.store.read("sessions").collect()}
    assert held[2] == "what about flour Context from previous turn: Compare revenue of Tesla and Rivian in 2020"
    assert sorted(r.query_id for r in engine.store.read("results").collect()) == [1, 2]
    node = engine.store.read("nodes").where("doc_id = 3 and depth > 0").first() or engine.store.read("nodes").where("doc_id = 3").first()
    engine.feedback(spark.createDataFrame([(3, node.node_id, True, False)], "doc_id long, node_id string, visited boolean, used boolean"))
    assert [(r.doc_id, r.node_id) for r in engine.adapt(1.0).collect()] == [(3, node.node_id)]
    now = engine.store.read("nodes").where((F.col("doc_id") == 3) & (F.col("node_id") == node.node_id)).first()
    assert now.summary == f"{node.title}: Bread needs flour" and engine.store.read("queue").first().status == "done"
    assert engine.extract_with("r1", None, "x", [("", [{"extraction_class": "food", "extraction_text": "flour"}])]).count() == 1
    assert engine.extract_with("r1", None, "x", [("", [{"extraction_class": "food", "extraction_text": "bread"}])]).count() == 1
