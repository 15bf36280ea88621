"""Operators, parsers, store, engine and streams of the base library."""

from __future__ import annotations

import io
import json
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from foliomill.engine import Engine
from foliomill.functions import text as T
from foliomill.operators import extract, graph, llm_hooks, sections, state, tree
from foliomill.operators.store import Store, review_page
from foliomill.sources import parsers
from foliomill.streaming import feedback


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_text_functions(spark):
    assert one(spark, T.tokens, "A b2-Ça") == ["a", "b2", "a"]
    assert one(spark, T.strip, "\x1c\xa0 x y \n") == "x y"
    assert one(spark, T.cross_references, "see Table  3. and section A-1, table 3") == ["Table 3", "section A-1", "table 3"]
    assert one(spark, T.query_entities, "What is Tesla Motors in Section 2.1.") == ["Section 2.1", "Tesla Motors"]
    assert [one(spark, T.intent, q) for q in ("Compare a", "what cites it", "plain")] == ["multi_doc", "graph", "single_doc"]
    assert one(spark, T.latest_year, "1999 and 2004, 20041") == 2004
    vector = one(spark, T.embedding, "some words here")
    assert len(vector) == 32 and sum(v * v for v in vector) == pytest.approx(1)
    assert one(spark, T.embedding, "!!") == [0.0] * 32


def test_align():
    assert extract.align("brown fox now", "quick brown fox now") == (6, 19, "exact")
    assert extract.align("BROWN FOX", "quick brown fox") == (6, 15, "exact")
    assert extract.align("two  words", "has two\nwords")[2] == "fuzzy"
    assert extract.align("nothing alike", "zzzz qqqq") is None and extract.align(" ", "x") is None


def test_chunks_make_up_the_text():
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice("ab .!?") for _ in range(rng.randint(1, 400)))
        cut = extract.pieces(text, 50)
        assert "".join(p for _, p in cut) == text and all(len(p) <= 50 and text[o : o + len(p)] == p for o, p in cut)
    packed = extract.packed([("s1", 1, "x" * 30), ("s2", 2, "y" * 30), ("s3", 3, "z" * 10)], 50)
    assert [(c, s, o) for c, s, _, o, _, _ in packed] == [(1, "s1", 0), (2, "s2", 0), (2, "s3", 32)]


def test_greedy_spans():
    assert extract.kept([(0, 10), (4, 14), (8, 18), (0, 10)]) == [True, False, True, False]


def test_tree(spark):
    rows = [(p, f"sec_{p:04d}", 100, {f"t{p}"}, "") for p in range(1, 12)]
    nodes = tree.grow(rows, "Title")
    assert [n[2] for n in nodes] == list(range(len(nodes))) and nodes[0][5:7] == (1, 11)
    parents = {n[1] for n in nodes}
    leaves = [n for n in nodes if n[0] not in parents]
    assert sorted((n[7], n[8]) for n in leaves) == [(i, i) for i in range(11)]
    headed = [(p, f"sec_{p:04d}", 10, {f"t{p}"}, f"H{(p - 1) // 2}") for p in range(1, 5)]
    assert [n[4] for n in tree.grow(headed, "T") if n[3] == 1] == ["H0", "H1"]
    table = spark.createDataFrame([(1, "sec_0001", 1, "a b"), (1, "sec_0002", 2, "c d"), (2, "sec_0001", 1, "x")], "doc_id long, section_id string, page_number int, content string")
    quality = {r.doc_id: (r.coverage, r.coherence) for r in tree.quality(tree.build(table), table).collect()}
    assert quality[1] == (1.0, 1.0)


def test_semantic_groups_match_model(spark):
    rng = random.Random(2)
    rows = [(d, f"sec_{p:04d}", p, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 90))), rng.choice(["H", "I"])) for d in range(5) for p in range(1, 15)]
    table = spark.createDataFrame(rows, "doc_id long, section_id string, page_number int, content string, heading string")
    got = {(r.doc_id, r.section_id): r.group for r in sections.windowed_groups(table).collect()}
    for d in range(5):
        mine, group, size, words = [r for r in rows if r[0] == d], 0, 0, 0
        for i, r in enumerate(mine):
            n = len(r[3].split())
            if i:
                a, b = set(mine[i - 1][3].split()), set(r[3].split())
                if (len(a & b) / len(a | b) < 0.18 and size >= 2 and mine[i - 1][4] != r[4]) or words >= 280:
                    group, size, words = group + 1, 0, 0
            size, words = size + 1, words + n
            assert got[d, r[1]] == group


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "ELABORATES", 0.9, 1), ("b", "c", "REFERENCES", 0.8, 2), ("c", "d", "ELABORATES", 0.9, 1), ("a", "b", "ELABORATES", 0.1, 3)], "src string, dst string, edge_type string, weight double, ord int")
    seeds = spark.createDataFrame([(1, "a"), (1, "zz")], "query_id int, node string")
    assert {(r.node, r.hops) for r in graph.bfs(seeds, edges, 2).collect()} == {("a", 0), ("zz", 0), ("b", 1), ("c", 2)}
    assert {r.node for r in graph.bfs(seeds, edges, 3, ["ELABORATES"]).collect()} == {"a", "zz", "b"}
    assert graph.dedupe(edges).where("src = 'a'").first().weight == 0.9
    vectors = spark.createDataFrame([(1, "n1", [1.0, 0.0]), (2, "n2", [0.6, 0.8]), (3, "n3", [0.0, 1.0])], "doc_id long, node_id string, vector array<double>")
    assert {(r.src, r.dst, r.weight) for r in graph.similar_sparse(vectors).collect()} == {("n1", "n2", 0.6), ("n2", "n3", 0.8)}
    dense = spark.createDataFrame([(i, [0.6, 0.8] if i % 2 else [1.0, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert graph.similar_dense(dense, 0.9, block=2).count() == 4 * 3 // 2 + 5 * 4 // 2


def test_state(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, hash string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, hash string")
    assert {tuple(r) for r in state.diff(old, new, ["k"]).collect()} == {(1, "removed"), (3, "changed"), (4, "added")}
    assert {tuple(r) for r in state.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "x"), (4, "d")}


def docx_file() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    body = p("Top", "Heading1") + p("First", "Normal") + f"<w:tbl><w:tr>{cell.format('a')}{cell.format('b')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_parsers(spark, tmp_path):
    assert [s[1] for s in parsers.text(b"one\n\n \n\ntwo")] == ["one", "two"]
    assert [(s[2], s[1]) for s in parsers.markdown(b"intro\n# A\nx\n\nB\n--\ny\n```\n# no\n```")] == [("Introduction", "intro"), ("A", "x"), ("B", "y\n```\n# no\n```")]
    page = "<h1>T</h1><script>var a='</p>';</script><p>one<br>two <a href='u'>l</a><ul><li><p>in</p></li></ul>"
    assert [(json.loads(s[4])["tag"], s[1]) for s in parsers.html(page, parsers.HIDDEN)][:2] == [("h1", "T"), ("p", "one two l in")]
    assert [s[1] for s in parsers.html("<li><p>in</p></li>")] == ["in", "in"]
    assert [(s[1], s[2]) for s in parsers.docx(docx_file())] == [("First", "Top"), ("a | b", "Top")]
    assert [s[2] for s in parsers.python_code(b"class A:\n    def f(self): pass\ndef g(): pass\n")] == ["A", "g", "f"]
    assert [s[2] for s in parsers.script_code(b"function go() {}\nclass X {}\n")] == ["go", "X"]
    assert [s[1] for s in parsers.csv_table(b"q,n\na,1\nb,\n")] == ["Columns: q, n", "q=a; n=1", "q=b; n=", "q: non_empty=2, unique=2; n: non_empty=1, unique=1"]
    db = sqlite3.connect(":memory:")
    db.execute('CREATE TABLE "m t" (q TEXT, n INTEGER)')
    db.execute("""INSERT INTO "m t" VALUES ('a', NULL)""")
    assert [s[1] for s in parsers.sqlite_tables(db.serialize())] == ["Table m t: q TEXT, n INTEGER", "q=a; n="]
    (tmp_path / "a.md").write_text("# H\nbody")
    (tmp_path / "talk.mp3").write_bytes(b"\0")
    (tmp_path / "talk.mp3.txt").write_text("line one\n\nline two\n")
    rows = parsers.read_files(spark, str(tmp_path)).collect()
    assert sorted((r.source_format, r.content) for r in rows) == [("markdown", "body"), ("transcript", "line one"), ("transcript", "line two")]
    with pytest.raises(Exception, match="no parser"):
        parsers.parse_files(spark.createDataFrame([("d", "x.zzz", bytearray(b"1"))], "doc_id string, path string, content binary")).collect()


def test_store_and_engine(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, v string")
    assert store.save("t", rows) == 1 and store.upsert("t", spark.createDataFrame([(2, "c")], rows.schema), ["doc_id"]) == 2
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "a"), (2, "c")} and store.read("t", 1).count() == 2
    engine = Engine(spark, f"file://{tmp_path}/e")
    made = [(d, f"sec_{p:04d}", p, f"Solar panels of Tesla Motors in part {p} of document {d}. " * 3) for d in (1, 2) for p in (1, 2, 3)]
    table = spark.createDataFrame(made, "doc_id long, section_id string, page_number int, content string")
    assert {r.status for r in engine.index(table).collect()} == {"indexed"}
    edited = table.withColumn("content", F.when(F.col("doc_id") == 2, F.upper("content")).otherwise(F.col("content")))
    assert {tuple(r) for r in engine.index(edited).collect()} == {(1, "unchanged"), (2, "indexed")}
    asked = spark.createDataFrame([(1, "solar panels"), (2, "what cites Tesla Motors"), (3, "zebra")], "query_id int, text string")
    got = {r.query_id: r for r in engine.query(asked).collect()}
    assert got[1].n_sources > 0 and "Solar panels" in got[1].answer and got[2].intent_type == "graph" and got[2].confidence == 0.75
    assert got[3].confidence == 0 and got[3].n_sources > 0  # nothing shared: the first nodes of each document, with score 0
    assert engine.extract(spark.createDataFrame([(1, "solar PANELS of tesla")], "item_id int, text string")).count() == 18
    engine.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert engine.health() == {"ok": True, "documents": 1}


def test_review_page():
    page = review_page("T <", [("s", "a & b c")], [{"extraction_class": "k", "section_id": "s", "char_start": 4, "char_end": 5, "extraction_text": "b"}, {"extraction_class": "k", "section_id": "s", "char_start": None, "extraction_text": "<lost>"}])
    assert "a &amp; <mark" in page and ">b</mark> c" in page and "&lt;lost&gt;" in page and "T &lt;" in page


def test_hooks(spark):
    assert llm_hooks.extract_json('text ```json\n{"a": [1]}\n``` more') == {"a": [1]}
    assert llm_hooks.validated('{"a": 1}', {"a": int}) == {"a": 1}
    for bad in ('{"a": 1, "b": 2}', '{"a": true}', "[1]", "none"):
        with pytest.raises(ValueError):
            llm_hooks.validated(bad, {"a": int})
    calls = []
    with pytest.raises(KeyError):
        llm_hooks.with_retry(lambda: calls.append(1) or {}["x"], 3, 0)
    assert len(calls) == 3
    rows = spark.createDataFrame([(1, "say hello"), (2, "x")], "id int, prompt string")
    assert [r.reply for r in llm_hooks.completed(rows, lambda: llm_hooks.FakeClient({"hello": "hi"}, "none"), "").orderBy("id").collect()] == ["hi", "none"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("doc_id"), F.lit("n").alias("node_id"), F.lit(True).alias("visited"), (F.col("id") % 2 == 0).alias("used"))
    rows.unionByName(rows.limit(5)).write.parquet(f"{tmp_path}/in")
    stream = feedback.windowed(feedback.once(feedback.read(spark, f"{tmp_path}/in")))
    stream.writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").count() >= 0
    counts = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    fired = []
    feedback.triggered(feedback.once(feedback.read(spark, f"{tmp_path}/in")), f"{tmp_path}/d", f"{tmp_path}/n", lambda docs: fired.extend(r.doc_id for r in docs.collect())).awaitTermination()
    assert set(fired) == set(counts)
