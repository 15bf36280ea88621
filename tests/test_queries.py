"""Every registered query with oracle SQL against DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import math
import os
import re

import pytest

from foliomill.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{DATA}/{name}.parquet'")
    return con


def plain(frame):
    show = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert plain(found) == plain(want)
    else:
        assert len(found)


def test_embedding_keeps_the_sign_of_cancelled_components(spark, tmp_path):
    """Tokens whose values cancel leave a rest of about 1e-16, which the SQL rounds to 0.0 or, below 0, to -0.0."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["t1 t68 t205 t440 alpha beta", "t98 t185 t334 t498 alpha beta", "t1 t68 t205 t440", "alpha beta", ""]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = plain(con.execute(registry.ORACLES["query_embedding"]).df())
    assert {x for row in want for x in row} >= {"0.000000", "-0.000000"}
    assert plain(registry.QUERIES["query_embedding"](spark, str(tmp_path)).toPandas()) == want


def test_entities_of_whole_texts(spark, duck):
    """DuckDB's words end at ASCII letters, so the model is Python's regular expressions."""
    want = set()
    for doc, text in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        want |= {(doc, x) for p in (r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*\b", r"\b\d+(?:\.\d+)?\b") for x in re.findall(p, text)}
    found = [tuple(r) for r in registry.QUERIES["entity_index"](spark, DATA).collect()]
    assert len(found) == len(want) and set(found) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
