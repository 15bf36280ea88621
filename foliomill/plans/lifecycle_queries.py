"""Queries over state, the adaptive loop, evaluation and several documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.operators import adaptive, evaluation, multi, search, sessions, state
from foliomill.plans.document_queries import LINES, QUESTION, TIER1, _lines, _nodes, _question
from foliomill.plans.table_queries import _COUNTERS, GEO, _feedback, _geo
from foliomill.plans.tables import table


def _users(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'")
    return turns.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("asked_at"), F.col("text").alias("original_query"))


def session_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns before the fourth are held; the later ones are numbered on."""
    users = _users(spark, d)
    held = users.where("asked_at < 4").withColumn("turn_id", F.row_number().over(Window.partitionBy("session_id").orderBy("asked_at", F.coalesce("original_query", F.lit("")))))
    return sessions.numbered(held, users.where("asked_at >= 4")).select("session_id", "asked_at", "turn_id")


def query_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "conversations").select(
        "conv_id", "turn", sessions.cache_key(c("conv_id"), c("role"), c("text")).alias("cache_key"),
        sessions.query_key(c("conv_id"), F.when(c("turn") % 2 == 0, c("role")), c("text"), c("turn")).alias("query_key"),
    )


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Orders cached at a version, put again for every fifth, dropped for some customers, asked at another version."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("cache_key"), F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 3).cast("int").alias("doc_version"), F.col("o_orderstatus").alias("value"))
    again = o.where(F.col("cache_key").cast("long") % 5 == 0).withColumn("doc_version", F.lit(1)).withColumn("value", F.lit("again"))
    cache = sessions.invalidated(sessions.put(o, again), o.where("doc_id % 7 = 0").select("doc_id").distinct())
    asked = o.select("cache_key", "doc_id", (F.col("cache_key").cast("long") % 2).cast("int").alias("doc_version"))
    return sessions.cached(cache, asked).select("cache_key", "doc_id", "doc_version", "value")


def node_rates(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.explode(F.array(F.lit("purchase"), F.lit("view"))).alias("node_id"))
    events = _feedback(spark, d)
    return adaptive.rated(nodes, events).select("doc_id", "node_id", "visits", "uses", "visit_rate", "utility_rate")


def regeneration_queue(spark: SparkSession, d: str) -> DataFrame:
    """All misleading nodes of the feedback are queued at their document's number modulo 10; those that wait longest."""
    misled = state.misleading(state.counters(_feedback(spark, d)), visit=0.3).select("doc_id", "node_id", F.lit(1).alias("start_page"), F.lit(2).alias("end_page"))
    queue = adaptive.enqueued(misled, F.col("doc_id") % 10)
    return adaptive.pending(queue).join(queue.select("doc_id", "node_id", "prompt"), ["doc_id", "node_id"]).select("doc_id", "node_id", "prompt")


def summary_regeneration(spark: SparkSession, d: str) -> DataFrame:
    """Every document waits with one node over its first two pages, and all are rewritten."""
    rows = _lines(spark, d)
    nodes = rows.select("doc_id").distinct().select("doc_id", F.lit("n1").alias("node_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page"))
    queue = adaptive.enqueued(nodes, F.lit(0))
    return adaptive.settled(queue, adaptive.regenerated(nodes, nodes, rows)).select("doc_id", "status", "new_summary")


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels, n = table(spark, d, "labels"), F.col("doc_id")
    asked = labels.select(n.alias("case_no"), F.when(F.col("quality") == 1, "graph").otherwise("single_doc").alias("intent"))
    told = labels.select(n.alias("case_no"), F.when(n % 5 == 0, "graph").otherwise("single_doc").alias("intent_type"), (n % 3).cast("int").alias("n_sources"), F.pmod(n * 7919, F.lit(500)).cast("int").alias("latency_ms"), F.lit(1).alias("tier1_calls"), (n % 4).cast("int").alias("tier2_calls"), (n % 3 == 0).alias("cache_hit"))
    return asked, told


def eval_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.dashboard(evaluation.paired(*_results(spark, d)))


def release_gates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gates(eval_dashboard(spark, d), {"intent_accuracy": 0.9, "citation_coverage": 0.5}, {"avg_cost_usd": 0.0005})


def multi_doc_selection(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.col("user_id").cast("long").alias("seed_doc_id"))
    return multi.selected(asked, table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("doc_id")))


def route_multi_doc(spark: SparkSession, d: str) -> DataFrame:
    """The question asked of all documents: the two best, their answers from five lines each, and one answer of both."""
    question, nodes = _question(spark), _nodes(spark, d)
    found = search.tier1_scores(question, nodes).withColumnRenamed("score", "confidence")
    places = multi.best(multi.document_scores(found)).select("query_id", "doc_id", "place")
    mine = found.join(F.broadcast(places), ["query_id", "doc_id"])  # two documents a question
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("confidence"), "node_id"))).where("rank <= 5")
    own = ranked.select(F.struct("query_id", "doc_id").alias("query_id"), "doc_id", "node_id", "confidence", "rank")
    answers = search.answer(search.retrieve(own, nodes, _lines(spark, d))).select("query_id.query_id", "query_id.doc_id", "answer", "confidence").join(places, ["query_id", "doc_id"])
    told = multi.merged(question, answers, ranked)
    return told.select("query_id", "answer", "confidence", F.array_join(F.transform("source_nodes", lambda x: x["node_id"]), ",").alias("sources"))


def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations looked up in the tree of regions and nations."""
    wanted = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node_id"))
    return wanted.join(_geo(spark, d).select("node_id", "parent_id", "depth"), "node_id").select("c_custkey", "node_id", "parent_id", "depth")


QUERIES = {f.__name__: f for f in (
    session_turns, query_keys, cache_lookup, node_rates, regeneration_queue, summary_regeneration, eval_dashboard, release_gates, multi_doc_selection, route_multi_doc, node_lookup,
)}

_PLAIN = r"lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))"
_EVAL = """r AS (SELECT (quality = 1) = (doc_id % 5 = 0) AS correct, doc_id % 3 > 0 AS cited, doc_id * 7919 % 500 AS latency, doc_id % 4 AS t2, doc_id % 3 = 0 AS hit FROM labels),
kpi AS (SELECT count(*) AS total_eval_cases, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 4) AS intent_accuracy, round(avg(CASE WHEN cited THEN 1.0 ELSE 0.0 END), 4) AS citation_coverage,
 round(avg(0.0001 + t2 * 0.0006), 6) AS avg_cost_usd, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS cache_hit_rate,
 CAST(list_sort(list(latency))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS DOUBLE) AS p95_latency_ms, round(avg(latency), 2) AS avg_latency_ms FROM r)"""

ORACLES = {
    "session_turns": """
SELECT session_id, asked_at, turn_id FROM (SELECT conv_id AS session_id, turn AS asked_at, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS turn_id FROM conversations WHERE role = 'user')
WHERE asked_at >= 4""",
    "query_keys": f"""
SELECT conv_id, turn, sha1(conv_id || ':' || coalesce(role, '') || ':' || {_PLAIN}) AS cache_key,
 sha1(conv_id || ':' || CASE WHEN turn % 2 = 0 THEN coalesce(role, '-') ELSE '-' END || ':' || {_PLAIN} || ':' || turn) AS query_key FROM conversations""",
    "cache_lookup": """
SELECT CAST(o_orderkey AS VARCHAR) AS cache_key, o_custkey AS doc_id, CAST(o_orderkey % 2 AS INTEGER) AS doc_version, CASE WHEN o_orderkey % 5 = 0 THEN 'again' ELSE o_orderstatus END AS value FROM orders
WHERE o_custkey % 7 <> 0 AND CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 3 END = o_orderkey % 2""",
    "node_rates": f"""
WITH {_COUNTERS}, nodes AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, unnest(['purchase', 'view']) AS node_id FROM customer)
SELECT doc_id, node_id, coalesce(visits, 0) AS visits, coalesce(uses, 0) AS uses, coalesce(visit_rate, 0) AS visit_rate, coalesce(utility_rate, 0) AS utility_rate FROM nodes LEFT JOIN counters USING (doc_id, node_id)""",
    "regeneration_queue": f"""
WITH {_COUNTERS} SELECT doc_id, node_id, 'Rewrite summary for node ' || node_id || ' to strictly describe pages 1-2.' AS prompt FROM counters
WHERE visit_rate >= 0.3 AND utility_rate <= 0.2 ORDER BY doc_id % 10, doc_id, node_id LIMIT 20""",
    "summary_regeneration": rf"""
WITH {LINES}, bodies AS (SELECT doc_id, string_agg(content, ' ' ORDER BY page_number) AS body FROM sections WHERE page_number <= 2 GROUP BY doc_id)
SELECT doc_id, 'done' AS status, 'Document ' || doc_id || ': ' || substring(regexp_replace(body, '\s+', ' ', 'g'), 1, 240) AS new_summary FROM bodies""",
    "eval_dashboard": f"WITH {_EVAL} SELECT * FROM kpi",
    "release_gates": f"""
WITH {_EVAL} SELECT 'intent_accuracy' AS gate, intent_accuracy AS value, 0.9::DOUBLE AS bound, intent_accuracy >= 0.9 AS passed FROM kpi
UNION ALL SELECT 'citation_coverage', citation_coverage, 0.5, citation_coverage >= 0.5 FROM kpi
UNION ALL SELECT 'p95_latency_ms', p95_latency_ms, 2000, p95_latency_ms <= 2000 FROM kpi
UNION ALL SELECT 'avg_cost_usd', avg_cost_usd, 0.0005, avg_cost_usd <= 0.0005 FROM kpi""",
    "multi_doc_selection": """
WITH pairs AS (SELECT event_id AS query_id, CAST(user_id AS BIGINT) AS seed, h.k AS doc_id FROM events, (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer ORDER BY 1 LIMIT 3) h WHERE h.k <> user_id)
SELECT event_id AS query_id, CAST(user_id AS BIGINT) AS doc_id, 0 AS place FROM events
UNION ALL SELECT query_id, doc_id, place FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id, seed ORDER BY doc_id) AS INTEGER) AS place FROM pairs) WHERE place <= 2""",
    "route_multi_doc": f"""
WITH {TIER1}, best AS (SELECT doc_id, row_number() OVER (ORDER BY max(score) DESC, doc_id) AS place FROM hits GROUP BY doc_id QUALIFY place <= 2),
ranked AS (SELECT h.*, place, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, node_id) AS rank FROM hits h JOIN best USING (doc_id) QUALIFY rank <= 5),
answers AS (SELECT doc_id, place, round(avg(score), 6) AS confidence, last('- ' || substring(content, 1, 260) || ' (, pages ' || page_number || '-' || page_number || ')' ORDER BY rank) AS line FROM ranked GROUP BY doc_id, place),
sources AS (SELECT string_agg(node_id, ',' ORDER BY place, rank) AS sources FROM (FROM ranked ORDER BY place, rank LIMIT 6))
SELECT 1 AS query_id, 'Query: {QUESTION}' || chr(10) || chr(10) || 'Cross-document summary:' || chr(10) || string_agg('- [' || doc_id || '] ' || line, chr(10) ORDER BY place) AS answer,
 round(avg(confidence), 6) AS confidence, any_value(sources) AS sources FROM answers, sources""",
    "node_lookup": f"WITH {GEO} SELECT c_custkey, node_id, parent_id, depth FROM customer JOIN geo ON node_id = 'n' || c_nationkey",
}
