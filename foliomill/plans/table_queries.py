"""Queries over the star-schema tables: trees, graphs, profiles, state, feedback, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import graph, search, sections, state, tree
from foliomill.plans.document_queries import LINES, _lines
from foliomill.plans.tables import table
from foliomill.sources import parsers


def html_sections(spark: SparkSession, d: str) -> DataFrame:
    return parsers.html_sections(table(spark, d, "pages"))


def csv_profile(spark: SparkSession, d: str) -> DataFrame:
    return sections.column_stats(table(spark, d, "customer").select("c_name", "c_nationkey", "c_mktsegment"))


def table_schema_preview(spark: SparkSession, d: str) -> DataFrame:
    return sections.preview(table(spark, d, "nation"), ["n_nationkey"])


def tabular_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as text: each line item a line of cells, a heading before every third."""
    item = F.concat(F.col("l_linenumber").cast("string"), F.lit("  "), F.col("l_partkey").cast("string"), F.lit("  "), F.col("l_suppkey").cast("string"))
    line = F.when(F.col("l_linenumber") % 4 == 3, "plain words").otherwise(item)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))).alias("x"))
    return sections.tabular_lines(rows.select(F.col("l_orderkey").alias("doc_id"), F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("text")))


TABULAR = """
WITH rows AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 4 = 3 THEN 'plain words' ELSE l_linenumber || '  ' || l_partkey || '  ' || l_suppkey END AS line,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem),
hits AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM rows WHERE contains(line, '  ')),
runs AS (SELECT doc_id, run, count(*) AS n_lines, min(pos) AS first, string_agg(replace(line, '  ', ' | '), chr(10) ORDER BY pos) AS content FROM hits GROUP BY doc_id, run)
SELECT doc_id, CAST(first AS INTEGER) AS first_line, n_lines, content FROM runs WHERE n_lines >= 2
"""


def _nation_nodes(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("See Table "), F.col("n_regionkey").cast("string"), F.lit(" and Section "), F.col("n_nationkey").cast("string"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node_id"), text.alias("text"))


def xref_index(spark: SparkSession, d: str) -> DataFrame:
    return _nation_nodes(spark, d).select("node_id", F.explode(T.cross_references(F.col("text"))).alias("reference"))


def edges_references(spark: SparkSession, d: str) -> DataFrame:
    refs = xref_index(spark, d)
    return graph.references(refs, refs).select("src", "dst", "weight")


def _geo(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree of three levels, each region a document; pages are nation keys."""
    nation, region, customer = (table(spark, d, t) for t in ("nation", "region", "customer"))
    regions = region.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.col("r_name").alias("title"))
    nations = nation.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.lit(1).alias("depth"), F.col("n_name").alias("title"))
    clients = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent_id"), F.lit(2).alias("depth"), F.col("c_name").alias("title"))
    return regions.unionByName(nations).unionByName(clients)


GEO = """
geo AS (SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'r' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth, r_name AS title FROM region
 UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, 1, n_name FROM nation
 UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || n_nationkey, 2, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def edges_elaborates(spark: SparkSession, d: str) -> DataFrame:
    return graph.elaborates(_geo(spark, d)).select("src", "dst", "edge_type", "weight")


def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    """From two regions, up to three hops."""
    seeds = spark.createDataFrame([(1, "r0"), (2, "r1"), (2, "n3")], "query_id int, node string")
    return graph.bfs(seeds, graph.elaborates(_geo(spark, d)), 3)


def tree_stats(spark: SparkSession, d: str) -> DataFrame:
    return tree.stats(_geo(spark, d))


def super_tree(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).groupBy("doc_id").agg(F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"))
    roots = rows.select("doc_id", F.lit("node_0000").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("Document").alias("title"), "start_page", "end_page")
    return tree.super_tree(roots).drop("doc_id")


def tree_build(spark: SparkSession, d: str) -> DataFrame:
    return tree.build(_lines(spark, d))


def tree_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    return tree.quality(tree.build(rows), rows)


def entity_seed_prune(spark: SparkSession, d: str) -> DataFrame:
    """Nations that are, or that hold, one of the customers of the largest balances."""
    geo = _geo(spark, d)
    seeds = table(spark, d, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    pairs = geo.where("depth = 2").select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("descendant"))
    both = pairs.unionByName(geo.where("depth = 1").select("node_id", F.col("node_id").alias("descendant")))
    return search.seed_prune(both, seeds)


def _order_nodes(spark: SparkSession, d: str) -> DataFrame:
    words = F.when(F.col("o_orderstatus") == "F", "sales growth").when(F.col("o_orderstatus") == "O", "sales decline").otherwise("sales steady")
    text = F.concat(F.lit("Orders "), F.year("o_orderdate").cast("string"), F.lit(" "), words)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("node_id"), F.col("o_orderkey").alias("preorder"), text.alias("text"))


ORDER_NODES = """
nodes AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS node_id, o_orderkey AS preorder, year(o_orderdate) AS y,
 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS tone FROM orders)
"""


def edges_temporal(spark: SparkSession, d: str) -> DataFrame:
    return graph.dedupe(graph.temporal(_order_nodes(spark, d))).select("src", "dst", "weight")


def edges_contradicts(spark: SparkSession, d: str) -> DataFrame:
    return graph.contradicts(_order_nodes(spark, d)).select("src", "dst", "weight")


def edges_dedupe(spark: SparkSession, d: str) -> DataFrame:
    both = graph.temporal(_order_nodes(spark, d)).unionByName(graph.contradicts(_order_nodes(spark, d)))
    return graph.dedupe(both, collapse_parallel=True).select("src", "dst", "edge_type", "weight")


def edges_cosine(spark: SparkSession, d: str) -> DataFrame:
    return graph.similar_dense(table(spark, d, "embeddings"), 0.25)


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 13 <> 0")
    new = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return old, new


def section_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.select("doc_id", state.section_hash(F.col("text"), F.col("doc_id")).alias("hash")) for x in _edited(spark, d))
    return state.diff(old, new, ["doc_id"])


def reindex_plan(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose number is divisible by three change in every fifth document."""
    rows = _lines(spark, d)
    old = rows.select("doc_id", "section_id", "page_number", state.section_hash(F.col("content")).alias("hash"))
    changed = F.when((F.col("doc_id") % 5 == 0) & (F.col("page_number") % 3 == 0), F.concat("content", F.lit("?"))).otherwise(F.col("content"))
    new = rows.select("doc_id", "section_id", "page_number", state.section_hash(changed).alias("hash"))
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    return state.reindex_plan(state.diff(old, new, ["doc_id", "section_id", "page_number"]), sizes)


def affected_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of ten pages that hold a page divisible by seventeen."""
    rows = _lines(spark, d)
    nodes = rows.select("doc_id", F.floor((F.col("page_number") - 1) / 10).cast("int").alias("part")).distinct()
    nodes = nodes.select("doc_id", "part", (F.col("part") * 10 + 1).alias("start_page"), (F.col("part") * 10 + 10).alias("end_page"))
    return state.affected(nodes, rows.where("page_number % 17 = 0").select("doc_id", "page_number")).select("doc_id", "part")


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    changes = orders.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(100_000_000)).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), "o_totalprice")
    return state.upsert(orders, changes, ["o_orderkey"])


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Line items without those of deleted orders or parts."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    gone = spark.range(401).select(F.col("id").alias("key"))
    return state.delete_keys(items, gone, ["l_orderkey", "l_partkey"], "key")


def additive_metrics(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    by = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return state.add_up(by(events.where("event_id % 2 = 0")), by(events.where("event_id % 2 = 1")), ["user_id", "event_type"], ["n"])


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    """Events as feedback: a user is a document, the event type a node; purchases are uses."""
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("doc_id"), F.col("event_type").alias("node_id"), F.lit(True).alias("visited"), (F.col("event_type") == "purchase").alias("used"), F.pmod(F.col("event_id"), F.lit(3)).alias("cluster"))


def feedback_counters(spark: SparkSession, d: str) -> DataFrame:
    return state.counters(_feedback(spark, d))


def misleading_nodes(spark: SparkSession, d: str) -> DataFrame:
    return state.misleading(state.counters(_feedback(spark, d)), visit=0.3)


def affinity_scores(spark: SparkSession, d: str) -> DataFrame:
    return state.affinity(_feedback(spark, d))


def affinity_fastpath(spark: SparkSession, d: str) -> DataFrame:
    scores = state.affinity(_feedback(spark, d))
    return search.affinity_split(state.counters(_feedback(spark, d)), scores, 0.5).select("doc_id", "node_id", "visits")


def feedback_trigger(spark: SparkSession, d: str) -> DataFrame:
    return state.trigger(_feedback(spark, d).withColumn("doc_id", F.pmod(F.col("doc_id"), F.lit(20))))


def eval_kpis(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    latency = F.pmod(F.col("doc_id") * 7919, F.lit(500)).cast("int")
    return state.kpis(labels.select((F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("cited"), latency.alias("latency_ms"), F.lit(1).alias("tier1_calls"), F.pmod(F.col("doc_id"), F.lit(4)).cast("int").alias("tier2_calls"), (F.col("doc_id") % 3 == 0).alias("cache_hit")))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return state.latest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type")


QUERIES = {f.__name__: f for f in (
    html_sections, csv_profile, table_schema_preview, tabular_lines, xref_index, edges_references, edges_elaborates, graph_bfs, tree_stats, super_tree, tree_build,
    tree_quality, entity_seed_prune, edges_temporal, edges_contradicts, edges_dedupe, edges_cosine, section_diff, reindex_plan, affected_nodes, merge_upsert,
    delete_cascade, additive_metrics, feedback_counters, misleading_nodes, affinity_scores, affinity_fastpath, feedback_trigger, eval_kpis, latest_version, recent_events,
)}

_NONBLANK = "nullif(trim(CAST({c} AS VARCHAR)), '')"
_XREFS = """refs AS (SELECT CAST(n_nationkey AS VARCHAR) AS node_id, unnest(['Table ' || n_regionkey, 'Section ' || n_nationkey]) AS reference FROM nation)"""
_FEEDBACK = "fb AS (SELECT event_id, ts, user_id AS doc_id, event_type AS node_id, event_type = 'purchase' AS used, event_id % 3 AS cluster FROM events)"
_COUNTERS = _FEEDBACK + """,
c AS (SELECT doc_id, node_id, count(*) AS visits, CAST(sum(CASE WHEN used THEN 1 ELSE 0 END) AS BIGINT) AS uses FROM fb GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS events FROM fb GROUP BY doc_id),
counters AS (SELECT doc_id, node_id, visits, uses, round(least(1.0, visits / events), 6) AS visit_rate, round(least(1.0, uses / greatest(1, visits)), 6) AS utility_rate FROM c JOIN n USING (doc_id))"""
_AFFINITY = """
hits AS (SELECT doc_id, node_id, cluster, count(*) AS hits FROM fb WHERE used GROUP BY ALL), totals AS (SELECT doc_id, cluster, count(*) AS total FROM fb GROUP BY ALL),
affinity AS (SELECT doc_id, node_id, cluster, round(hits / total, 6) AS score FROM hits JOIN totals USING (doc_id, cluster))"""
_TEMPORAL = ORDER_NODES + """,
steps AS (SELECT node_id AS src, lead(node_id) OVER w AS dst, y, lead(y) OVER w AS y2, tone, lead(tone) OVER w AS tone2 FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY preorder))"""

ORACLES = {
    "csv_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({_NONBLANK.format(c=c)}) AS non_blank, count(DISTINCT {_NONBLANK.format(c=c)}) AS n_distinct FROM customer" for c in ("c_name", "c_nationkey", "c_mktsegment")),
    "table_schema_preview": """
SELECT 'schema' AS type, 0 AS page_number, 'columns: n_nationkey, n_name, n_regionkey' AS content UNION ALL
SELECT 'row', CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER), 'n_nationkey=' || n_nationkey || '; n_name=' || n_name || '; n_regionkey=' || n_regionkey FROM (FROM nation ORDER BY n_nationkey LIMIT 25)""",
    "tabular_lines": TABULAR,
    "xref_index": f"WITH {_XREFS} SELECT DISTINCT * FROM refs",
    "edges_references": f"WITH {_XREFS} SELECT DISTINCT a.node_id AS src, b.node_id AS dst, 0.8::DOUBLE AS weight FROM refs a JOIN refs b USING (reference) WHERE a.node_id <> b.node_id",
    "edges_elaborates": f"WITH {GEO} SELECT parent_id AS src, node_id AS dst, 'ELABORATES' AS edge_type, 0.95::DOUBLE AS weight FROM geo WHERE parent_id IS NOT NULL",
    "graph_bfs": f"""
WITH RECURSIVE {GEO}, walk AS (SELECT * FROM (VALUES (1, 'r0', 0), (2, 'r1', 0), (2, 'n3', 0)) s(query_id, node, hops)
 UNION SELECT query_id, node_id, hops + 1 FROM walk JOIN geo ON parent_id = node WHERE hops < 3)
SELECT query_id, node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY query_id, node""",
    "tree_stats": f"WITH {GEO} SELECT doc_id, count(*) AS n_nodes, max(depth) AS max_depth, round(avg(depth), 6) AS avg_depth FROM geo GROUP BY doc_id",
    "super_tree": f"""
WITH {LINES}, roots AS (SELECT doc_id, min(page_number) AS a, max(page_number) AS b FROM sections GROUP BY doc_id)
SELECT 'super_root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'All documents' AS title, 0 AS depth, min(a) AS start_page, max(b) AS end_page FROM roots
UNION ALL SELECT printf('super_%04d_', row_number() OVER (ORDER BY doc_id)) || doc_id, 'super_root', 'Document [' || doc_id || ']', 1, a, b FROM roots""",
    "entity_seed_prune": "SELECT DISTINCT 'n' || c_nationkey AS node_id FROM customer WHERE c_acctbal > 9000",
    "edges_temporal": f"WITH {_TEMPORAL} SELECT src, dst, 0.55::DOUBLE AS weight FROM steps WHERE dst IS NOT NULL",
    "edges_contradicts": f"WITH {_TEMPORAL} SELECT src, dst, 0.6::DOUBLE AS weight FROM steps WHERE dst IS NOT NULL AND tone * tone2 = -1",
    "edges_dedupe": f"WITH {_TEMPORAL} SELECT src, dst, CASE WHEN tone * tone2 = -1 THEN 'CONTRADICTS' ELSE 'TEMPORALLY_FOLLOWS' END AS edge_type, CASE WHEN tone * tone2 = -1 THEN 0.6::DOUBLE ELSE 0.55::DOUBLE END AS weight FROM steps WHERE dst IS NOT NULL",
    "edges_cosine": """
SELECT a, b, cosine FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS cosine
 FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE cosine >= 0.25""",
    "section_diff": """
WITH old AS (SELECT doc_id, text FROM documents WHERE doc_id % 13 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN old.text IS NULL THEN 'added' WHEN new.text IS NULL THEN 'removed' ELSE 'changed' END AS change_type FROM old FULL JOIN new USING (doc_id) WHERE old.text IS DISTINCT FROM new.text""",
    "reindex_plan": f"""
WITH {LINES}, sizes AS (SELECT doc_id, count(*) AS n_sections FROM sections GROUP BY doc_id),
changed AS (SELECT doc_id, count(DISTINCT page_number) AS n_changed FROM sections WHERE doc_id % 5 = 0 AND page_number % 3 = 0 GROUP BY doc_id)
SELECT doc_id, n_changed, n_sections, CASE WHEN n_changed / greatest(1, n_sections) <= 0.5 THEN 'partial' ELSE 'full' END AS mode FROM changed JOIN sizes USING (doc_id)""",
    "affected_nodes": f"WITH {LINES} SELECT DISTINCT doc_id, CAST((page_number - 1) // 10 AS INTEGER) AS part FROM sections WHERE page_number % 17 = 0",
    "merge_upsert": """
WITH o AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders),
changes AS (SELECT o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 100000000 END AS o_orderkey, 'X' AS o_orderstatus, o_totalprice FROM o WHERE o_orderkey % 3 = 0)
SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes) UNION ALL SELECT * FROM changes""",
    "delete_cascade": "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey > 400 AND l_partkey > 400",
    "additive_metrics": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL",
    "feedback_counters": f"WITH {_COUNTERS} SELECT * FROM counters",
    "misleading_nodes": f"WITH {_COUNTERS} SELECT * FROM counters WHERE visit_rate >= 0.3 AND utility_rate <= 0.2",
    "affinity_scores": f"WITH {_FEEDBACK}, {_AFFINITY} SELECT * FROM affinity",
    "affinity_fastpath": f"WITH {_COUNTERS}, {_AFFINITY} SELECT doc_id, node_id, visits FROM counters SEMI JOIN (SELECT * FROM affinity WHERE score >= 0.5) USING (doc_id, node_id)",
    "feedback_trigger": """
WITH recent AS (SELECT user_id % 20 AS doc_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)
SELECT doc_id, count(*) AS n FROM recent GROUP BY doc_id HAVING count(*) >= 5 AND count(*) % 5 = 0""",
    "eval_kpis": """
WITH r AS (SELECT quality = 1 AS correct, toxic = 0 AS cited, doc_id * 7919 % 500 AS latency, doc_id % 4 AS t2, doc_id % 3 = 0 AS hit FROM labels)
SELECT count(*) AS n, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 4) AS intent_accuracy, round(avg(CASE WHEN cited THEN 1.0 ELSE 0.0 END), 4) AS citation_coverage,
 round(avg(0.0001 + t2 * 0.0006), 6) AS avg_cost_usd, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS cache_hit_rate,
 CAST(list_sort(list(latency))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS DOUBLE) AS p95_latency_ms FROM r""",
    "latest_version": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "recent_events": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
}
