"""Queries over documents and conversations: sections, tokens, entities, analysis, search, extraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import extract, search, sections
from foliomill.plans.tables import table

#: The query that the search queries ask.
QUESTION = "the of and that with"

LINES = """
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
sections AS (SELECT doc_id, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS page_number
  FROM (SELECT doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS content FROM raw) WHERE content <> '')
"""
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return sections.lines(table(spark, d, "documents"))


def sections_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


def sections_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return sections.paragraphs(table(spark, d, "documents"))


def word_budget(spark: SparkSession, d: str) -> DataFrame:
    return sections.budgets(_lines(spark, d), limit=1000)


def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return sections.keywords(table(spark, d, "documents"))


KEYWORDS = f"""
toks AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token, generate_subscripts({TOKENS.format('text')}, 1) AS pos FROM documents),
counted AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first FROM toks WHERE length(token) >= 4 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM counted)
"""


def heuristic_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = sections.keywords(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("keywords"))
    label = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    pages = F.size(F.filter(F.split("text", "\n"), lambda x: T.strip(x) != ""))
    rows = docs.join(words, "doc_id", "left").select("doc_id", "text", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), pages.alias("pages"), label.alias("label"))
    return rows.select("doc_id", T.summary(F.col("label"), F.lit(1), F.col("pages"), F.col("keywords"), F.col("text")).alias("summary"))


def entity_index(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(T.entities(F.col("text"))).alias("entity")).distinct()


def _cued(spark: SparkSession, d: str) -> DataFrame:
    cue = F.when(F.col("turn") % 3 == 0, "Compare ").when(F.col("turn") % 3 == 1, "What cites ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(cue, F.col("text")).alias("text"))


def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    return _cued(spark, d).select("conv_id", "turn", T.intent(F.col("text")).alias("intent_type"))


def query_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.query_entities(F.col("text")), "|").alias("entities"))


def followup_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return search.analyse(table(spark, d, "conversations")).select("conv_id", "turn", "rewritten_query")


def query_embedding(spark: SparkSession, d: str) -> DataFrame:
    """FN-3 without zeros, to six places. Spark's round loses the sign of what rounds to 0; components below 0 keep it, as -0.0."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.embedding(F.col("text"))).alias("dim", "v"))
    size = F.round(F.abs("v"), 6)
    return rows.where(F.col("v") != 0).select("conv_id", "turn", "dim", F.when(F.col("v") < 0, -size).otherwise(size).alias("v"))


def query_cluster(spark: SparkSession, d: str) -> DataFrame:
    """FN-4: the first twelve hex digits of the sha1 of the embedding, two decimals a component."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.embedding(F.col("text")).alias("v"))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cluster"] = [hashlib.sha1(",".join(f"{x:.2f}" for x in v).encode()).hexdigest()[:12] for v in batch.v]
            yield batch[["conv_id", "turn", "cluster"]]

    return rows.mapInPandas(name, "conv_id long, turn long, cluster string")


def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("n", rank).where(F.col("n") <= 6).select("conv_id", "turn", F.col("n").cast("int").alias("recency"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    node = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("section_id"))
    return rows.select("doc_id", node.alias("node_id"), F.col("page_number").alias("preorder"), F.col("content").alias("text"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("title"), F.col("page_number").alias("start_page"), F.col("page_number").alias("end_page"))


def _question(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, QUESTION)], "query_id int, text string")


def tier1_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = search.tier1_scores(_question(spark), _nodes(spark, d))
    return scores.select("doc_id", "node_id", F.round("score", 6).alias("score"))


def tier1_selected(spark: SparkSession, d: str) -> DataFrame:
    question, nodes = _question(spark), _nodes(spark, d)
    chosen = search.tier1_selected(search.with_zeros(search.tier1_scores(question, nodes), question, nodes), threshold=0.7)
    return chosen.select("doc_id", "node_id", F.round("score", 6).alias("score"))


TIER1 = LINES + f""",
q AS (SELECT list_distinct({TOKENS.format("'" + QUESTION + "'")}) AS toks),
scored AS (SELECT doc_id, page_number, CAST(doc_id AS VARCHAR) || ':' || printf('sec_%04d', page_number) AS node_id, content,
  len(list_intersect(q.toks, list_distinct({TOKENS.format('content')}))) / greatest(1, len(q.toks)) AS score FROM sections, q),
hits AS (SELECT * FROM scored WHERE score > 0)
"""


def tier2_candidates(spark: SparkSession, d: str) -> DataFrame:
    question, nodes = _question(spark), _nodes(spark, d)
    chosen = search.tier1_selected(search.with_zeros(search.tier1_scores(question, nodes), question, nodes))
    return search.tier2(question, nodes, chosen)


def retrieve_page_range(spark: SparkSession, d: str) -> DataFrame:
    """Pages 2 and 3 of every document, as one chunk."""
    rows = _lines(spark, d)
    docs = rows.select("doc_id").distinct()
    nodes = docs.select("doc_id", F.lit("node_0001").alias("node_id"), F.lit("Part").alias("title"), F.lit(2).alias("start_page"), F.lit(3).alias("end_page"))
    return search.retrieve(docs.withColumn("node_id", F.lit("node_0001")), nodes, rows).select("doc_id", "pages", "content")


def answer_topk(spark: SparkSession, d: str) -> DataFrame:
    """Five best sections of the corpus for the question, as an answer."""
    nodes = _nodes(spark, d)
    scores = search.tier1_scores(_question(spark), nodes).orderBy(F.desc("score"), "doc_id", "node_id").limit(5)
    ranked = scores.select("query_id", "doc_id", "node_id", F.col("score").alias("confidence"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "node_id")).alias("rank"))
    return search.answer(search.retrieve(ranked, nodes, _lines(spark, d))).drop("query_id")


def adjacent_similarity(spark: SparkSession, d: str) -> DataFrame:
    return sections.adjacent_similarity(_lines(spark, d))


def semantic_groups(spark: SparkSession, d: str) -> DataFrame:
    return sections.windowed_groups(_lines(spark, d))


SEMANTIC_GROUPS = "WITH RECURSIVE " + LINES + """,
counted AS (SELECT doc_id, page_number, greatest(1, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))) AS words FROM sections),
fold AS (
  SELECT doc_id, page_number, 0 AS "group", CAST(words AS BIGINT) AS held FROM counted WHERE page_number = 1
  UNION ALL
  SELECT c.doc_id, c.page_number, f."group" + CASE WHEN f.held >= 280 THEN 1 ELSE 0 END, CASE WHEN f.held >= 280 THEN 0 ELSE f.held END + c.words
  FROM fold f JOIN counted c ON c.doc_id = f.doc_id AND c.page_number = f.page_number + 1)
SELECT doc_id, printf('sec_%04d', page_number) AS section_id, CAST("group" AS INTEGER) AS "group" FROM fold
"""


def literal_extractions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lit("sec_0001").alias("section_id"), F.col("text").alias("content"))
    return extract.literal(docs, table(spark, d, "benchmark")).select("doc_id", "item_id", "char_start", "char_end")


def fuzzy_align(spark: SparkSession, d: str) -> DataFrame:
    """Passages found literally, with white space doubled, aligned again."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("sec_0001").alias("section_id"), F.col("text").alias("content"))
    found = extract.literal(docs, table(spark, d, "benchmark")).select("doc_id", "item_id").distinct()
    phrases = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", " ", "  ").alias("phrase"))
    return extract.aligned(found.join(phrases, "item_id").join(docs, "doc_id"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return extract.chunks(_lines(spark, d))


def extraction_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of benchmark passages, each given twice with a shift, without the overlapping ones."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("sec_0001").alias("section_id"), F.col("text").alias("content"))
    found = extract.literal(docs, table(spark, d, "benchmark"))
    both = found.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("shift"))
    rows = both.select("doc_id", "section_id", F.lit("passage").alias("extraction_class"), F.lit("").alias("extraction_text"), (F.col("char_start") + F.col("shift")).cast("long").alias("char_start"), (F.col("char_end") + F.col("shift")).cast("long").alias("char_end"), (F.col("char_start") * 2 + F.col("shift")).cast("long").alias("arrival"))
    return extract.dedupe(rows)


QUERIES = {f.__name__: f for f in (
    sections_lines, sections_paragraphs, word_budget, keyword_topk, heuristic_summary, entity_index, intent_classify, query_entities, followup_rewrite,
    query_embedding, query_cluster, recent_turns, tier1_scores, tier1_selected, tier2_candidates, retrieve_page_range, answer_topk, adjacent_similarity,
    semantic_groups, literal_extractions, fuzzy_align, chunk_pack, extraction_dedupe,
)}

_INTENT = """CASE WHEN contains(q, 'compare') OR contains(q, 'vs') OR contains(q, 'versus') OR contains(q, 'difference between') THEN 'multi_doc'
 WHEN contains(q, 'refer') OR contains(q, 'references') OR contains(q, 'cite') OR contains(q, 'connected') THEN 'graph' ELSE 'single_doc' END"""

ORACLES = {
    "sections_lines": f"WITH {LINES} SELECT doc_id, printf('sec_%04d', page_number) AS section_id, page_number, content FROM sections",
    "sections_paragraphs": r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS piece, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pos FROM documents),
kept AS (SELECT doc_id, pos, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS content FROM raw),
numbered AS (SELECT doc_id, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS page_number FROM kept WHERE content <> '')
SELECT doc_id, printf('sec_%04d', page_number) AS section_id, page_number, content FROM numbered""",
    "word_budget": rf"""
WITH {LINES}, counted AS (SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> ''))) AS w FROM sections)
SELECT doc_id, CAST(sum(w) AS BIGINT) AS n_words, count(*) AS n_sections, sum(w) <= 1000 AS admitted FROM counted GROUP BY doc_id""",
    "keyword_topk": f"WITH {KEYWORDS} SELECT doc_id, rank, token, n FROM ranked WHERE rank <= 4",
    "heuristic_summary": rf"""
WITH {KEYWORDS}, words AS (SELECT doc_id, string_agg(token, ', ' ORDER BY rank) AS k FROM ranked WHERE rank <= 4 GROUP BY doc_id),
pages AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS n FROM documents)
SELECT doc_id, 'Document ' || doc_id || ': covers pages 1-' || n || CASE WHEN k IS NULL THEN '' ELSE '; keywords: ' || k END || '. Summary: '
 || CASE WHEN length(text) > 0 THEN substring(text, 1, 220) ELSE 'No content' END AS summary FROM documents JOIN pages USING (doc_id) LEFT JOIN words USING (doc_id)""",
    "intent_classify": f"""
WITH cued AS (SELECT conv_id, turn, lower(CASE turn % 3 WHEN 0 THEN 'Compare ' WHEN 1 THEN 'What cites ' ELSE '' END || text) AS q FROM conversations)
SELECT conv_id, turn, {_INTENT} AS intent_type FROM cued""",
    "query_entities": r"""
SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text,
 '\b(?:(?:Table|Section)\s+[A-Za-z0-9.\-]+|[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*)'), lambda x: rtrim(x, '.')),
 lambda x: lower(x) NOT IN ('what', 'which', 'where', 'when', 'who', 'why', 'how', 'this', 'that', 'these', 'those')))), '|'), '') AS entities
FROM conversations""",
    "followup_rewrite": r"""
WITH RECURSIVE users AS (SELECT conv_id, turn, q, row_number() OVER (PARTITION BY conv_id ORDER BY turn, q) AS n,
 starts_with(lower(q), 'what about') OR starts_with(lower(q), 'how about') OR starts_with(lower(q), 'and ') OR starts_with(lower(q), 'it ') OR starts_with(lower(q), 'that ') AS follows
 FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS q FROM conversations WHERE role = 'user')),
fold AS (SELECT conv_id, turn, n, q AS rewritten_query FROM users WHERE n = 1
 UNION ALL SELECT u.conv_id, u.turn, u.n, CASE WHEN follows THEN q || ' Context from previous turn: ' || f.rewritten_query ELSE q END FROM fold f JOIN users u ON u.conv_id = f.conv_id AND u.n = f.n + 1)
SELECT conv_id, turn, rewritten_query FROM fold""",
    "query_embedding": f"""
WITH toks AS (SELECT conv_id, turn, unnest({TOKENS.format('text')}) AS t FROM conversations),
hashed AS (SELECT conv_id, turn, sha1(t) AS h FROM toks),
parts AS (SELECT conv_id, turn, CAST(('0x' || substr(h, 1, 2))::INTEGER % 32 AS INTEGER) AS dim,
 (CASE WHEN ('0x' || substr(h, 3, 2))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (1 + ('0x' || substr(h, 5, 2))::INTEGER / 255.0::DOUBLE) AS v FROM hashed),
summed AS (SELECT conv_id, turn, dim, sum(v) AS v FROM parts GROUP BY ALL),
norms AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS norm FROM summed GROUP BY ALL)
SELECT conv_id, turn, dim, round(v / norm, 6) AS v FROM summed JOIN norms USING (conv_id, turn) WHERE v <> 0 AND norm > 0""",
    "recent_turns": """
SELECT conv_id, turn, recency FROM (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS recency FROM conversations) WHERE recency <= 6""",
    "tier1_scores": f"WITH {TIER1} SELECT doc_id, node_id, round(score, 6) AS score FROM hits",
    "tier1_selected": f"""
WITH {TIER1}, ranked AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_number) AS rank FROM scored)
SELECT doc_id, node_id, round(score, 6) AS score FROM ranked WHERE score >= 0.7 OR (best < 0.7 AND rank <= 3)""",
    "retrieve_page_range": f"""
WITH {LINES} SELECT doc_id, '2-3' AS pages, string_agg(content, chr(10) ORDER BY page_number) AS content FROM sections WHERE page_number BETWEEN 2 AND 3 GROUP BY doc_id""",
    "answer_topk": f"""
WITH {TIER1}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, node_id) AS n FROM hits QUALIFY n <= 5)
SELECT 'Based on the retrieved sections:' || chr(10) || string_agg('- ' || substring(content, 1, 260) || ' (' || '' || ', pages ' || page_number || '-' || page_number || ')', chr(10) ORDER BY n) AS answer,
 round(avg(score), 6) AS confidence, count(*) AS n_sources FROM top""",
    "adjacent_similarity": f"""
WITH {LINES}, own AS (SELECT doc_id, page_number, list_distinct({TOKENS.format('content')}) AS b, lag(list_distinct({TOKENS.format('content')})) OVER (PARTITION BY doc_id ORDER BY page_number) AS a FROM sections)
SELECT doc_id, printf('sec_%04d', page_number) AS section_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity
FROM own WHERE a IS NOT NULL""",
    "semantic_groups": SEMANTIC_GROUPS,
    "literal_extractions": """
WITH pairs AS (SELECT doc_id, item_id, lower(d.text) AS t, lower(b.text) AS n FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))),
places AS (SELECT doc_id, item_id, t, n, unnest(range(0, length(t) - length(n) + 1)) AS i FROM pairs)
SELECT doc_id, item_id, CAST(i AS INTEGER) AS char_start, CAST(i + length(n) AS INTEGER) AS char_end FROM places WHERE substring(t, i + 1, length(n)) = n""",
}
