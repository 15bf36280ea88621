"""Batch search: analysed queries against node tables, ranked candidates, retrieved text, answers."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators.lineage import cut


def analyse(turns: DataFrame) -> DataFrame:
    """FN-8..11, WIN-6: one row per user turn: the rewritten query, its intent and entities.

    A follow-up names the rewritten query before it: its run's turns, back to
    one that is no follow-up. Null texts are queries without text; turns of
    equal number go by text.
    """
    users = turns.where(F.col("role") == "user").select("conv_id", "turn", T.strip(F.coalesce("text", F.lit(""))).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    begins = ~T.follows(F.col("text")) | (F.row_number().over(order) == 1)
    numbered = users.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = F.collect_list("text").over(Window.partitionBy("conv_id", "run").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = numbered.withColumn("rewritten_query", F.array_join(F.reverse(so_far), T.CONTEXT))
    return rows.select("conv_id", "turn", "rewritten_query", T.intent(F.col("rewritten_query")).alias("intent_type"), T.query_entities(F.col("rewritten_query")).alias("entities"))


def tier1_scores(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """SRCH-2: FN-2 of each (query, node) that share a token, by a join on tokens; the others score 0.

    ``queries``: query_id, text; ``nodes``: doc_id, node_id, preorder, text.
    """
    q = queries.select("query_id", T.token_set(F.col("text")).alias("tokens")).withColumn("n", F.greatest(F.lit(1), F.size("tokens")))
    asked = q.select("query_id", "n", F.explode("tokens").alias("token"))
    held = nodes.select("doc_id", "node_id", "preorder", F.explode(T.token_set(F.col("text"))).alias("token"))
    shared = held.join(asked, "token").groupBy("query_id", "doc_id", "node_id", "preorder").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return shared.select("query_id", "doc_id", "node_id", "preorder", (F.col("shared") / F.col("n")).alias("score"))


def with_zeros(scores: DataFrame, queries: DataFrame, nodes: DataFrame, fallback: int = 3) -> DataFrame:
    """Tier-1 scores and, with score 0, those of the first ``fallback`` nodes of each document that share no token with a query.

    A document has less than ``fallback`` nodes with a token where the
    fallback of ``tier1_selected`` needs others, so these suffice. The result
    has rows for every query and document by definition; each query meets the
    heads of documents only, not their nodes.
    """
    heads = nodes.select("doc_id", "node_id", "preorder", F.row_number().over(Window.partitionBy("doc_id").orderBy("preorder")).alias("n")).where(F.col("n") <= fallback).drop("n")
    every = heads.crossJoin(queries.select("query_id").distinct()).select("query_id", "doc_id", "node_id", "preorder")
    others = every.join(scores.select("query_id", "doc_id", "node_id"), ["query_id", "doc_id", "node_id"], "left_anti")
    return scores.unionByName(others.withColumn("score", F.lit(0.0)))


def tier1_selected(scores: DataFrame, threshold: float = 0.1, fallback: int = 3) -> DataFrame:
    """FLT-5, TOP-1: scores of at least ``threshold`` by (query, document); without any, the ``fallback`` best, ties in reading order.

    ``scores`` are those of ``with_zeros`` where nodes without a shared token can be among the best.
    """
    by = Window.partitionBy("query_id", "doc_id")
    rows = scores.withColumn("best", F.max("score").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "preorder")))
    return rows.where((F.col("score") >= threshold) | ((F.col("best") < threshold) & (F.col("rank") <= fallback))).drop("best", "rank")


def tier2(queries: DataFrame, nodes: DataFrame, selected: DataFrame, threshold: float = 0.25, budget: int = 80, keep: int = 8, fallback: int = 3) -> DataFrame:
    """SRCH-3: breadth-first inspection below the selected nodes, level by level.

    ``nodes`` also has parent_id and title. A node at or above ``threshold``
    is a candidate and its children are inspected; below it they are only if a
    query token stands in the title. At most ``budget`` nodes a (query,
    document) in order of discovery; the best ``keep``, or ``fallback`` of
    those inspected where none is a candidate. Each level is written to the
    shared folder.
    """
    q = queries.select("query_id", T.token_set(F.col("text")).alias("q"))
    info = nodes.select("doc_id", "node_id", T.token_set(F.col("text")).alias("tokens"), T.token_set(F.coalesce("title", F.lit(""))).alias("in_title"))
    tree = nodes.where(F.col("parent_id").isNotNull()).select("doc_id", F.col("parent_id").alias("above"), "node_id", F.col("preorder").alias("child"))
    level = selected.select("query_id", "doc_id", "node_id", F.struct(F.lit(0).alias("place"), F.col("preorder").cast("long").alias("child")).alias("ord"))
    seen, by = None, ["query_id", "doc_id"]
    for depth in count():  # a level below has fewer nodes, or none: each is inspected once
        scored = level.join(info, ["doc_id", "node_id"]).join(q, "query_id")
        scored = scored.select(*by, "node_id", F.lit(depth).alias("depth"), "ord", T.overlap(F.col("q"), F.col("tokens")).alias("score"), F.arrays_overlap("q", "in_title").alias("titled"))
        place = F.row_number().over(Window.partitionBy(*by).orderBy("ord", "node_id"))
        scored = scored.withColumn("place", place)
        if seen is not None:
            used = seen.groupBy(*by).agg(F.count("*").alias("used"))
            scored = scored.join(used, by, "left").where(F.col("place") + F.coalesce("used", F.lit(0)) <= budget).drop("used")
        else:
            scored = scored.where(F.col("place") <= budget)
        scored = cut(scored, "tier2")  # else the plan doubles with each level
        opened = scored.where((F.col("score") >= threshold) | F.col("titled"))
        seen = scored if seen is None else seen.unionByName(scored)
        children = opened.select(*by, F.col("node_id").alias("above"), "place").join(tree, ["doc_id", "above"]).select(*by, "node_id", F.struct("place", F.col("child").cast("long").alias("child")).alias("ord"))
        level = children.join(seen.select(*by, "node_id"), [*by, "node_id"], "left_anti")
        if level.isEmpty():
            break
    order = Window.partitionBy(*by).orderBy(F.desc("hit"), F.desc("score"), "depth", "place")
    ranked = seen.withColumn("hit", F.col("score") >= threshold).withColumn("any", F.max("hit").over(Window.partitionBy(*by))).withColumn("rank", F.row_number().over(order))
    kept = ranked.where((F.col("hit") & (F.col("rank") <= keep)) | (~F.col("any") & (F.col("rank") <= fallback)))
    return kept.select(*by, "node_id", F.col("score").alias("confidence"), F.col("rank").cast("int").alias("rank"))


def affinity_split(nodes: DataFrame, affinity: DataFrame, threshold: float = 0.8) -> DataFrame:
    """FLT-3: nodes whose affinity to a query cluster bypasses tier 1."""
    return nodes.join(affinity.where(F.col("score") >= threshold), ["doc_id", "node_id"], "left_semi")


def seed_prune(children: DataFrame, seeds: DataFrame) -> DataFrame:
    """FLT-4: (node_id, descendant) of root children; kept if the child or any descendant is a seed; all if there are no seeds."""
    own = children.join(seeds.select("node_id"), "node_id", "left_semi").select("node_id")
    below = children.join(seeds.select(F.col("node_id").alias("descendant")), "descendant", "left_semi").select("node_id")
    unseeded = children.join(F.broadcast(seeds.select(F.lit(1).alias("_any")).limit(1)), F.lit(True), "left_anti").select("node_id")  # one row
    return own.union(below).union(unseeded).distinct()


def retrieve(candidates: DataFrame, nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """RET-1, JN-1, PRJ-2: the text of each candidate's page range, sections in order; candidates without text go."""
    ranges = candidates.join(nodes.select("doc_id", "node_id", "title", "start_page", "end_page"), ["doc_id", "node_id"])
    rows = ranges.join(sections, "doc_id").where(F.col("page_number").between(F.col("start_page"), F.col("end_page")))
    keys = [c for c in candidates.columns if c not in ("doc_id", "node_id")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "section_id", "content"))), lambda x: x["content"]), "\n")
    chunks = rows.groupBy("doc_id", "node_id", *keys, "title", "start_page", "end_page").agg(text.alias("content"))
    return chunks.where(F.col("content") != "").withColumn("pages", F.concat_ws("-", F.col("start_page").cast("string"), F.col("end_page").cast("string")))


def answer(chunks: DataFrame, k: int = 5, length: int = 260) -> DataFrame:
    """ANS-1, FN-18, AGG-14: a bullet a chunk of the first ``k`` by rank, and the mean of their confidences."""
    top = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id", "node_id"))).where(F.col("_n") <= k)
    bullet = F.concat(F.lit("- "), F.substring("content", 1, length), F.lit(" ("), F.col("title"), F.lit(", pages "), F.col("pages"), F.lit(")"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", bullet.alias("b")))), lambda x: x["b"]), "\n")
    return top.groupBy("query_id").agg(F.concat(F.lit("Based on the retrieved sections:\n"), joined).alias("answer"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("n_sources"))
