"""The adaptive loop: feedback onto nodes, a queue of summaries to rewrite, their rewriting.

The queue has doc_id, node_id, prompt, status, new_summary and queued_at. Its
order is (queued_at, doc_id, node_id), so enqueuing needs no counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.operators import state


def rated(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """JN-9: nodes with visits, uses and both rates; 0 where nothing was seen."""
    joined = nodes.join(state.counters(events), ["doc_id", "node_id"], "left")
    return joined.fillna(0, ["visits", "uses"]).fillna(0.0, ["visit_rate", "utility_rate"])


def enqueued(misled: DataFrame, at: Column) -> DataFrame:
    """DML-7: rows of the queue for misleading nodes (doc_id, node_id, start_page, end_page)."""
    pages = F.concat_ws("-", F.col("start_page").cast("string"), F.col("end_page").cast("string"))
    prompt = F.concat(F.lit("Rewrite summary for node "), "node_id", F.lit(" to strictly describe pages "), pages, F.lit("."))
    return misled.select("doc_id", "node_id", prompt.alias("prompt"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("new_summary"), at.alias("queued_at"))


def pending(queue: DataFrame, limit: int = 20) -> DataFrame:
    """TOP-9: the oldest rows still queued, a node once."""
    waiting = queue.where("status = 'queued'").groupBy("doc_id", "node_id").agg(F.min("queued_at").alias("queued_at"))
    return waiting.orderBy("queued_at", "doc_id", "node_id").limit(limit)


def rewritten(title: Column, body: Column, length: int = 240) -> Column:
    """FN-17: the title and the begin of the text, blanks squeezed."""
    plain = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.concat(F.coalesce(title, F.lit("")), F.lit(": "), F.when(plain == "", "No textual content available").otherwise(F.substring(plain, 1, length)))


def regenerated(waiting: DataFrame, nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """ADP-2, JN-10, JN-1: (doc_id, node_id, new_summary) of waiting rows whose node is there, from the text of its pages."""
    mine = nodes.select("doc_id", "node_id", "title", "start_page", "end_page").join(F.broadcast(waiting.select("doc_id", "node_id")), ["doc_id", "node_id"])
    held = sections.select("doc_id", "page_number", "section_id", "content")
    inside = F.when(F.col("page_number").between(F.col("start_page"), F.col("end_page")), F.struct("page_number", "section_id", "content"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(inside)), lambda x: x["content"]), " ")
    texts = mine.join(held, "doc_id", "left").groupBy("doc_id", "node_id", "title").agg(body.alias("body"))
    return texts.select("doc_id", "node_id", rewritten(F.col("title"), F.col("body")).alias("new_summary"))


def settled(queue: DataFrame, done: DataFrame) -> DataFrame:
    """DML-7: rows of nodes in ``done`` are done and carry the summary; others stay."""
    fresh = done.select("doc_id", "node_id", F.col("new_summary").alias("_new"))
    joined = queue.join(fresh, ["doc_id", "node_id"], "left")
    mine = F.col("_new").isNotNull() & (F.col("status") == "queued")
    changes = {"status": F.when(mine, "done").otherwise(F.col("status")), "new_summary": F.when(mine, F.col("_new")).otherwise(F.col("new_summary"))}
    return joined.withColumns(changes).select(*queue.columns)


def update(nodes: DataFrame, events: DataFrame, queue: DataFrame, sections: DataFrame, at: Column, limit: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ADP-1: rated nodes with rewritten summaries, the misleading ones, and the queue after this run.

    ``nodes``: doc_id, node_id, title, start_page, end_page, summary.
    """
    rates = rated(nodes, events)
    misled = state.misleading(rates)
    longer = queue.unionByName(enqueued(misled, at))
    fresh = regenerated(pending(longer, limit), nodes, sections)
    renewed = rates.join(fresh, ["doc_id", "node_id"], "left").withColumn("summary", F.coalesce("new_summary", "summary")).drop("new_summary")
    return renewed, misled, settled(longer, fresh)
