"""Questions over several documents: which documents, and one answer of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def selected(queries: DataFrame, documents: DataFrame, others: int = 2) -> DataFrame:
    """TOP-5: (query_id, doc_id, place) of each query's seed_doc_id, place 0, and the first ``others`` other documents.

    Only the first ``others`` + 1 documents, a checked handful, meet the queries.
    """
    heads = documents.select("doc_id").distinct().orderBy("doc_id").limit(others + 1)
    near = queries.select("query_id", "seed_doc_id").crossJoin(F.broadcast(heads)).where(F.col("doc_id") != F.col("seed_doc_id"))
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "seed_doc_id").orderBy("doc_id"))).where(F.col("place") <= others)
    seeds = queries.select("query_id", F.col("seed_doc_id").alias("doc_id"), F.lit(0).alias("place"))
    return seeds.unionByName(placed.select("query_id", "doc_id", "place"))


def document_scores(candidates: DataFrame) -> DataFrame:
    """AGG-12: the highest confidence of each document's candidates, by exact key."""
    return candidates.groupBy("query_id", "doc_id").agg(F.max("confidence").alias("score"))


def best(scores: DataFrame, k: int = 2) -> DataFrame:
    """TOP-5: the ``k`` documents of a query with the highest scores, ties to the smaller doc_id, with their ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def merged(queries: DataFrame, answers: DataFrame, sources: DataFrame, most: int = 6) -> DataFrame:
    """RTE-2, AGG-13, TOP-6: one answer a query of its documents' answers.

    ``queries``: query_id, text; ``answers``: query_id, doc_id, place, answer,
    confidence; ``sources``: query_id, doc_id, node_id, place, rank. The last
    line of each answer, in order of place; the mean confidence; the first
    ``most`` sources. Queries without an answer have no row.
    """
    line = F.concat(F.lit("- ["), F.col("doc_id").cast("string"), F.lit("] "), F.element_at(F.split(F.coalesce("answer", F.lit("")), "\n"), -1))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    told = answers.groupBy("query_id").agg(joined.alias("lines"), F.round(F.avg("confidence"), 6).alias("confidence"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "rank", "node_id"))
    first = sources.withColumn("_n", order).where(F.col("_n") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_n", "doc_id", "node_id"))).alias("s"))
    named = first.select("query_id", F.transform("s", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["node_id"].alias("node_id"))).alias("source_nodes"))
    text = F.concat(F.lit("Query: "), F.coalesce("text", F.lit("")), F.lit("\n\nCross-document summary:\n"), "lines")
    return queries.join(told, "query_id").join(named, "query_id", "left").select("query_id", text.alias("answer"), "confidence", "source_nodes")
