"""State: keyed tables as plain DataFrames, differences between versions, feedback counters, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """DML-1: rows of ``changes`` replace those of equal key."""
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*target.columns))


def add_up(target: DataFrame, changes: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """DML-2: additive upsert."""
    return target.unionByName(changes).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DML-3, WIN-7: the last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") == 1).drop("_n")


def delete_keys(table: DataFrame, gone: DataFrame, columns: list[str], key: str) -> DataFrame:
    """DML-5, DML-6: rows none of whose ``columns`` is a deleted key."""
    for column in columns:
        table = table.join(gone.select(F.col(key).alias(column)), column, "left_anti")
    return table.select(*table.columns)


def section_hash(content: Column, *more: Column) -> Column:
    """FN-12: equal for equal sections."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (*more, content)]))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """JN-6, SET-1: keys with change_type added, removed or changed, by a full outer join on hashes."""
    a, b = old.select(*keys, F.col("hash").alias("_a")), new.select(*keys, F.col("hash").alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, keys, "full_outer").withColumn("change_type", kind).where(F.col("change_type").isNotNull()).select(*keys, "change_type")


def reindex_plan(changes: DataFrame, sizes: DataFrame, most: float = 0.5) -> DataFrame:
    """RIX-1: by document, partial or full, from changed pages over sections; documents without changes don't appear."""
    counts = changes.groupBy("doc_id").agg(F.countDistinct("page_number").alias("n_changed"))
    ratio = F.col("n_changed") / F.greatest(F.lit(1), F.col("n_sections"))
    return counts.join(sizes, "doc_id").select("doc_id", "n_changed", "n_sections", F.when(ratio <= most, "partial").otherwise("full").alias("mode"))


def affected(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """FLT-11: nodes whose page range holds a changed page."""
    return nodes.join(pages.select(F.col("doc_id").alias("_d"), "page_number"), (F.col("_d") == F.col("doc_id")) & F.col("page_number").between(F.col("start_page"), F.col("end_page")), "left_semi")


def counters(events: DataFrame) -> DataFrame:
    """AGG-5: visits and uses of each node (doc_id, node_id, visited, used), with both rates.

    A rate of visits is over the document's events, at most 1; of uses, over visits.
    """
    each = events.groupBy("doc_id", "node_id").agg(F.sum(F.col("visited").cast("long")).alias("visits"), F.sum(F.col("used").cast("long")).alias("uses"))
    totals = events.groupBy("doc_id").agg(F.count("*").alias("events"))
    return each.join(totals, "doc_id").select(
        "doc_id", "node_id", "visits", "uses",
        F.round(F.least(F.lit(1.0), F.col("visits") / F.col("events")), 6).alias("visit_rate"),
        F.round(F.least(F.lit(1.0), F.col("uses") / F.greatest(F.lit(1), F.col("visits"))), 6).alias("utility_rate"),
    )


def misleading(rates: DataFrame, visit: float = 0.6, utility: float = 0.2) -> DataFrame:
    """FLT-9: often visited, seldom used."""
    return rates.where((F.col("visit_rate") >= visit) & (F.col("utility_rate") <= utility))


def affinity(events: DataFrame) -> DataFrame:
    """AGG-6: a node's used events over all events, by document and query cluster."""
    hits = events.where("used").groupBy("doc_id", "node_id", "cluster").agg(F.count("*").alias("hits"))
    totals = events.groupBy("doc_id", "cluster").agg(F.count("*").alias("total"))
    return hits.join(totals, ["doc_id", "cluster"]).select("doc_id", "node_id", "cluster", F.round(F.col("hits") / F.col("total"), 6).alias("score"))


def trigger(events: DataFrame, window: int = 200, every: int = 5) -> DataFrame:
    """FLT-10: documents with a multiple of ``every`` events among the latest ``window``."""
    recent = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(window)
    return recent.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") >= every) & (F.col("n") % every == 0))


def kpis(results: DataFrame) -> DataFrame:
    """AGG-7..9: accuracy, coverage, p95 latency (lower index), mean cost and cache hits of (correct, cited, latency_ms, tier1_calls, tier2_calls, cache_hit).

    The percentile counts latencies first, so only distinct ones are ranked.
    """
    mean = lambda c: F.avg(c.cast("double"))
    cost = F.col("tier1_calls") * 0.0001 + F.col("tier2_calls") * 0.0006
    whole = results.agg(
        F.count("*").alias("n"), F.round(mean(F.col("correct")), 4).alias("intent_accuracy"), F.round(mean(F.col("cited")), 4).alias("citation_coverage"),
        F.round(F.avg(cost), 6).alias("avg_cost_usd"), F.round(mean(F.col("cache_hit")), 4).alias("cache_hit_rate"),
    )
    by = results.groupBy("latency_ms").agg(F.count("*").alias("c"))
    upto = by.withColumn("upto", F.sum("c").over(Window.orderBy("latency_ms")))
    p95 = upto.join(F.broadcast(whole.select("n"))).where(F.col("upto") > F.floor(0.95 * (F.col("n") - 1))).agg(F.min("latency_ms").cast("double").alias("p95_latency_ms"))
    return whole.join(F.broadcast(p95))
