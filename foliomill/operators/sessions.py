"""Sessions, keys and the answer cache: tables of state as plain DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import state


def numbered(held: DataFrame, turns: DataFrame) -> DataFrame:
    """DML-11, AGG-15: new turns (session_id, asked_at, original_query, ...) with turn_id, counted on from the session's last one held.

    Turns of one time go by text, a null one as an empty one.
    """
    last = held.groupBy("session_id").agg(F.max("turn_id").alias("_last"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("asked_at", F.coalesce("original_query", F.lit(""))))
    joined = turns.join(last, "session_id", "left")
    return joined.withColumn("turn_id", (F.coalesce("_last", F.lit(0)) + place).cast("long")).drop("_last")


def recent(held: DataFrame, limit: int = 6) -> DataFrame:
    """WIN-6: the latest turns of each session, the last one first by ``recency``."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_id")))
    return held.withColumn("recency", place).where(F.col("recency") <= limit)


def _digest(*parts: Column) -> Column:
    return F.sha1(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _plain(query: Column) -> Column:
    return F.lower(T.strip(query))


def cache_key(doc_id: Column, cluster: Column, query: Column) -> Column:
    """FN-14: the key of a cached answer."""
    return _digest(doc_id, cluster, _plain(query))


def query_key(doc_id: Column, session: Column, query: Column, version: Column) -> Column:
    """FN-14: equal for a query that is asked again of the same version; no session is a hyphen."""
    return _digest(doc_id, F.coalesce(session.cast("string"), F.lit("-")), _plain(query), version)


def action_key(action: Column, doc_id: Column, path: Column, size: Column) -> Column:
    """FN-14: equal for the same action on the same file."""
    return _digest(action, doc_id, path, size)


def cached(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """DML-8: asked (cache_key, doc_id, doc_version, ...) with the value held for just that version; others have no row."""
    return asked.join(cache.select("cache_key", "doc_id", "doc_version", "value"), ["cache_key", "doc_id", "doc_version"])


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """DML-8: rows replace those of equal key, whatever their version."""
    return state.upsert(cache, rows, ["cache_key"])


def invalidated(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """DML-8: without the documents of ``gone``."""
    return state.delete_keys(cache, gone, ["doc_id"], "doc_id")
