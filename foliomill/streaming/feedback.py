"""The feedback log as a stream: windows, deduplication and triggered updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, doc_id long, node_id string, visited boolean, used boolean"


def read(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Events as they are appended below a path."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event_id once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Visits and uses by node and window (tumbling, or sliding by ``slide``)."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    sums = events.withWatermark("ts", late).groupBy(span, "doc_id", "node_id").agg(F.count_if("visited").alias("visits"), F.count_if("used").alias("uses"))
    return sums.select(F.col("window.start").alias("start"), "doc_id", "node_id", "visits", "uses")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events by document and session."""
    counts = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "doc_id").agg(F.count("*").alias("events"))
    return counts.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "doc_id", "events")


def triggered(events: DataFrame, checkpoint: str, counts: str, update: Callable[[DataFrame], None], every: int = 5) -> StreamingQuery:
    """Calls ``update`` with the documents whose count of events passes a multiple of ``every``.

    Counts by document and batch are kept below ``counts``; a batch that is
    run again replaces its own.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{counts}/batch={number}_")
        seen = rows.sparkSession.read.schema("doc_id long, n long, batch string").option("recursiveFileLookup", "true").parquet(counts).select("doc_id", "n", F.col("_metadata.file_path").alias("f"))
        now = F.contains("f", F.lit(f"batch={number}_"))
        sums = seen.groupBy("doc_id").agg(F.sum(F.when(now, 0).otherwise(F.col("n"))).alias("before"), F.sum("n").alias("after"))
        update(sums.where(F.floor(F.col("after") / every) > F.floor(F.col("before") / every)).select("doc_id"))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
