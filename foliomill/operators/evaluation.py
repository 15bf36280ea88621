"""Evaluation: cases, their results, the dashboard, release gates, and structured logs."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import state

#: The bounds of a release, by measure; the first two are least values, the others most.
LEAST = {"intent_accuracy": 0.0, "citation_coverage": 0.0}
MOST = {"p95_latency_ms": 2000.0, "avg_cost_usd": 0.01}


def cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: (case_no, query, expected_keywords, intent) of a JSON list, in its order; a case without a query is an error."""
    shape = "array<struct<query: string, expected_keywords: array<string>, intent: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", shape, {"mode": "FAILFAST"})).alias("case_no", "x"))
    query = F.when(F.col("x.query").isNull(), F.raise_error(F.lit("a case has no query"))).otherwise(F.col("x.query"))
    return rows.select("case_no", query.alias("query"), F.coalesce("x.expected_keywords", F.expr("cast(array() as array<string>)")).alias("expected_keywords"), F.coalesce("x.intent", F.lit("single_doc")).alias("intent"))


def paired(asked: DataFrame, results: DataFrame) -> DataFrame:
    """JN-11: cases (case_no, intent) and results (case_no, intent_type, n_sources, ...) side by side; one without the other is an error.

    Adds correct and cited to the results.
    """
    both = asked.select("case_no", "intent", F.lit(True).alias("_asked")).join(results.withColumn("_told", F.lit(True)), "case_no", "full_outer")
    alone = F.col("_asked").isNull() | F.col("_told").isNull()
    correct = F.when(alone, F.raise_error(F.lit("a case lacks its result or a result its case")).cast("boolean")).otherwise(F.col("intent").eqNullSafe(F.col("intent_type")))
    return both.withColumn("correct", correct).withColumn("cited", F.coalesce("n_sources", F.lit(0)) > 0).drop("_asked", "_told", "intent")


def dashboard(results: DataFrame) -> DataFrame:
    """AGG-7..9: one row of measures, mean latency among them."""
    mean = results.agg(F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"))
    return state.kpis(results).withColumnRenamed("n", "total_eval_cases").join(F.broadcast(mean))  # both one row


def gates(measures: DataFrame, least: dict[str, float] | None = None, most: dict[str, float] | None = None) -> DataFrame:
    """FLT-13: (gate, value, bound, passed) of each bound on a dashboard row; no value passes none."""
    low, high = {**LEAST, **(least or {})}, {**MOST, **(most or {})}
    each = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.coalesce(F.col(k) >= b, F.lit(False)).alias("passed")) for k, b in low.items()]
    each += [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.coalesce(F.col(k) <= b, F.lit(False)).alias("passed")) for k, b in high.items()]
    return measures.select(F.inline(F.array(*each)))


def write_json(measures: DataFrame, path: str | Path) -> dict[str, Any]:
    """SNK-7: the one row of measures as a JSON file of the driver."""
    row = measures.first().asDict()
    Path(path).write_text(json.dumps(row, indent=2), encoding="utf-8")
    return row


class Log:
    """SNK-8: events as JSON lines."""

    def __init__(self, name: str = "foliomill"):
        self._log = logging.getLogger(name)

    def info(self, event: str, **fields: Any) -> None:
        self._log.info("%s", json.dumps({"timestamp": datetime.now(tz=UTC).isoformat(), "level": "info", "event": event} | fields, default=str))

    @contextmanager
    def span(self, event: str, **fields: Any) -> Iterator[str]:
        """Logs a start and an end, which has the duration, under one trace id."""
        trace, begun = uuid.uuid4().hex[:12], time.monotonic()
        self.info(event + "_start", trace_id=trace, **fields)
        try:
            yield trace
        finally:
            self.info(event + "_end", trace_id=trace, duration_ms=int(1000 * (time.monotonic() - begun)), **fields)
