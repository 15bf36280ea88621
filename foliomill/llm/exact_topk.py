"""Operator 4: exact top-k inner products over a vector-approximation file.

The file holds blocks of vectors: the exact integer vectors and, for each
component, the number of its cell (``cells`` equal cells between the block's
least and greatest value), one byte each. For a block of queries and a block
of vectors the cells' centres give, in one matrix product, bounds that the
exact score lies between. Exact vectors are then read in the order of their
upper bounds, until the k-th best exact score is above the bound of the next:
no later vector can be among the k.

Queries meet all blocks, block by block. A task keeps the k best of each of
its queries, so what leaves it is k rows a query; those are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.common import written

BLOCK = "dim int, n int, block long, ids binary, exact binary, low binary, step binary, codes binary"
_LIMIT = 2**28


def scaled(docs: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) with each component floor(scale * x); rows with a null id or vector, or a component that is null or not finite, are left out."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = docs.where(F.col(id_column).isNotNull() & x.isNotNull()).where(finite)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("vector"))


def blocks(vectors: DataFrame, size: int, cells: int = 256) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length, with their cells."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, rows = waiting.pop(dim)
            exact = np.array(rows, np.float64).reshape(len(ids), dim)
            low = exact.min(axis=0)
            step = np.maximum((exact.max(axis=0) - low) / cells, 1e-9)
            codes = np.clip((exact - low) / step, 0, cells - 1).astype(np.uint8)
            row = {"dim": dim, "n": len(ids), "block": int(ids[0]), "ids": np.array(ids, np.int64).tobytes(), "exact": exact.astype(np.int64).tobytes(), "low": low.tobytes(), "step": step.tobytes(), "codes": codes.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for batch in batches:
            for vec, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = waiting.setdefault(len(values), ([], []))
                ids.append(vec)
                rows.append(np.clip(values, -(2.0**62), 2.0**62))
                if len(ids) >= size:
                    yield flush(len(values))
        for dim in list(waiting):
            yield flush(dim)

    return vectors.mapInArrow(build, BLOCK)


SCHEMA = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in ("ids", "exact", "low", "step", "codes"))])


def _dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    if max(np.abs(rows).max(initial=0), np.abs(query).max(initial=0)) < _LIMIT:
        return rows @ query
    exact = rows.astype(object) @ query.astype(object)
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, without overflow
    return scores[order], ids[order]


def search_block(query_ids: np.ndarray, queries: np.ndarray, row: dict, state: dict, key: int, k: int) -> None:
    """Improves ``state[key + i]``, the (scores, ids) of query i, by a block of vectors."""
    dim, n = row["dim"], row["n"]
    ids = np.frombuffer(row["ids"], np.int64)
    exact = np.frombuffer(row["exact"], np.int64).reshape(n, dim)
    low, step = np.frombuffer(row["low"]), np.frombuffer(row["step"])
    codes = np.frombuffer(row["codes"], np.uint8).reshape(n, dim)
    # score = low.q + sum (code + 1/2) step q, give or take half a step in each component
    steps = queries * step
    middle = steps @ (codes.T + 0.5) + (queries @ low)[:, None]
    radius = np.abs(steps).sum(axis=1) / 2
    slack = 1e-9 * (np.abs(middle).max(axis=1, initial=0) + np.abs(queries) @ np.abs(low) + radius) + 1e-6
    upper = middle + (radius + slack)[:, None]
    for i, own in enumerate(query_ids):
        scores, found = state.get(key + i, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        bound = upper[i]
        if len(scores) >= k:
            near = np.flatnonzero(bound >= scores[-1])
        else:
            near = np.arange(n)
        near = near[ids[near] != own]
        if len(scores) < k and len(near) > 4 * k:
            # What is below the k-th best lower bound of the candidates can't be among the k.
            kth = np.partition(bound[near], len(near) - k)[len(near) - k] - 2 * (radius[i] + slack[i])
            near = near[bound[near] >= kth]
        near = near[np.argsort(-bound[near], kind="stable")]
        at = 0
        while at < len(near) and (len(scores) < k or bound[near[at]] >= scores[-1]):
            some = near[at : at + 4 * k]
            at += 4 * k
            scores, found = best(np.concatenate([scores, _dot(exact[some], queries[i].astype(np.int64))]), np.concatenate([found, ids[some]]), k)
        state[key + i] = (scores, found)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", block: int = 2048, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k rows of ``vectors`` of highest score, all if fewer.

    The score is the inner product of the components, each floor(scale * x).
    Ties go to the smaller id. Rows with the query's own id are no candidates.
    Rows with a null id or vector, or with a null or non-finite component,
    take no part; vectors of different lengths have no score together.
    Repeated query rows are answered once each, in the same way; repeated
    candidates count each. Other columns are ignored; no rows, no result.
    Scores beyond 64 bits are cut to the largest 64-bit number.
    """
    index = written(blocks(scaled(vectors, scale, id_column, vector_column), block), "cells")
    asked = written(blocks(scaled(queries, scale, id_column, vector_column), query_block), "queries")
    asked = asked.select("dim", F.col("n").alias("q_n"), F.monotonically_increasing_id().alias("q_block"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"))
    pairs = asked.crossJoin(index.withColumnRenamed("dim", "v_dim")).where(F.col("dim") == F.col("v_dim"))  # blocks, not rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        asked_ids: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, ids in asked_ids.items():
                rows = [(key + i, q, *state[key + i]) for i, q in enumerate(ids) if key + i in state]
                sizes = [len(r[2]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([r[j] for r in rows], sizes).astype(np.int64)) for j in (0, 1)] + [pa.array(np.concatenate([r[j] for r in rows])) for j in (3, 2)],
                    names=["key", "query_id", "vec_id", "score"],
                )
            state.clear()
            asked_ids.clear()

        for batch in batches:
            for r in batch.to_pylist():
                key = r["q_block"] * query_block
                if key not in asked_ids and len(state) > 50_000:
                    yield from out()
                asked_ids[key] = np.frombuffer(r["q_ids"], np.int64)
                queries = np.frombuffer(r["q_exact"], np.int64).reshape(r["q_n"], r["dim"]).astype(np.float64)
                search_block(asked_ids[key], queries, r, state, key, k)
        yield from out()

    found = pairs.mapInArrow(run, "key long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
