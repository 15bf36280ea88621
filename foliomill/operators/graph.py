"""The typed graph: edges from a node table, merging and walking.

Node tables have doc_id, node_id, preorder and text; edges have src, dst,
edge_type, weight and ord, the order of emission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T

# Weights by edge type, and the order of emission.
WEIGHTS = {"ELABORATES": 0.95, "REFERENCES": 0.8, "TEMPORALLY_FOLLOWS": 0.55, "TEMPORALLY_FOLLOWS_YEAR": 0.8, "CONTRADICTS": 0.6}
EMISSION = {"ELABORATES": 1, "REFERENCES": 2, "TEMPORALLY_FOLLOWS": 3, "TEMPORALLY_FOLLOWS_YEAR": 4, "CONTRADICTS": 5, "CROSS_DOC_SIMILAR": 6}


def _edge(src: Column, dst: Column, kind: str, weight: Column | None = None) -> list[Column]:
    name = kind.removesuffix("_YEAR")
    return [src.alias("src"), dst.alias("dst"), F.lit(name).alias("edge_type"), (F.lit(WEIGHTS[kind]) if weight is None else weight).alias("weight"), F.lit(EMISSION[kind]).alias("ord")]


def elaborates(nodes: DataFrame) -> DataFrame:
    """GRF-1: parent to child."""
    return nodes.where(F.col("parent_id").isNotNull()).select(*_edge(F.col("parent_id"), F.col("node_id"), "ELABORATES"))


def references(xrefs: DataFrame, targets: DataFrame) -> DataFrame:
    """JN-4: (node_id, reference) to nodes that hold the same reference; never to itself."""
    other = targets.select(F.col("node_id").alias("dst"), "reference")
    return xrefs.join(other, "reference").where(F.col("node_id") != F.col("dst")).select("node_id", "dst").distinct().select(*_edge(F.col("node_id"), F.col("dst"), "REFERENCES"))


def temporal(nodes: DataFrame) -> DataFrame:
    """WIN-3, WIN-4: neighbours in reading order, and neighbours among nodes with a year if it doesn't fall."""
    order = Window.partitionBy("doc_id").orderBy("preorder")
    following = nodes.select("node_id", F.lead("node_id").over(order).alias("next")).where(F.col("next").isNotNull())
    dated = nodes.withColumn("year", T.latest_year(F.col("text"))).where(F.col("year").isNotNull())
    dated = dated.select("node_id", "year", F.lead("node_id").over(order).alias("next"), F.lead("year").over(order).alias("next_year")).where(F.col("next_year") >= F.col("year"))
    return following.select(*_edge(F.col("node_id"), F.col("next"), "TEMPORALLY_FOLLOWS")).unionByName(dated.select(*_edge(F.col("node_id"), F.col("next"), "TEMPORALLY_FOLLOWS_YEAR")))


def contradicts(nodes: DataFrame) -> DataFrame:
    """WIN-5: neighbours that share a token, one of them negative and the other positive."""
    order = Window.partitionBy("doc_id").orderBy("preorder")
    tokens = F.filter(T.token_set(F.col("text")), lambda x: F.length(x) >= 3)
    pairs = nodes.select("node_id", "doc_id", "preorder", tokens.alias("a")).select("node_id", "a", F.lead("node_id").over(order).alias("next"), F.lead("a").over(order).alias("b"))
    has = lambda c, listed: F.arrays_overlap(c, F.array(*map(F.lit, listed)))
    a, b = F.col("a"), F.col("b")
    opposed = (has(a, T.NEGATIVE_TOKENS) & has(b, T.POSITIVE_TOKENS)) | (has(b, T.NEGATIVE_TOKENS) & has(a, T.POSITIVE_TOKENS))
    return pairs.where(F.col("next").isNotNull() & F.arrays_overlap("a", "b") & opposed).select(*_edge(F.col("node_id"), F.col("next"), "CONTRADICTS"))


def similar_sparse(vectors: DataFrame, threshold: float = 0.45) -> DataFrame:
    """JN-5: cosine of unit vectors with few non-zero components: an equi-join on the component instead of all pairs."""
    parts = vectors.select("doc_id", "node_id", F.posexplode("vector").alias("dim", "v")).where(F.col("v") != 0)
    a, b = (parts.select(F.col("doc_id").alias(f"{x}_doc"), F.col("node_id").alias(f"{x}_node"), "dim", F.col("v").alias(f"{x}_v")) for x in "ab")
    pairs = a.join(b, "dim").where(F.col("a_doc") < F.col("b_doc"))
    scored = pairs.groupBy("a_node", "b_node").agg(F.round(F.sum(F.col("a_v") * F.col("b_v")), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    return scored.select(*_edge(F.col("a_node"), F.col("b_node"), "CROSS_DOC_SIMILAR", F.col("cosine")))


def similar_dense(vectors: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """JN-5 for dense unit vectors (vec_id, embedding): all pairs a < b whose cosine, to six places, is ``threshold`` or more, blocks of rows at a time.

    Rows are dealt to blocks by hashed id; every pair of blocks is one row of
    the join and one matrix product in a task of its own.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    n = vectors.count()
    count = max(1, -(-n // block))
    dealt = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("block"))
    # Each block goes to the row and column of the grid of block pairs it takes part in.
    left = dealt.select("*", F.explode(F.sequence(F.col("block"), F.lit(count - 1))).alias("other")).select(F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "vec_id", "embedding")
    right = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("other")).select(F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "vec_id", "embedding")

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[rows.side == s] for s in (0, 1))
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": "int64", "b": "int64"})
        scores = np.stack(a.embedding) @ np.stack(b.embedding).T
        same = rows.i.iloc[0] == rows.j.iloc[0]
        x, y = np.nonzero(scores >= threshold - 1e-6)  # what rounding may raise to the threshold stays
        p, q = a.vec_id.to_numpy()[x], b.vec_id.to_numpy()[y]
        keep = p < q if same else p != q
        return pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "cosine": scores[x, y][keep]})

    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("cosine", DoubleType())])
    return left.unionByName(right).groupBy("i", "j").applyInPandas(products, schema).select("a", "b", F.round("cosine", 6).alias("cosine")).where(F.col("cosine") >= threshold)


def dedupe(edges: DataFrame, collapse_parallel: bool = False) -> DataFrame:
    """DST-2: the first weight of each (src, dst, type); with ``collapse_parallel`` one edge a pair, the last type."""
    first = F.row_number().over(Window.partitionBy("src", "dst", "edge_type").orderBy("ord", "weight"))
    kept = edges.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")
    if collapse_parallel:
        last = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("ord")))
        kept = kept.withColumn("_n", last).where(F.col("_n") == 1).drop("_n")
    return kept


def bfs(seeds: DataFrame, edges: DataFrame, max_hops: int = 3, edge_types: list[str] | None = None) -> DataFrame:
    """GRF-4, JN-7: nodes within ``max_hops`` out-edges of each query's seeds, with the least number of hops.

    ``seeds``: query_id, node and, where queries follow edges of their own
    types, edge_types. The loop is bounded, and each level joins only what the
    level before found for the first time.
    """
    own = [c for c in ("edge_types",) if c in seeds.columns]
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(*edge_types))
    steps = edges.select(F.col("src").alias("node"), "dst", *[F.col("edge_type") for _ in own]).distinct()
    found = frontier = seeds.select("query_id", "node", *own).distinct().withColumn("hops", F.lit(0))
    for hop in range(1, max_hops + 1):
        reached = frontier.join(steps, "node")
        if own:
            reached = reached.where(F.array_contains("edge_types", F.col("edge_type")))
        new = reached.select("query_id", F.col("dst").alias("node"), *own).distinct()
        frontier = new.join(found.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("hops", F.lit(hop))
        found = found.unionByName(frontier)
    return found.drop(*own)
