"""Summary trees: pre-order node tables of a document's page ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T

NODES = "doc_id long, node_id string, parent_id string, preorder int, depth int, title string, start_page int, end_page int, first int, last int"


ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[x.split()[1]]) for x in NODES.split(", ")])


def grow(sections: list[tuple[int, str, int, set[str], str]], title: str, budget: int = 280, least: int = 2, threshold: float = 0.18, most: int = 4) -> list[tuple]:
    """TREE-1, TREE-2: nodes (id, parent, preorder, depth, title, first and last page, first and last section) of sections (page, id, words, tokens, heading).

    Groups are cut when long enough, or where neighbours of different headings
    have little in common; a group over budget or with more than ``most``
    sections is cut again, or halved where that does not divide it.
    """
    nodes: list[tuple] = []

    def cut(a: int, b: int) -> list[tuple[int, int]]:
        out, begin, held = [], a, sections[a][2]
        for i in range(a + 1, b):
            x, y = sections[i - 1], sections[i]
            unlike = i - begin >= least and x[4].lower() != y[4].lower() and (len(x[3] & y[3]) / len(x[3] | y[3]) if x[3] | y[3] else 1.0) < threshold
            if unlike or held >= budget:
                out.append((begin, i))
                begin, held = i, 0
            held += y[2]
        return [*out, (begin, b)]

    def add(a: int, b: int, parent: str | None, depth: int, name: str) -> str:
        node = f"node_{len(nodes):04d}"
        pages = [sections[i][0] for i in range(a, b)]
        nodes.append((node, parent, len(nodes), depth, name, min(pages), max(pages), a, b - 1))
        return node

    def titled(a: int, b: int, other: str) -> str:
        return next((sections[i][4] for i in range(a, b) if sections[i][4].strip()), other)

    # A stack, last first, keeps pre-order without deep recursion.
    root = add(0, len(sections), None, 0, title)
    stack = [(a, b, root, 1, titled(a, b, f"Topic Group {i}")) for i, (a, b) in reversed(list(enumerate(cut(0, len(sections)), 1)))]
    while stack:
        a, b, parent, depth, name = stack.pop()
        node = add(a, b, parent, depth, name if b - a > 1 else titled(a, b, f"Section {sections[a][1]}"))
        if b - a == 1:
            continue
        if sum(sections[i][2] for i in range(a, b)) > budget or b - a > most:
            parts = cut(a, b)
            if len(parts) == 1:
                middle = a + max(1, (b - a) // 2)
                parts = [(a, middle), (middle, b)]
        else:
            parts = [(i, i + 1) for i in range(a, b)]
        stack += [(c, d, node, depth + 1, titled(c, d, f"{name} - Part {i}")) for i, (c, d) in reversed(list(enumerate(parts, 1)))]
    return nodes


def build(sections: DataFrame, **options: float) -> DataFrame:
    """TREE-1 by document; a section's ``heading`` is empty where the column is missing."""
    heading = F.coalesce("heading", F.lit("")) if "heading" in sections.columns else F.lit("")
    # Tokens matter only where headings differ.
    tokens = T.token_set(F.col("content")) if "heading" in sections.columns else F.expr("cast(array() as array<string>)")
    one = F.struct("page_number", "section_id", T.word_budget(F.col("content")).alias("words"), tokens.alias("tokens"), heading.alias("heading"))
    docs = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                listed = [(r["page_number"], r["section_id"], r["words"], set(r["tokens"]), r["heading"]) for r in rows]
                made += [(doc, *node) for node in grow(listed, f"Document {doc}", **options)]
            if made:
                columns = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    return docs.mapInArrow(run, NODES)


def stats(nodes: DataFrame) -> DataFrame:
    """AGG-1: nodes, largest and mean depth by document."""
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 6).alias("avg_depth"))


def quality(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """AGG-2, WIN-9: the share of pages that leaves cover, and of inner nodes whose children are in order."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("start_page", "preorder")
    steps = nodes.where(F.col("parent_id").isNotNull()).withColumn("ok", F.coalesce(F.lag("end_page").over(order) <= F.col("start_page"), F.lit(True)))
    inner = steps.groupBy("doc_id", "parent_id").agg(F.bool_and("ok").alias("ok")).groupBy("doc_id").agg(F.avg(F.col("ok").cast("double")).alias("coherence"))
    covered = nodes.select("doc_id", F.explode(F.sequence("start_page", "end_page")).alias("page_number")).distinct()
    counted = pages.select("doc_id", "page_number").distinct().join(covered.withColumn("in", F.lit(1)), ["doc_id", "page_number"], "left")
    coverage = counted.groupBy("doc_id").agg((F.count("in") / F.count("*")).alias("coverage"))
    return coverage.join(inner, "doc_id", "left").select("doc_id", F.round("coverage", 6).alias("coverage"), F.round(F.coalesce("coherence", F.lit(0.0)), 6).alias("coherence"))


def super_tree(nodes: DataFrame) -> DataFrame:
    """PRJ-1: the documents' roots under one; a root's title names its document, and keys stay (doc_id, node_id)."""
    roots = nodes.where(F.col("parent_id").isNull())
    n = F.row_number().over(Window.orderBy("doc_id"))
    clones = roots.select("doc_id", F.format_string("super_%04d_%s", n, F.col("doc_id").cast("string")).alias("node_id"), F.lit("super_root").alias("parent_id"), F.concat("title", F.lit(" ["), F.col("doc_id").cast("string"), F.lit("]")).alias("title"), F.lit(1).alias("depth"), "start_page", "end_page")
    top = roots.agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page")).select(F.lit(None).cast("long").alias("doc_id"), F.lit("super_root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("All documents").alias("title"), F.lit(0).alias("depth"), "start_page", "end_page")
    return top.unionByName(clones)


def leaf_of_page(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN-2: the last leaf in pre-order over each page, else the root."""
    parents = nodes.select("doc_id", F.col("parent_id").alias("node_id")).where(F.col("node_id").isNotNull()).distinct()
    leaves = nodes.join(parents, ["doc_id", "node_id"], "left_anti").select("doc_id", "node_id", "preorder", "start_page", "end_page")
    joined = pages.alias("p").join(leaves.alias("l"), (F.col("p.doc_id") == F.col("l.doc_id")) & F.col("p.page_number").between(F.col("l.start_page"), F.col("l.end_page")), "left")
    return joined.groupBy("p.doc_id", "p.page_number").agg(F.coalesce(F.max_by("l.node_id", "l.preorder"), F.lit("node_0000")).alias("node_id"))
