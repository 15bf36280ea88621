"""Sections: page-numbered pieces of documents, and their token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T


def split_sections(docs: DataFrame, separator: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """SRC-1 / SRC-10: stripped, non-empty pieces between ``separator`` (a pattern), numbered after filtering."""
    pieces = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), separator), T.strip), lambda x: x != "")
    rows = docs.select(F.col(doc).alias("doc_id"), F.posexplode_outer(pieces).alias("at", "content")).where(F.col("content").isNotNull())
    page = (F.col("at") + 1).cast("int")
    return rows.select("doc_id", F.format_string("sec_%04d", page).alias("section_id"), page.alias("page_number"), "content")


def lines(docs: DataFrame) -> DataFrame:
    """SRC-10: one section a line, as transcripts have them."""
    return split_sections(docs, "\\R")


def paragraphs(docs: DataFrame) -> DataFrame:
    """SRC-1: one section a paragraph."""
    return split_sections(docs, "\n\n")


def budgets(sections: DataFrame, limit: int = 80_000) -> DataFrame:
    """AGG-3, FLT-12: words a document and whether it is admitted."""
    rows = sections.groupBy("doc_id").agg(F.sum(T.word_budget(F.col("content")).cast("long")).alias("n_words"), F.count("*").alias("n_sections"))
    return rows.withColumn("admitted", F.col("n_words") <= limit)


def keywords(texts: DataFrame, k: int = 4, least: int = 4) -> DataFrame:
    """AGG-4, TOP-11: the k commonest tokens of ``least`` characters, ties by first place."""
    found = texts.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("at", "token")).where(F.length("token") >= least)
    counts = found.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", F.col("rank").cast("int").alias("rank"), "token", "n")


def adjacent_similarity(sections: DataFrame) -> DataFrame:
    """WIN-1: token-set Jaccard of each section with the one before."""
    tokens = T.token_set(F.col("content"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "section_id")
    rows = sections.select("doc_id", "page_number", "section_id", tokens.alias("own")).withColumn("before", F.lag("own").over(order)).where(F.col("before").isNotNull())
    return rows.select("doc_id", "section_id", F.round(T.jaccard(F.col("before"), F.col("own")), 6).alias("similarity"))


def tabular_lines(docs: DataFrame, least: int = 2) -> DataFrame:
    """SRC-5b: runs of at least ``least`` lines with two blanks and a digit are tables; cells end at two blanks."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.contains("line", F.lit("  ")) & F.col("line").rlike("[0-9]"))
    run = F.col("at") - F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    cells = F.filter(F.transform(F.split("line", "  "), T.strip), lambda x: x != "")
    marked = rows.withColumn("run", run).withColumn("cells", F.array_join(cells, " | "))
    tables = marked.groupBy("doc_id", "run").agg(F.count("*").alias("n_lines"), F.min("at").alias("first_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "cells"))), lambda x: x["cells"]), "\n").alias("content"))
    return tables.where(F.col("n_lines") >= least).select("doc_id", F.col("first_line").cast("int").alias("first_line"), "n_lines", "content")


def column_stats(table: DataFrame) -> DataFrame:
    """SRC-8a: of each column the non-blank values and the distinct ones, in one pass; blanks around values don't count."""
    value = lambda c: F.nullif(T.strip(F.col(c).cast("string")), F.lit(""))
    long = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in table.columns])).alias("x")).select("x.*")
    # Two levels, so that neither many values nor many repeats meet in one task.
    each = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return each.groupBy("column").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_blank"), F.count("value").alias("n_distinct"))


def preview(table: DataFrame, order: list[str], rows: int = 25) -> DataFrame:
    """SRC-8/9: a schema section and the first rows as ``column=value`` text."""
    names = table.columns
    schema = table.sparkSession.range(1).select(F.lit("schema").alias("type"), F.lit(0).alias("page_number"), F.lit("columns: " + ", ".join(names)).alias("content"))
    shown = table.orderBy(*order).limit(rows).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    pairs = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names])
    return schema.unionByName(shown.select(F.lit("row").alias("type"), F.col("_n").cast("int").alias("page_number"), pairs.alias("content")))


def windowed_groups(sections: DataFrame, budget: int = 280, least: int = 2, threshold: float = 0.18) -> DataFrame:
    """WIN-2: a fold over a document's sections cuts a group when it is long enough, or unlike what follows under another heading."""
    has = "heading" in sections.columns
    row = F.struct("page_number", "section_id", T.token_set(F.col("content")).alias("tokens"), T.word_budget(F.col("content")).alias("words"), (F.lower("heading") if has else F.lit("")).alias("heading"))
    docs = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    start = F.struct(F.lit(0).alias("group"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("words"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        def of(rows: Column) -> Column:
            now, then = F.get(rows, i), F.get(rows, i - 1)
            unlike = (T.jaccard(then["tokens"], now["tokens"]) < threshold) & (acc["size"] >= least) & (then["heading"] != now["heading"])
            cut = (acc["size"] > 0) & (unlike | (acc["words"] >= budget))
            group = acc["group"] + F.when(cut, 1).otherwise(0)
            return F.struct(group.alias("group"), F.when(cut, 1).otherwise(acc["size"] + 1).alias("size"), (F.when(cut, F.lit(0).cast("long")).otherwise(acc["words"]) + now["words"]).alias("words"), F.array_append(acc["out"], group).alias("out"))

        return of(F.col("s"))

    folded = F.aggregate(F.sequence(F.lit(0), F.size("s") - 1), start, step, lambda acc: acc["out"])
    pairs = docs.select("doc_id", F.explode(F.arrays_zip(F.transform("s", lambda x: x["section_id"]).alias("section_id"), folded.alias("group"))).alias("x"))
    return pairs.select("doc_id", "x.section_id", "x.group")
