"""The engine: indexes corpora into a store, answers batches of queries, extracts by example."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import adaptive, extract, graph, multi, search, sections, sessions, state, structured, tree
from foliomill.operators.llm_hooks import Client
from foliomill.operators.store import Store

TABLES = ("documents", "sections", "nodes", "entities", "edges")


class Engine:
    """Everything over a store; each call is one batch for any number of documents or queries."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def index(self, rows: DataFrame, limit: int = 80_000) -> DataFrame:
        """RIX-1 and the first indexing: sections (doc_id, section_id, page_number, content[, heading]) of new or changed documents.

        Documents over the word budget are refused; unchanged ones keep their
        version. Returns doc_id and status: indexed, unchanged or refused.
        """
        rows = rows.withColumn("hash", state.section_hash(F.col("content"), F.col("page_number")))
        admitted = sections.budgets(rows, limit)
        known = self.store.read("sections").select("doc_id", "section_id", "hash") if self.store.current("sections") else rows.select("doc_id", "section_id", "hash").limit(0)
        own = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
        changed = state.diff(own, rows, ["doc_id", "section_id"]).select("doc_id").distinct().withColumn("changed", F.lit(True))
        status = admitted.join(changed, "doc_id", "left").select("doc_id", F.when(~F.col("admitted"), "refused").when(F.col("changed"), "indexed").otherwise("unchanged").alias("status"))
        status = self.spark.read.parquet(self._written(status, "status"))
        new = rows.join(status.where("status = 'indexed'").select("doc_id"), "doc_id", "left_semi")
        nodes = tree.build(new)
        text = self._node_text(nodes, new)
        self.store.replace_documents("sections", new)
        self.store.replace_documents("nodes", text)
        found = self._entities(nodes, new)
        self.store.replace_documents("entities", found)
        self.store.replace_documents("edges", self._edges(text, self._entities(nodes, new, T.cross_references), found))
        self.store.replace_documents("documents", tree.stats(nodes).join(admitted.select("doc_id", "n_words", "n_sections"), "doc_id"))
        return status

    def _written(self, df: DataFrame, name: str) -> str:
        self.store.save(name, df)
        return self.store.current(name)[1]

    @staticmethod
    def _node_text(nodes: DataFrame, rows: DataFrame) -> DataFrame:
        """Summaries (FN-15) of nodes from the text of their pages."""
        joined = nodes.join(rows.select("doc_id", "page_number", "section_id", "content"), "doc_id").where(F.col("page_number").between(F.col("start_page"), F.col("end_page")))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "section_id", "content"))), lambda x: x["content"]), "\n")
        full = joined.groupBy(*[c for c in nodes.columns if c not in ("first", "last")]).agg(body.alias("body"))
        summary = T.summary(F.col("title"), F.col("start_page"), F.col("end_page"), F.expr("cast(array() as array<string>)"), F.col("body"))
        return full.withColumn("summary", summary).withColumn("text", F.concat_ws(" ", "title", "summary")).drop("body")

    @staticmethod
    def _entities(nodes: DataFrame, rows: DataFrame, kind: Callable[[Column], Column] = lambda text: F.array_union(T.entities(text), T.cross_references(text))) -> DataFrame:
        """ENT-1: entities of sections, at the last leaf over their page (JN-2)."""
        leaves = tree.leaf_of_page(rows.select("doc_id", "page_number").distinct(), nodes)
        found = rows.select("doc_id", "page_number", F.explode(kind(F.col("content"))).alias("entity"))
        return found.join(leaves, ["doc_id", "page_number"]).select("doc_id", "entity", "node_id").distinct()

    @staticmethod
    def _edges(nodes: DataFrame, xrefs: DataFrame, entities: DataFrame) -> DataFrame:
        """GRF-2 within documents; references (JN-4) go to the nodes of the same document that hold the entity."""
        key = lambda c: F.concat_ws(":", F.col("doc_id").cast("string"), F.col(c))
        keyed = nodes.select("doc_id", "preorder", "text", key("node_id").alias("node_id"), F.when(F.col("parent_id").isNotNull(), key("parent_id")).alias("parent_id"))
        named = lambda rows: rows.select(key("node_id").alias("node_id"), key("entity").alias("reference"))
        every = graph.elaborates(keyed).unionByName(graph.references(named(xrefs), named(entities))).unionByName(graph.temporal(keyed)).unionByName(graph.contradicts(keyed))
        return graph.dedupe(every).withColumn("doc_id", F.split("src", ":")[0].cast("long"))

    def query(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """RTE-1..3 for rows (query_id, text): intent, answer, confidence and number of sources.

        Questions over several documents are answered from the two best ones.
        Graph queries start from the nodes of their entities and take those
        within three hops over edges of the types they ask for (FLT-8); where there is none they are searched like others.
        """
        nodes, rows = self.store.read("nodes"), self.store.read("sections")
        asked = queries.withColumn("intent_type", T.intent(F.col("text"))).withColumn("entities", T.query_entities(F.col("text")))
        mentions = asked.where("intent_type = 'graph'").select("query_id", T.edge_types(F.col("text")).alias("edge_types"), F.explode("entities").alias("entity"))
        seeds = mentions.join(self.store.read("entities"), "entity").select("query_id", "edge_types", F.concat_ws(":", F.col("doc_id").cast("string"), "node_id").alias("node")).distinct()
        walked = graph.bfs(seeds, self.store.read("edges"), 3).select("query_id", F.split("node", ":")[0].cast("long").alias("doc_id"), F.split("node", ":")[1].alias("node_id"), "hops")
        walked = walked.withColumn("confidence", F.lit(0.75)).withColumn("order", F.col("hops").cast("double")).drop("hops")
        plain = asked.join(seeds.select("query_id").distinct(), "query_id", "left_anti")
        leaves = nodes.where("depth > 0")
        top = leaves.where("depth = 1")
        chosen = search.tier1_selected(search.with_zeros(search.tier1_scores(plain, top), plain, top))
        every = search.tier2(plain, leaves, chosen)
        several = asked.where("intent_type = 'multi_doc'")
        found = every.join(several.select("query_id"), "query_id", "left_anti").withColumn("order", -F.col("confidence"))
        both = found.select("query_id", "doc_id", "node_id", "confidence", "order").unionByName(walked.select("query_id", "doc_id", "node_id", "confidence", "order"))
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("order", "doc_id", "node_id"))).where(F.col("rank") <= k).drop("order")
        answers = search.answer(search.retrieve(ranked, nodes, rows), k).unionByName(self._several(several, every, nodes, rows, k))
        none = F.coalesce("answer", F.lit("No relevant content found."))
        return asked.join(answers, "query_id", "left").select("query_id", "intent_type", none.alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))

    @staticmethod
    def _several(asked: DataFrame, found: DataFrame, nodes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """RTE-2: one answer of the two best documents, each of which is searched by itself."""
        apart = found.join(asked.select("query_id"), "query_id", "left_semi")
        places = multi.best(multi.document_scores(apart)).select("query_id", "doc_id", "place")
        own = apart.join(places.drop("place"), ["query_id", "doc_id"]).select(F.struct("query_id", "doc_id").alias("query_id"), "doc_id", "node_id", "confidence", "rank").where(F.col("rank") <= k)
        chunks = search.retrieve(own, nodes, rows)
        answers = search.answer(chunks, k).select("query_id.query_id", "query_id.doc_id", "answer", "confidence").join(places, ["query_id", "doc_id"])
        sources = chunks.select("query_id.query_id", "doc_id", "node_id", "rank").join(places, ["query_id", "doc_id"])
        told = multi.merged(asked.select("query_id", "text"), answers, sources)
        return told.select("query_id", "answer", "confidence", F.size("source_nodes").cast("long").alias("n_sources"))

    def ask(self, turns: DataFrame, k: int = 5) -> DataFrame:
        """SNK-3, DML-11, FN-10: answers to rows (query_id, session_id, asked_at, text), kept as results and as turns of their sessions.

        A follow-up is rewritten after the turns of its session held and those of this batch before it.
        """
        held = self.store.read("sessions") if self.store.current("sessions") else None
        own = turns.select("session_id", "asked_at", F.coalesce("text", F.lit("")).alias("original_query"), "query_id")
        empty = own.select("session_id", F.lit(0).cast("long").alias("turn_id")).limit(0)
        new = sessions.numbered(held if held is not None else empty, own)
        past = held.join(new.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "turn_id", "original_query") if held is not None else None
        run = new.select("session_id", "turn_id", "original_query")
        run = run if past is None else run.unionByName(past)
        rewritten = search.analyse(run.select(F.col("session_id").alias("conv_id"), F.col("turn_id").alias("turn"), F.lit("user").alias("role"), F.col("original_query").alias("text")))
        new = new.join(rewritten.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), "rewritten_query"), ["session_id", "turn_id"])
        told = self.query(new.select("query_id", F.col("rewritten_query").alias("text")), k)
        told = self.spark.read.parquet(self._written(told, "batch"))
        self.store.upsert("results", told, ["query_id"])
        turn = new.join(told.select("query_id", "answer"), "query_id").select("session_id", "turn_id", "asked_at", "original_query", "rewritten_query", "answer")
        self.store.append("sessions", turn)
        return told

    def feedback(self, events: DataFrame) -> None:
        """SNK-4: adds rows (doc_id, node_id, visited, used)."""
        self.store.append("feedback", events.select("doc_id", "node_id", "visited", "used"))

    def adapt(self, at: float) -> DataFrame:
        """ADP-1, ADP-2: all feedback onto the nodes; misleading ones are queued and those that wait longest get new summaries.

        Returns the misleading nodes.
        """
        nodes = self.store.read("nodes")
        queue = self.store.read("queue") if self.store.current("queue") else adaptive.enqueued(nodes, F.lit(at)).limit(0)
        renewed, misled, after = adaptive.update(nodes, self.store.read("feedback"), queue, self.store.read("sections"), F.lit(at))
        renewed = renewed.withColumn("text", F.concat_ws(" ", "title", "summary"))
        rates = misled.select("doc_id", "node_id", "visit_rate", "utility_rate")
        rates = self.spark.read.parquet(self._written(rates, "misleading"))
        self.store.save("metrics", renewed.select("doc_id", "node_id", "visits", "uses", "visit_rate", "utility_rate"))
        self.store.save("nodes", renewed.select(*nodes.columns))
        self.store.save("queue", after)
        return rates

    def extract(self, examples: DataFrame) -> DataFrame:
        """EXT-4: occurrences of example texts in all sections."""
        return extract.literal(self.store.read("sections"), examples)

    def extract_with(self, run_id: str, make_client: Callable[[], Client] | None, description: str, examples: list[structured.Example], passes: int = 1) -> DataFrame:
        """EXT-1, SNK-5: structured extraction from all sections, kept as a run that replaces one of its name."""
        found = structured.structured(self.store.read("sections"), make_client, description, examples, passes).withColumn("run_id", F.lit(run_id))
        if self.store.current("extractions"):
            found = self.store.read("extractions").where(F.col("run_id") != run_id).unionByName(found)
        self.store.save("extractions", found)
        return self.store.read("extractions").where(F.col("run_id") == run_id)

    def delete(self, gone: DataFrame) -> None:
        """DML-6."""
        self.store.delete_documents(TABLES, gone)

    def health(self) -> dict[str, object]:
        """OPS-2."""
        held = self.store.current("documents")
        return {"ok": True, "documents": self.store.read("documents").count() if held else 0}
