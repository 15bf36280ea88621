"""The registered queries of this subpackage, one an operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import decontaminate, exact_topk, lang_id, license_scan, ngram_join, oracles, packing, pii, pitman_yor, token_output, toxicity
from foliomill.llm.common import id_crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_output.token_table(spark, table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learnt from those not held out."""
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc_mod("doc_id", 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    rated = toxicity.rate(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return rated.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: four-word shingles, Jaccard 0.85."""
    return ngram_join.join(table(spark, sf_dir, "documents"), k=4, percent=85, count_links=False)


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc_mod("doc_id", 4) == 2
    model = lang_id.train(docs, ~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return lang_id.classify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every hundredth vector, among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of up to 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_license_scan": op2_license_scan,
    "op3_pii": op3_pii,
    "op4_exact_topk": op4_exact_topk,
    "op5_decontaminate": op5_decontaminate,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_join": op9_ngram_join,
    "op10_lang_id": op10_lang_id,
    "op6_packing": op6_packing,
}
ORACLES: dict[str, str] = {
    "op2_license_scan": oracles.LICENSE,
    "op3_pii": oracles.PII,
    "op4_exact_topk": oracles.TOP_K,
    "op5_decontaminate": oracles.LEAKS,
    "op9_ngram_join": oracles.NEAR,
}
