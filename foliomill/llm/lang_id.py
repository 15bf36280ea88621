"""Operator 10: language identification with string kernels.

The kernel of two texts is the number of byte n-grams (n = 1 to 3, lower case,
hashed to ``dims`` slots) present in both, over the root of the product of
their own counts: a blended-spectrum presence kernel. Landmarks drawn from the
labelled sample span a Nystrom approximation, and one ridge regression a
language against the rest is solved in it. Scoring multiplies batches of
presence vectors by the landmarks and by the coefficients.

The model is fitted on the driver from at most ``most_rows`` labelled rows,
``per_lang`` a language; its size does not depend on the input. Every row is
scored on the executors, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from foliomill.llm.common import begins, small_batches

UNKNOWN = "und"


@dataclass
class Model:
    """Languages, landmarks (one presence vector a row), their counts and the coefficients."""

    langs: list[str]
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    dims: int


def presence(texts: list[str], dims: int) -> np.ndarray:
    """One row of 0 and 1 a text: the hashed n-grams of one to three bytes that occur in it."""
    out, bits = np.zeros((len(texts), dims), np.float32), 32 - (dims.bit_length() - 1)
    for row, text in zip(out, texts, strict=True):
        code = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        row[(code * np.uint32(2654435761)) >> np.uint32(bits)] = 1
        for n in (2, 3):
            if len(code) > 1:
                code = (code[:-1] << np.uint32(8) | code[1:] & np.uint32(255)) & np.uint32(0xFFFFFF)
                row[((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(bits)] = 1
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    own = np.maximum(x.sum(axis=1), 1)
    return (x @ landmarks.T) / np.sqrt(own[:, None] * sizes[None, :])


def fit(rows: list[tuple[str, np.ndarray]], dims: int, landmarks: int, ridge: float) -> Model:
    """The model of labelled presence vectors."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros((0, dims), np.float32), np.zeros(0, np.float32), np.zeros((0, 0), np.float32), dims)
    each = {lang: [x for at, x in rows if at == lang] for lang in langs}
    chosen = np.stack([x for lang in langs for x in each[lang][: max(1, landmarks // len(langs))]])
    sizes = np.maximum(chosen.sum(axis=1), 1)
    values, vectors = np.linalg.eigh(kernel(chosen, chosen, sizes).astype(np.float64))
    held = values > 1e-6 * values.max()
    whiten = vectors[:, held] / np.sqrt(values[held])
    z = kernel(np.stack([x for _, x in rows]), chosen, sizes) @ whiten
    goal = np.array([[1.0 if lang == at else -1.0 for lang in langs] for at, _ in rows])
    share = np.array([1 / len(each[at]) for at, _ in rows])[:, None]  # languages count alike
    solved = np.linalg.solve(z.T @ (z * share) + ridge * np.eye(z.shape[1]), z.T @ (goal * share))
    return Model(langs, chosen, sizes.astype(np.float32), (whiten @ solved).astype(np.float32), dims)


def train(docs: DataFrame, learn_from: object, dims: int = 4096, landmarks: int = 192, per_lang: int = 500, most_rows: int = 4000, ridge: float = 1e-3) -> Model:
    """Fits on rows where the condition ``learn_from`` holds, lang is not null and the text has a letter.

    Of each language the ``per_lang`` rows of smallest hashed doc_id and text
    are taken (fewer where ``most_rows`` would be passed); repeated rows count
    once, ids may be null or shared, empty texts teach nothing, very long ones
    are one vector of presence like others. No such rows: a model that knows
    no language.
    """
    rows = docs.where(learn_from & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("draw")
    )
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], dims, landmarks, ridge)
    each = max(1, min(per_lang, most_rows // len(counts)))
    # A hash threshold that leaves somewhat more than is needed; the surplus is cut below.
    most = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, (1.5 * each + 20) / n) * (1 << 30)))])
    drawn = rows.where((F.col("draw") < most[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                bits = np.packbits(presence(texts[at : at + 256], dims).astype(bool), axis=1)
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x.tobytes() for x in bits], pa.binary())], names=["lang", "draw", "bits"])

    packed = small_batches(drawn).mapInArrow(pack, "lang string, draw long, bits binary")
    # Repeated rows are drawn together or not at all, and count once.
    once = packed.groupBy("lang", "draw").agg(F.min("bits").alias("bits"))
    found = sorted((r.lang, r.draw, bytes(r.bits)) for r in once.collect())
    kept, seen = [], dict.fromkeys(counts, 0)
    for lang, _, bits in found:
        if seen[lang] < each:
            seen[lang] += 1
            kept.append((lang, np.unpackbits(np.frombuffer(bits, np.uint8))[:dims].astype(np.float32)))
    return fit(kept, dims, landmarks, ridge)


def classify(docs: DataFrame, model: Model, lang_column: str = "lang_pred", score_column: str = "lang_score") -> DataFrame:
    """Every row of ``docs`` with its columns, the predicted language and a score from 0 to 1.

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything where the model knows no language; of equal scores the first
    language by name wins. Very long texts are read whole. Repeated rows,
    null ids and further columns pass unchanged; columns named like the new
    ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    base = docs.drop(lang_column, score_column)
    mark = "_has_letter"
    while mark in base.columns:
        mark += "_"
    source = base.withColumn(mark, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*base.schema.fields, StructField(lang_column, StringType()), StructField(score_column, DoubleType())])
    at_text = base.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("lang_id")
        m = held.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = part.column(at_text).to_pylist()
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                some = [i for i, ok in enumerate(part.column(part.num_columns - 1).to_pylist()) if ok]
                if some and m.langs:
                    out = kernel(presence([texts[i] for i in some], m.dims), m.landmarks, m.sizes) @ m.weights
                    best = out.argmax(axis=1)
                    likely = np.exp(4 * (out - out.max(axis=1, keepdims=True)))
                    sure = likely.max(axis=1) / likely.sum(axis=1)
                    for i, k, s in zip(some, best.tolist(), sure.tolist(), strict=True):
                        langs[i], scores[i] = m.langs[k], min(1.0, s)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs), pa.array(scores)], names=schema.names)

    return small_batches(source).mapInArrow(score, schema)
