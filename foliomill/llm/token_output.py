"""Operator 1: token ids in Simple-8b word-aligned blocks.

A block holds whole documents in ascending doc_id order. Its ids are replaced
by their rank among the block's repeated ids (1 is the most frequent), ids that
occur once by the escape 0, and the ranks are packed into 64-bit words: four
bits select how many values of which width the other 60 bits hold. Escaped ids
stand in a list of their own, and the words of each 512 ids are counted. Each block names its first id's place in the
part and the ids of each document, so that a reader decodes any block alone
and with array operations only.

The container is Parquet written by Spark: a lost task is simply run again,
and half-written files are never seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import tokens
from foliomill.llm.common import input_parts, new_path, small_batches, whole_text

#: Widths in bits and counts of values of the fourteen selectors.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = tuple(60 // w for w in WIDTHS)
#: Codes between two offsets into a block's words, and the zeros that a stride's last word may reach into.
STRIDE, SPARE = 512, 60

FILE_SCHEMA = (
    "part int, block int, start long, n_ids long, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "ranked binary, escapes binary, sizes binary, words binary"
)


def _windows(bits: np.ndarray, n: int) -> dict[int, np.ndarray]:
    """For each count of COUNTS: the largest width among so many values from each of ``n`` places, by row."""
    made = {1: bits}

    def of(k: int) -> np.ndarray:
        if k not in made:
            half = (k + 1) // 2
            low, wide = of(half), bits.shape[1] - k + 1
            made[k] = np.maximum(low[:, :wide], low[:, k - half : k - half + wide])
        return made[k]

    return {k: of(k)[:, :n] for k in COUNTS}


def _rows(values: np.ndarray) -> np.ndarray:
    """``values`` in rows of STRIDE, zeros up to there and in SPARE more columns."""
    m = -(-len(values) // STRIDE)
    out = np.zeros((m, STRIDE + SPARE), values.dtype)
    flat = np.zeros(m * STRIDE, values.dtype)
    flat[: len(values)] = values
    out[:, :STRIDE] = flat.reshape(m, STRIDE)
    return out


def pack(codes: np.ndarray, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of unsigned codes below 2**60 (and, if known, their widths), and the words of each STRIDE codes.

    No word spans two strides, so all strides are packed, and read, side by side.
    """
    if bits is None:
        bits = np.maximum(np.frexp(codes.astype(np.float64))[1], 1).astype(np.uint8)
    grid = _rows(codes)
    m = len(grid)
    windows = _windows(_rows(bits), STRIDE)
    choice = np.full((m, STRIDE), len(WIDTHS) - 1, np.uint8)
    for k in range(len(WIDTHS) - 2, -1, -1):
        choice[windows[COUNTS[k]] <= WIDTHS[k]] = k
    counts, flat = np.array(COUNTS, np.int64), choice.ravel()
    row = np.arange(m)
    at, until = np.zeros(m, np.int64), np.minimum(STRIDE, len(codes) - row * STRIDE)
    rows, places = [], []
    while len(row):
        rows.append(row)
        places.append(at)
        at = at + counts[flat[row * STRIDE + at]]
        on = at < until[row]
        row, at = row[on], at[on]
    rows = np.concatenate([np.zeros(0, np.int64), *rows])
    order = np.argsort(rows.astype(np.uint16 if m < 65536 else np.int64), kind="stable")
    rows, places = rows[order], np.concatenate([np.zeros(0, np.int64), *places])[order]
    chosen, padded = flat[rows * STRIDE + places], grid.ravel()
    begin = rows * (STRIDE + SPARE) + places
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen):
        here = np.flatnonzero(chosen == k)
        some, word = begin[here], np.zeros(len(here), np.uint64)
        for i in range(COUNTS[k]):
            word |= padded[some + i].astype(np.uint64) << np.uint64(i * WIDTHS[k])
        words[here] |= word
    return words, np.bincount(rows, minlength=m).astype("<u2")


def unpack(words: np.ndarray, sizes: np.ndarray, n: int, kind: type = np.uint64) -> np.ndarray:
    """The ``n`` codes of Simple-8b words, ``sizes`` words a stride."""
    m = len(sizes)
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array(COUNTS, np.int64)[chosen]
    before = np.cumsum(counts) - counts
    first = np.cumsum(sizes.astype(np.int64)) - sizes
    rows = np.repeat(np.arange(m), sizes)
    begin = before - before[first][rows] + rows * (STRIDE + SPARE) if m else before
    out = np.zeros(m * (STRIDE + SPARE), kind)
    for k in np.unique(chosen):
        here = np.flatnonzero(chosen == k)
        some, places, mask = words[here], begin[here], np.uint64((1 << WIDTHS[k]) - 1)
        for i in range(COUNTS[k]):
            out[places + i] = (some >> np.uint64(i * WIDTHS[k])) & mask
    return out.reshape(m, STRIDE + SPARE)[:, :STRIDE].ravel()[:n]


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Ranked ids, escaped ids, words a stride and words of a block of unsigned 32-bit ids."""
    if len(ids) and int(ids.max()) < 1 << 20:  # tables by id are faster than a sort
        counts = np.bincount(ids)
        values, back = np.arange(len(counts), dtype=np.uint32), ids
    else:
        values, back, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 1]
    rank = np.zeros(len(values), np.uint32)
    rank[order] = np.arange(1, len(order) + 1)
    width = np.maximum(np.frexp(rank.astype(np.float64))[1], 1).astype(np.uint8)
    codes = rank[back]
    words, sizes = pack(codes, width[back])
    return values[order].astype("<u4").tobytes(), ids[codes == 0].astype("<u4").tobytes(), sizes.tobytes(), words.astype("<u8").tobytes()


def decode_block(ranked: bytes, escapes: bytes, sizes: bytes, words: bytes, n: int) -> np.ndarray:
    """The ids of a block."""
    codes = unpack(np.frombuffer(words, "<u8"), np.frombuffer(sizes, "<u2"), n, np.uint32)
    table = np.concatenate([np.zeros(1, np.uint32), np.frombuffer(ranked, "<u4")])
    ids = table[codes]
    ids[codes == 0] = np.frombuffer(escapes, "<u4")
    return ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, block_ids: int = 1 << 18) -> None:
    """Encodes every whole text and writes the blocks to ``path``, in ascending doc_id order.

    Null texts are empty; null ids stand first; rows of equal id stay together
    in any order. Other columns are ignored. Parts are dealt by ranges of
    doc_id, so one hot source, key or group of copies spreads like any other.
    A block closes once it holds ``block_ids`` ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        start = block = held = 0
        docs_in, buffers = [], []

        def flush() -> pa.RecordBatch:
            nonlocal start, block, held, docs_in, buffers
            ids = np.frombuffer(b"".join(buffers), "<u4")
            ranked, escapes, sizes, words = encode_block(ids)
            row = {"part": part, "block": block, "start": start, "n_ids": len(ids), "doc_ids": docs_in, "doc_tokens": [len(x) // 4 for x in buffers], "ranked": ranked, "escapes": escapes, "sizes": sizes, "words": words}
            start, block, held, docs_in, buffers = start + len(ids), block + 1, 0, [], []
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in tokens.chunks(texts):
                for doc, ids in zip(doc_ids[at : at + len(some)], coder.batch(some), strict=True):
                    docs_in.append(doc)
                    buffers.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= block_ids:
                        yield flush()
        if docs_in:
            yield flush()

    rows = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))
    dealt = rows.repartitionByRange(input_parts(rows), "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "none").parquet(path)


ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("ranked", pa.binary()), ("escapes", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())]
)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32 (and ids).

    Only one row a part, its number of ids, comes to the driver.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    first, at = {}, 0
    for row in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        first[row.part] = at
        at += row.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["ranked"], r["escapes"], r["sizes"], r["words"], r["n_ids"])
                sizes = np.array(r["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                data = ids.astype("<u4").tobytes()
                columns = [
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(first[r["part"]] + r["start"] + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(memoryview(data)[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends, strict=True)], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(np.split(ids.astype(np.int64), ends[:-1]), pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return files.drop("block").mapInArrow(decode, schema)


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads them back."""
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
