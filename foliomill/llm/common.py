"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the setting is absent and the master is local, as in tests, a
    temporary folder is made; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and executors share")
    base = tempfile.mkdtemp(prefix="foliomill-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/foliomill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def input_parts(df: DataFrame) -> int:
    """Partitions to deal ``df`` to: grows with its input splits."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, df.rdd.getNumPartitions())


def whole_text(column: str = "text") -> Column:
    """The text as it stands; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def id_crc(value: object) -> int:
    """The same crc32 on the Python side."""
    return zlib.crc32(b"" if value is None else str(value).encode())


#: Bits of an id filter: one megabyte, whatever the input.
FILTER_BITS = 1 << 23


def flag_ids(docs: DataFrame, ids: DataFrame, flag: str, column: str = "doc_id") -> DataFrame:
    """``docs`` with a boolean column: false only where ``column`` is surely not in ``ids`` (doc_id, bigint; null is an id too).

    Few rows are true besides those in ``ids``, so an exact join on what is
    flagged moves little of the texts.
    """
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(c.cast("long"), F.lit(-(2**63)))), F.lit(FILTER_BITS))
    bucket, spot, held = (f"{flag}_{x}" for x in ("bucket", "spot", "held"))
    marked = ids.select((place(F.col("doc_id")) + 1).alias("p"))
    filters = marked.groupBy(F.call_function("bitmap_bucket_number", F.col("p")).alias(bucket)).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("p"))).alias(held))
    placed = docs.withColumn(spot, place(F.col(column))).withColumn(bucket, F.floor(F.col(spot) / 32768) + 1)
    joined = placed.join(F.broadcast(filters), bucket, "left")
    byte = F.conv(F.hex(F.substr(held, (F.floor(F.col(spot) % 32768 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(flag, F.coalesce(F.getbit(byte, (F.col(spot) % 8).cast("int")) == 1, F.lit(False))).drop(bucket, spot, held)


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ``column`` is not in ``ids`` (doc_id, bigint); null matches null."""
    flag, key = "_listed", "_id"
    while flag in docs.columns:
        flag += "_"
    while key in docs.columns:
        key += "_"
    flagged = flag_ids(docs, ids, flag, column)
    listed = ids.select(F.col("doc_id").cast("long").alias(key)).distinct()
    rest = flagged.where(flag).join(listed, F.col(column).cast("long").eqNullSafe(F.col(key)), "left_anti")
    return flagged.where(~F.col(flag)).select(*docs.columns).unionByName(rest.select(*docs.columns))


def small_batches(df: DataFrame, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """``df``, after seeing to it that Arrow batches stay small, in rows and bytes (two session settings, which nothing else reads)."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = int(conf.get(name).rstrip("b"))
        if held > most or held <= 0:
            conf.set(name, str(most))
    return df


_OWNER: list[str] = []
_CLEAR: dict[str, Callable[[], None]] = {}


def keeps_cache(owner: str, clear: Callable[[], None]) -> None:
    """Names what frees an operator's cache in a worker."""
    _CLEAR[owner] = clear


def begins(owner: str) -> None:
    """Called in a worker as an operator begins there: workers are used again, and other operators' caches go."""
    if _OWNER != [owner]:
        for other, clear in _CLEAR.items():
            if other != owner:
                clear()
        _OWNER[:] = [owner]
        gc.collect()
        release()


def release() -> None:
    """Gives memory that a worker has freed back to the system; an idle worker would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may be another
        ctypes.CDLL(None).malloc_trim(0)
