"""Operator 5: benchmark decontamination, with DataFrame functions only.

A window of a text is as long as the benchmark item it may copy. Windows that
share no shingle with an item have similarity 0 to it, so only those are
formed that a run of shingles in common begins in, laid over the text where
the item would stand. Their SimHash fingerprints (64 bits, each shingle counted
as often as it occurs) meet those of the items in a multi-index: of
``radius + 1`` blocks of bits, two fingerprints within the radius agree in one
at least, so none is missed. Pairs within the radius are verified by exact
weighted-shingle similarity: the sum of the smaller counts over the sum of the
larger ones.

A text is read once and only windows leave that pass; no group gathers more
than one text's windows of one item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import lower_ascii, whole_text, written
from foliomill.llm.license_scan import WORD

#: Shingles of benchmark items broadcast at once (about 100 bytes each); more are done in several passes.
MOST_BROADCAST = 300_000


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and characters beyond ASCII."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words in order; a shorter text's words are one shingle, no words none."""
    n = F.size(words)
    return (
        F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))
        .when(n > 0, F.array(F.xxhash64(words)))
        .otherwise(F.expr("cast(array() as array<bigint>)"))
    )


def simhash(shingles: Column) -> Column:
    """64-bit SimHash: a bit is set where more than half of the shingles' hashes have it."""
    n = F.size(shingles)

    def bit(acc: Column, b: Column) -> Column:
        ones = F.size(F.filter(shingles, lambda h: F.getbit(h, b) == 1))
        return acc.bitwiseOR(F.when(ones * 2 > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def blocks_of(fingerprint: Column, radius: int) -> Column:
    """The bits of ``radius + 1`` disjoint blocks, each with its number."""
    m = radius + 1
    cuts = [64 * i // m for i in range(m + 1)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.array(*parts)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle lists, a shingle's weight being its count."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h)))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def find(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 20) -> DataFrame:
    """One row per contaminated text and item: doc_id, item_id, start_word, n_words, similarity (of the best window).

    Null and empty texts or items match nothing; a short item is one shingle.
    Rows of equal or null doc_id are reported together; other columns are
    ignored; an empty table gives no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(whole_text()).alias("w")).select("item_id", F.size("w").alias("n_words"), shingles_of(F.col("w"), k).alias("item"))
    items = written(items.withColumn("finger", simhash(F.col("item"))), "items").where(F.size("item") > 0)
    shingles = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-int(shingles) // MOST_BROADCAST))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(whole_text()).alias("w")).select("doc_id", shingles_of(F.col("w"), k).alias("text"))
    found = None
    for turn in range(passes):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn)
        part = _pass(text, some, threshold, radius)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.start")).cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"), F.round("b.similarity", 6).alias("similarity"))


def _pass(text: DataFrame, items: DataFrame, threshold: float, radius: int) -> DataFrame:
    size = F.size("item")
    placed = items.select("item_id", "n_words", size.alias("size"), F.posexplode_outer("item").alias("at", "hash"), "item")
    placed = placed.select("item_id", "n_words", "size", "at", "hash", F.when(F.col("at") > 0, F.get("item", F.col("at") - 1)).alias("before"))
    # "outer": else a filter on the array's size is moved below, where it works out the words again for each shingle.
    here = text.select("doc_id", "text", F.posexplode_outer("text").alias("place", "hash"))
    run_begins = (F.col("at") == 0) | (F.col("place") == 0) | (F.get("text", F.col("place") - 1) != F.col("before"))
    start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("at"), F.size("text") - F.col("size")))
    windows = here.join(F.broadcast(placed), "hash").where(run_begins).select("doc_id", "item_id", "n_words", start.alias("start"), F.slice("text", start + 1, F.col("size")).alias("window"))
    # Written, so that no filter that needs a fingerprint is moved to where the rows are not yet windows.
    windows = written(windows.withColumn("finger", simhash(F.col("window"))), "windows")
    blocked = windows.withColumn("b", F.explode(blocks_of(F.col("finger"), radius)))
    index = items.select("item_id", "item", F.col("finger").alias("item_finger"), F.explode(blocks_of(F.col("finger"), radius)).alias("b"))
    near = blocked.join(F.broadcast(index), ["item_id", "b"]).where(F.bit_count(F.col("finger").bitwiseXOR(F.col("item_finger"))) <= radius)
    # Several blocks can agree: the first one that does stands for the pair.
    agree = F.array_min(F.transform(F.filter(F.zip_with(blocks_of(F.col("finger"), radius), blocks_of(F.col("item_finger"), radius), lambda x, y: F.struct(x["block"].alias("block"), (x["bits"] == y["bits"]).alias("same"))), lambda z: z["same"]), lambda z: z["block"]))
    once = near.where(F.col("b.block") == agree)
    return once.withColumn("similarity", similarity(F.col("window"), F.col("item"))).where(F.col("similarity") >= threshold).select("doc_id", "item_id", "n_words", "start", "similarity")
