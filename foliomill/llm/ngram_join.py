"""Operator 9: n-gram Jaccard join with token-combination prefixes.

The tokens of a text are its distinct word shingles. All texts order them
alike: classes of frequency first, rare before frequent, by hash within a
class. If two texts of n tokens are similar enough, fewer than p = n -
ceil(t n) + 1 of one's tokens are missing in the other, so

* if their first shared token is rare, it stands among the first p tokens of
  both: each rare token there is a key;
* else all tokens they share are frequent. Of the first K = p + p' shared ones
  (p' for the other text), two neighbours have no unshared token of either
  text between them, for there are fewer than p + p' - 1 of those. Both stand
  in the prefix extended to p + K - 1 tokens: there each pair of adjacent
  frequent tokens is a key, a combination of k = 2 tokens.

So every linked pair has a key in common, with as many keys as prefix tokens.
Texts with one set of tokens are one node from the start. A rare token's key
has at most ``rare`` nodes. Keys of frequent combinations can have very many,
which are then near copies for the most part, and no key's nodes are all
paired: first each node meets one anchor, then only nodes of different
components so far meet, where keys are crowded in blocks that are compared in
a task. Before the exact
comparison, parity bitmaps bound the number of tokens two sets differ by.
Links and components are tables throughout; tables that several steps read are
written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliomill.llm.common import begins, flag_ids, keeps_cache, release, small_batches, whole_text, written

SKETCH_BITS = 22
SEGMENTS = 64
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


SCANNED = ["doc_id", "n", "node", "bits", "segment"]


class _Words(dict):
    """64-bit hash of each word; cleared by ``shingles`` when it has grown."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()
keeps_cache("words", _WORDS.clear)


def encoded(column: pa.Array) -> Iterator[bytes]:
    """The texts of a string column as UTF-8, one at a time."""
    for text in column:
        yield text.as_buffer().to_pybytes()


def shingles(text: str | bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words; of all words together if they are fewer; words end at ASCII white space."""
    words = (text if isinstance(text, bytes) else text.encode("utf-8", "replace")).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    begins("words")
    if len(_WORDS) > 100_000:
        _WORDS.clear()
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(k, len(codes))
    mixed = np.full(len(codes) - k + 1, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ codes[i : len(codes) - k + 1 + i]) * np.uint64(_MIX[i % 4])
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with any linked one."""
    return -(-n * percent // 100)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each slot; the slots, a power of two, are half as many as tokens at least, 64 at least."""
    slots = 1 << max(6, (max(1, len(tokens) - 1) // 2).bit_length())
    return np.packbits((np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (slots - 1), minlength=slots) & 1).astype(np.uint8)).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """A lower bound of the number of tokens that only one of two sets has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def keys_of(tokens: np.ndarray, classes: np.ndarray, percent: int, rare_class: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set under which it meets every set linked with it, and how many of its tokens come before.

    None of those before is shared with a set whose first key in common this
    is: before a rare token all tokens, before a combination all rare ones.
    """
    n = len(tokens)
    p = n - needed(n, percent) + 1
    kinds = classes[(tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    order = np.argsort(kinds, kind="stable")  # the tokens are sorted by hash
    tokens, kinds = tokens[order], kinds[order]
    rare = int(np.searchsorted(kinds, rare_class, side="right"))
    keys = tokens[: min(p, rare)]
    before = np.arange(len(keys), dtype=np.int32)
    if rare < p:  # else a set linked by frequent tokens alone would miss p of these
        largest = n * 100 // percent
        p_other = largest - needed(largest, percent) + 1
        extended = tokens[rare : min(n, 2 * p + p_other - 1)]
        if n <= 12:  # so few that the shared ones may be fewer than K: all combinations
            i, j = np.triu_indices(n - rare, 1)
            pairs = tokens[rare:][i] * np.uint64(_MIX[1]) ^ tokens[rare:][j]
        else:
            pairs = extended[:-1] * np.uint64(_MIX[1]) ^ extended[1:]
        singles = tokens[rare:] if n <= 3 else tokens[:0]
        before = np.concatenate([before, np.full(len(pairs) + len(singles), rare, np.int32)])
        keys = np.concatenate([keys, pairs, singles])
    return keys, before


def _scan(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row a text (doc_id, n, node, bits) and at the end the partition's counts of tokens by slot, in segments."""
    counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
            tokens = shingles(text, k)
            node = xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63
            new = len(tokens) and node not in seen
            rows.append((doc, len(tokens), node, bitmap(tokens) if new else None))
            if new:
                seen.add(node)
                np.add.at(counts, (tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.intp), np.uint32(1))
        if rows:
            d, n, x, b = zip(*rows, strict=True)
            none = pa.nulls(len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(b, pa.binary()), none], names=SCANNED)
    _WORDS.clear()
    if counts.any():
        null = pa.nulls(1, pa.int64())
        for segment, part in enumerate(counts.reshape(SEGMENTS, -1)):
            bits = np.minimum(part, 65535).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([null, null, null, pa.array([bits], pa.binary()), pa.array([segment], pa.int32())], names=SCANNED)
    del counts
    release()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of each segment: classes as the bit length of the count."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(bits, "<u2").astype(np.uint64)
            sums[segment] = sums[segment] + part if segment in sums else part
    for segment, total in sums.items():
        kinds = np.frexp(total.astype(np.float64))[1].astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([kinds.tobytes()], pa.binary())], names=["segment", "bits"])


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links reach, for every node of ``links`` (a, b)."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        lowest = both.join(seen, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        stepped = written(labels.join(lowest, "node").select("node", F.least("label", "theirs").alias("label"), F.col("label").alias("before")), "labels")
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(stepped.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "before"), "labels")
        if not new.where(F.col("label") != F.col("before")).limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def join(docs: DataFrame, k: int = 4, percent: int = 85, rare: int = 64, count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id and, with ``count_links``, n_links.

    Texts link when ``100 * |intersection| >= percent * |union|``;
    component_id is the least doc_id that links reach, class_id the least
    doc_id with the same set, n_links the number of other sets that set links
    with. To count them, every pair of sets that may link is compared; for the
    other columns those within one component are left out.
    Null or empty texts have no shingles and are linked with nothing; texts of
    fewer than ``k`` words are one shingle. Rows of equal doc_id are rows of
    their own; a null doc_id is never the least. Other columns are ignored; an
    empty table gives no rows.
    """
    found = groups(docs, k, percent, rare, every=count_links)
    alone = F.col("n") == 0
    own = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return found.select("doc_id", F.col("n").alias("n_shingles"), own("component_id"), own("class_id"), *counted)


def groups(docs: DataFrame, k: int, percent: int, rare: int = 64, every: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, node (its set), label (its component), class_id, component_id; null from label on where n is 0.

    With ``every``, all links are found, not only those that join components, and n_links is their number.
    """
    spark = docs.sparkSession
    texts = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))
    scanned = written(texts.mapInArrow(partial(_scan, k=k), "doc_id long, n long, node long, bits binary, segment int"), "texts")
    sums = scanned.where(F.col("segment").isNotNull()).select("segment", "bits").repartition(SEGMENTS, "segment").mapInArrow(_classes, "segment int, bits binary")
    classes = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS), np.uint8)
    for row in sums.collect():  # a byte a slot: of a fixed size
        classes[row.segment] = np.frombuffer(row.bits, np.uint8)
    held = spark.sparkContext.broadcast(classes.ravel())
    rare_class = rare.bit_length() - 1
    rows = scanned.where(F.col("segment").isNull()).select("doc_id", "n", "node")
    nodes = scanned.where(F.col("bits").isNotNull() & F.col("segment").isNull()).groupBy("node").agg(F.max("n").alias("n"), F.max("bits").alias("bits"), F.min("doc_id").alias("doc_id"))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, ids, sizes, places = [], [], [], []
            for text in encoded(batch.column(1)):
                tokens = shingles(text, k)
                node = xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63
                if len(tokens) and node not in seen:
                    seen.add(node)
                    own, before = keys_of(tokens, held.value, percent, rare_class)
                    own, first = np.unique(own, return_index=True)
                    keys.append(own.view(np.int64))
                    places.append(before[first])
                    ids.append(np.full(len(own), node, np.int64))
                    sizes.append(np.full(len(own), len(tokens), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, sizes, places)], names=["key", "node", "n", "at"])
        _WORDS.clear()
        release()

    # Keys of one node only are of no use; one pass leaves the others.
    posts = texts.mapInArrow(posted, "key long, node long, n int, at int")
    several = posts.groupBy("key").agg(F.min("node").alias("anchor"), F.max("node").alias("last")).where(F.col("anchor") < F.col("last")).select("key", "anchor")
    posts = written(posts.join(several, "key"), "posts")
    small = nodes.select("node", "n", "bits")
    if every:  # each set is a component of its own, so no pair is left out
        labels = nodes.select("node", F.col("node").alias("label"))
    else:
        near = lambda x, y: (100 * F.least(x, y)) >= percent * F.greatest(x, y)
        sizes = nodes.select(F.col("node").alias("anchor"), F.col("n").alias("anchor_n"))
        star = posts.where(F.col("node") != F.col("anchor")).select("anchor", "node", "n").distinct().join(sizes, "anchor").where(near(F.col("n"), F.col("anchor_n"))).select(F.col("anchor").alias("a"), F.col("node").alias("b"))
        links = written(_verified(texts, nodes, _similar(star, small, percent).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), k, percent), "links")
        labels = components(links)
    named = posts.groupBy("key", "node").agg(F.max("n").alias("n"), F.min("at").alias("at"))
    named = written(named.join(labels, "node", "left").select("key", "node", "n", "at", F.coalesce("label", "node").alias("label")), "named")
    mixed = written(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("held")).where(F.col("low") < F.col("high")).select("key", "held"), "mixed")
    few = named.join(mixed.where(F.col("held") <= rare).select("key"), "key", "left_semi")
    members = few.groupBy("key").agg(F.collect_list(F.struct("node", "n", "at", "label")).alias("m"), F.min("node").alias("hub"))  # ``rare`` at most
    crossed = members.repartition("hub").select("m").mapInArrow(partial(_apart, percent=percent), "a long, b long").distinct()
    crowded = _crowds(texts, nodes, named.join(mixed.where(F.col("held") > rare).select("key"), "key", "left_semi"), k, percent, every)
    more = _verified(texts, nodes, _similar(crossed, small, percent), k, percent).select("a", "b").union(crowded)
    links = written(more.distinct() if every else links.select("a", "b").union(more), "links")
    labels = components(links)
    classed = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    # nodes hold one text a partition; the least id of a set needs all rows
    classed = classed.join(rows.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("class_id")), "node")
    least = classed.groupBy("label").agg(F.min("class_id").alias("component_id"))
    found = classed.join(least, "label").select("node", "label", "class_id", "component_id")
    if every:
        degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
        found = found.join(degree, "node", "left")
    return rows.join(written(found, "classes"), "node", "left").select("doc_id", "n", *found.columns)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of least doc_id stays (nulls last, one of equal rows).

    Rows without shingles all stay. Only rows of components with several rows
    are joined with their texts.
    """
    found = written(groups(docs, k, percent), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "node")
    first = found.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("held"), F.min(order).alias("first")).where(F.col("held") > 1)
    members = found.join(first, "label").select("doc_id", "node", (F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node"))).alias("stays")).distinct()
    members = written(members, "members")
    flag, node = "_grouped", "_node"
    while flag in docs.columns or node in docs.columns:
        flag, node = flag + "_", node + "_"
    flagged = flag_ids(docs, members, flag)
    at_text = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(node, LongType())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [xxhash.xxh3_64_intdigest(shingles("" if t is None else str(t), k).tobytes()) - 2**63 for t in batch.column(at_text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=schema.names)
        _WORDS.clear()
        release()

    some = flagged.where(flag).select(*docs.columns).mapInArrow(named, schema)
    keys = members.select(F.col("doc_id").alias(f"{node}_doc"), F.col("node").alias(f"{node}_own"), F.col("stays").alias(flag))
    joined = some.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{node}_doc")) & (F.col(node) == F.col(f"{node}_own")), "left").where(F.coalesce(flag, F.lit(True)))
    one = F.row_number().over(Window.partitionBy("doc_id", node).orderBy("doc_id"))
    kept = joined.withColumn(f"{node}_n", one).where(F.col(flag).isNull() | (F.col(f"{node}_n") == 1))
    return flagged.where(~F.col(flag)).select(*docs.columns).unionByName(kept.select(*docs.columns))


def _similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps leave room for a link."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")) for x in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            ok = [differ(p, q) * (100 + percent) <= (100 - percent) * (m + n) for p, q, m, n in zip(x["a_bits"], x["b_bits"], x["a_n"], x["b_n"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(check, "a long, b long"), "pairs")


def _apart(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of different components that a key could be the first in common of, each pair once a batch.

    Keys of the same texts mostly have the same least node and so come to one task.
    """
    found: dict[tuple[int, int], None] = {}

    def out() -> pa.RecordBatch:
        rows = np.array(list(found), np.int64).reshape(-1, 2)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

    for batch in batches:
        lists = batch.column(0)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        values = lists.flatten()
        node, n, at, label = (values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            i, j = np.triu_indices(end - begin, 1)
            i, j = i + begin, j + begin
            shared = np.minimum(n[i] - at[i], n[j] - at[j])  # at most
            good = (label[i] != label[j]) & (100 * shared >= percent * (n[i] + n[j] - shared))
            x, y = node[i[good]], node[j[good]]
            found.update(dict.fromkeys(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)))
        if len(found) > 200_000:
            yield out()
    if found:
        yield out()


def _crowds(texts: DataFrame, nodes: DataFrame, named: DataFrame, k: int, percent: int, every: bool = False, block: int = 256) -> DataFrame:
    """Links between components, or with ``every`` all links, among the nodes of crowded keys.

    Keys that share nodes form one crowd, so that each pair is met once
    and not under each of its keys. A crowd is dealt to blocks, and two blocks
    are compared in one task: by bitmaps first, then, where the components are
    still apart, by the whole sets.
    """
    hubs = named.groupBy("key").agg(F.min("node").alias("a"))
    crowds = components(named.join(hubs, "key").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct())
    crowds = written(crowds.select("node", F.col("label").alias("crowd")).join(named.select("node", "label").distinct(), "node"), "crowds")
    sets = _sets(texts, nodes, crowds.select("node"), k)
    count = F.ceil(F.col("held") / block).cast("int")
    sized = crowds.groupBy("crowd").agg(F.count("*").alias("held")).select("crowd", count.alias("blocks"))
    dealt = crowds.join(sized, "crowd").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    first = dealt.select("crowd", "node", "label", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    second = dealt.select("crowd", "node", "label", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (rows[rows.side == s].reset_index(drop=True) for s in (0, 1))
        found: list[tuple[int, int]] = []
        if len(x) and len(y):
            parent = {v: v for v in rows.label}

            def root(v: int) -> int:
                while parent[v] != v:
                    parent[v] = v = parent[parent[v]]
                return v

            x_sets, y_sets = ([np.frombuffer(t, np.uint64) for t in part.tokens] for part in (x, y))
            x_bits, y_bits = (np.stack([np.frombuffer(np.packbits((np.bincount((t >> np.uint64(7)).astype(np.int64) & 4095, minlength=4096) & 1).astype(np.uint8)).tobytes(), np.uint64) for t in part]) for part in (x_sets, y_sets))
            y_n = np.array([len(t) for t in y_sets])
            for i, (node, label, tokens) in enumerate(zip(x.node, x.label, x_sets, strict=True)):
                apart = np.bitwise_count(x_bits[i] ^ y_bits).sum(axis=1, dtype=np.int64)
                near = (apart * (100 + percent) <= (100 - percent) * (len(tokens) + y_n)) & (y.label.to_numpy() != label)  # never itself
                for j in np.flatnonzero(near):
                    a, b = root(label), root(y.label[j])
                    if every or a != b:
                        both = len(np.intersect1d(tokens, y_sets[j], assume_unique=True))
                        if 100 * both >= percent * (len(tokens) + y_n[j] - both):
                            parent[a] = b
                            found.append((min(node, y.node[j]), max(node, y.node[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    grid = first.unionByName(second).join(sets, "node")
    return grid.groupBy("crowd", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of the wanted nodes, from one of their texts each.

    Texts are picked by a filter of fixed size; those that it lets through for
    nothing are dropped by the join.
    """
    texts = texts.withColumn("doc_key", F.coalesce("doc_id", F.lit(-(2**63))))
    wanted = written(wanted.distinct().join(nodes.select("node", "doc_id"), "node"), "wanted")
    keys = wanted.select("node", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_key"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(x, k) for x in encoded(batch.column(1))]
            names = [xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 for x in made]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column(0), pa.array([x.tobytes() for x in made], pa.binary())], names=["node", "doc_key", "tokens"])
        _WORDS.clear()
        release()

    made = flag_ids(texts, wanted, "wanted").where("wanted").select("doc_key", "text").mapInArrow(sets, "node long, doc_key long, tokens binary")
    return written(made.join(keys, ["node", "doc_key"], "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")


def _verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets of tokens."""
    one = _sets(texts, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), k)
    a, b = (one.select(F.col("node").alias(x), F.col("tokens").alias(f"{x}_tokens")) for x in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_tokens", "b_tokens").mapInArrow(check, "a long, b long").distinct()
