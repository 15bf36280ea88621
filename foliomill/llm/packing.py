"""Operator 6: hierarchical multi-length packing.

A document's ids are cut into whole windows of the longest context size, and
its remainder is routed to the tier (1024, 512, 256, 128) whose windows fit it.
Tiers are packed from the longest: each remainder opens a window, its gap takes
the longest waiting pieces of shorter tiers that fit, and the last gap a head
cut from one. What is left of a tier goes to the next. Full windows of each
tier are dealt into step groups of equal token counts.

Packing runs on the rows of each input split, so ids never move between
machines; a split leaves one unfull window at most, which is why padding is
small at any size. Memory: the ids of ``epoch`` remainders.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import tokens
from foliomill.llm.common import small_batches, whole_text

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs pieces (doc, start, ids as bytes, tokens of the document) into windows; ``put`` takes each piece of a full window."""

    def __init__(self, base: int, tiers: tuple[int, ...], step_tokens: int, put):
        self.tiers, self.put = tiers, put
        self.base, self.sequence, self.steps = base, 0, {t: 0 for t in tiers}
        self.step_windows = {t: max(1, step_tokens // t) for t in tiers}
        self.waiting: list[tuple[int, int]] = []  # (length, number), ascending
        self.pieces: list[tuple] = []

    def window(self, tier: int, pieces: list[tuple]) -> None:
        """A window is done: its pieces get their sequence, offset and step group."""
        step = self.steps[tier] // self.step_windows[tier]
        self.steps[tier] += 1
        # Steps of the tiers alternate, so every stretch of steps has all lengths.
        group = self.base + step * len(self.tiers) + self.tiers.index(tier)
        at = 0
        for doc, start, ids, total in pieces:
            self.put((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.base + self.sequence, at, tier, group))
            at += len(ids) // 4
        self.sequence += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, longest = len(ids) // 4, self.tiers[0]
        whole = total - total % longest
        for at in range(0, whole, longest):
            self.window(longest, [(doc, at, ids[4 * at : 4 * (at + longest)], total)])
        if total > whole:
            self.wait((doc, whole, ids[4 * whole :], total))

    def wait(self, piece: tuple) -> None:
        insort(self.waiting, (len(piece[2]) // 4, len(self.pieces)))
        self.pieces.append(piece)

    def take(self, index: int) -> tuple:
        return self.pieces[self.waiting.pop(index)[1]]

    def pack(self, last: bool = False) -> None:
        """Packs what waits; unless ``last``, an unfull window waits on."""
        kept = []
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self.waiting and self.waiting[-1][0] > below:
                window = [self.take(-1)]
                gap = tier - len(window[0][2]) // 4
                while gap and self.waiting:
                    fits = bisect_right(self.waiting, (gap, len(self.pieces)))
                    piece = self.take(fits - 1 if fits else 0)
                    if len(piece[2]) // 4 > gap:
                        doc, start, ids, total = piece
                        piece = (doc, start, ids[: 4 * gap], total)
                        self.wait((doc, start + gap, ids[4 * gap :], total))
                    window.append(piece)
                    gap -= len(piece[2]) // 4
                if gap and not last:
                    kept += window
                elif gap:
                    self.tail(window)
                else:
                    self.window(tier, window)
        self.waiting, self.pieces = [], []
        for piece in kept:
            self.wait(piece)

    def tail(self, window: list[tuple]) -> None:
        """The very last, unfull window: cut into tiers as long as one fills, the rest padded."""
        for tier in self.tiers:
            if sum(len(p[2]) // 4 for p in window) >= tier:
                head, gap = [], tier
                while gap:
                    doc, start, ids, total = window.pop(0)
                    head.append((doc, start, ids[: 4 * gap], total))
                    if len(ids) > 4 * gap:
                        window.insert(0, (doc, start + gap, ids[4 * gap :], total))
                    gap -= len(head[-1][2]) // 4
                self.window(tier, head)
        if window:
            self.window(self.tiers[-1], window)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, tiers: tuple[int, ...] = (1024, 512, 256, 128), step_tokens: int = 8192, epoch: int = 4096, runs: int = 1_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Null and empty texts are the end id alone; null and repeated doc_ids are
    packed row by row like others; other columns are ignored; an empty table
    gives no rows. Tiers are powers of two in descending order; each window is
    full, but for the last of each input split. ``runs`` bounds the encoder's table
    (about 200 bytes each): fewer take less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, rows = tokens.encoder(tokenizer, runs), []
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 36, tiers, step_tokens, rows.append)

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(columns)], names=NAMES)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in tokens.chunks(texts):
                for doc, ids in zip(doc_ids[at : at + len(some)], coder.batch(some), strict=True):
                    packer.add(doc, ids + end)
                if len(packer.waiting) >= epoch:
                    packer.pack()
                if len(rows) >= 20_000:
                    yield out()
        packer.pack(last=True)
        if rows:
            yield out()

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))).mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
