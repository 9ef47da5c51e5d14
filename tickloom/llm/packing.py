"""Packing of tokenised documents into sequences of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import body, slices
from tickloom.llm.tokens import CACHED, WordIds
from tickloom.session import pin

#: Sequence lengths, shortest first; tokens of one optimiser step; tasks whose rests are packed together.
TIERS, STEP_TOKENS, TASKS_PER_REST = (256, 512, 1024, 2048), 1 << 15, 64
#: Pieces that wait for a place in a task.
WAITING = 512

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, step_group long, task long, ids binary")
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Packer:
    """Packs pieces of documents into full windows, the longest tier first.

    A document gives whole windows of the longest tier; what is left waits in the shortest tier it
    fits. A window begins with the longest waiting piece of its tier, its gap takes the longest
    pieces that still fit, and when none does, the shortest is cut to close the gap exactly.
    Sequences of a tier are dealt to step groups of equal token counts.
    """

    def __init__(self, space: int, tiers: tuple[int, ...], keep_ids: bool):
        self.space, self.tiers, self.keep_ids = space, tiers, keep_ids
        self.waiting: list[tuple] = []  # (length, number, doc, start, ids, doc_tokens), by length
        self.rows: list[tuple] = []
        self.sequences = self.number = 0
        self.of_tier = dict.fromkeys(tiers, 0)

    def wait(self, doc, start: int, ids: bytes, total: int) -> None:
        self.number += 1
        insort(self.waiting, (len(ids) // 4, self.number, doc, start, ids, total))

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        top = self.tiers[-1] * 4
        for at in range(0, len(ids) - top + 1, top):
            self.seal([(doc, start + at // 4, ids[at:at + top], total)])
        if rest := len(ids) % top:
            self.wait(doc, start + (len(ids) - rest) // 4, ids[-rest:], total)

    def seal(self, parts: list[tuple]) -> None:
        size = sum(len(p[2]) for p in parts) // 4
        n = self.of_tier.get(size, 0)
        self.of_tier[size] = n + 1
        step = (self.space << 32) | (size << 20) | n // max(STEP_TOKENS // size, 1)
        offset = 0
        for doc, start, ids, total in parts:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, (self.space << 32) | self.sequences, offset, size, step, None,
                              ids if self.keep_ids else None))
            offset += len(ids) // 4
        self.sequences += 1

    def window(self, size: int) -> None:
        """Seal one window of ``size`` tokens out of at least as many waiting ones."""
        parts, gap = [], size
        while gap:
            at = bisect_right(self.waiting, gap, key=lambda w: w[0]) - 1
            n, _, doc, start, ids, total = self.waiting.pop(max(at, 0))
            parts.append((doc, start, ids[:gap * 4], total))
            if n > gap:
                self.wait(doc, start + gap, ids[gap * 4:], total)
            gap -= min(n, gap)
        self.seal(parts)

    def settle(self, most: int) -> None:
        """Build windows until at most ``most`` pieces wait or they have too few tokens for any tier."""
        while len(self.waiting) > most:
            held = sum(w[0] for w in self.waiting) if len(self.waiting) <= self.tiers[-1] else self.tiers[-1]
            longest = self.waiting[-1][0]
            fit = [t for t in self.tiers if t <= held]
            if not fit:
                return
            self.window(next((t for t in fit if t >= longest), fit[-1]))

    def finish(self) -> None:
        """Pack everything; the last tokens go into sequences of powers of two, so nothing is padded."""
        self.settle(0)
        while self.waiting:
            self.window(1 << (sum(w[0] for w in self.waiting).bit_length() - 1))

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 10 + [pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def pack(docs: DataFrame, path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, with_ids: bool = True,
         cached: int = CACHED) -> DataFrame:
    """Pack all documents; one row per piece: where it lies in its document and in its sequence.

    ``path`` names a tokenizer file. Every document's ids end with ``end_id``; null text is empty,
    so it is that one id. Each id lies in exactly one piece and each sequence is full: its
    ``sequence_length`` is a tier, or for the last few tokens of a group of tasks a smaller power of
    two. Tasks pack their own rows; what they cannot place (fewer tokens than the shortest tier each)
    meets in groups of ``TASKS_PER_REST`` tasks. A null id stays null; repeated rows are packed as
    often as they occur; no rows give no pieces. ``step_group`` numbers groups of sequences of one
    length and ``STEP_TOKENS`` tokens. A worker keeps ids of at most twice ``cached`` words. ``with_ids`` adds each piece's ids as little-endian 32-bit integers.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at = WordIds(path, cached), TaskContext.get().partitionId()
        packer = Packer(at, tiers, with_ids)
        end = int(end_id).to_bytes(4, "little")
        for part in slices(batches):
            for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1)), strict=True):
                ids += end
                packer.add(doc, 0, ids, len(ids) // 4)
                if len(packer.waiting) > WAITING:
                    packer.settle(WAITING // 2)
            yield packer.take()
        packer.settle(0)
        packer.rows += [(doc, start, n, None, total, None, None, None, None, at, ids) for n, _, doc, start, ids, total in packer.waiting]
        yield packer.take()

    def rest(key, table: pa.Table) -> pa.Table:
        packer = Packer((1 << 24) + key[0].as_py(), tiers, with_ids)
        for r in sorted(table.to_pylist(), key=lambda r: (r["task"], r["doc_id"] is not None, r["doc_id"], r["start"])):
            packer.wait(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        packer.finish()
        return pa.Table.from_batches([packer.take()])

    first = pin(docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(task, SCHEMA))
    open_ = first.filter(F.col("sequence_id").isNull())
    last = open_.withColumn("g", (F.col("task") / TASKS_PER_REST).cast("long")).groupBy("g").applyInArrow(
        lambda key, table: rest(key, table.drop_columns(["g"])), SCHEMA)
    out = first.filter(F.col("sequence_id").isNotNull()).unionByName(last).drop("task")
    return out if with_ids else out.drop("ids")
