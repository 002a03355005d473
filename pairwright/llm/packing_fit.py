"""Best-fit packing by exact complements.

Texts become token pieces of at most `capacity` ids. How they share sequences depends on the number of
pieces of each length alone: at most `capacity` counts, which are all the driver ever sees. The plan
takes the longest piece left, looks its gap up among the sums of one, two or three lengths that are still
available, and uses the combination found for as many sequences as the counts allow. Where nothing fits
exactly, the longest piece that fits goes in (best fit) and the smaller gap is looked up again.

A plan is a list of runs: the pieces of one length whose ranks lie in a range take places in consecutive
sequences. Ranks within a length come from counts per slot, so no task gathers a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.tables import text_slices
from pairwright.llm.words import TEXT_BYTES, TEXTS, word_ids
from pairwright.staging import stage

CAPACITY = 2048
END_ID = 0
#: Pieces of one length and slot that a task numbers.
SLOT_ROWS = 5_000

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every text: `doc_id`, `piece`, `start`, `length`, `ids_crc32` and, if asked, `ids` (packed 32-bit).

    A text's ids end with `END_ID`, so a null or empty text is one piece of one id. Each row of `docs` gives
    its own pieces, also where a doc_id repeats or is null. No rows give no pieces.
    """
    schema = _PIECES.append(pa.field("ids", pa.binary())) if keep_ids else _PIECES
    end, width = np.uint32(END_ID).tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for some, texts in text_slices(batches, "text", TEXTS, TEXT_BYTES):
            out: list[list] = [[] for _ in schema]
            for doc, ids in zip(some.column("doc_id").to_pylist(), words.encode(texts)):
                ids += end
                for piece, start in enumerate(range(0, len(ids), width)):
                    own = ids[start : start + width]
                    row = (doc, piece, start // 4, len(own) // 4, zlib.crc32(own), own)
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(out, schema)], schema=schema
            )
        words.forget()

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(cut, kinds)


@dataclass
class Run:
    """`times * per` pieces of `length` from rank `rank` on: `per` of them in each of `times` sequences from `sequence` on, `offset` ids in."""

    length: int
    rank: int
    times: int
    per: int
    sequence: int
    offset: int


class _Lengths:
    """Pieces left by length, and which lengths have any (bit l of `any`)."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = [int(n) for n in counts]
        self.used = [0] * len(self.left)
        self.any = sum(1 << length for length, n in enumerate(self.left) if n and length)

    def longest(self, most: int) -> int:
        """The longest length left of at most `most`; 0 if there is none."""
        return (self.any & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.any & ((1 << (most + 1)) - 1) else 0

    def fits(self, taken: dict[int, int], *more: int) -> bool:
        """Whether these lengths are left beside those already taken."""
        need = dict(taken)
        for length in more:
            need[length] = need.get(length, 0) + 1
        return all(self.left[length] >= n for length, n in need.items())

    def exact(self, gap: int, taken: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three lengths left whose sum is the gap; long ones first, so that short ones stay for later gaps."""
        if gap < len(self.left) and self.any >> gap & 1 and self.fits(taken, gap):
            return (gap,)
        if found := self._pair(gap, taken):
            return found
        pairs = self._pair_sums(gap)
        longest = self.longest(gap - 1)
        while 3 * longest >= gap and longest:
            if pairs >> (gap - longest) & 1 and self.fits(taken, longest):
                own = taken | {longest: taken.get(longest, 0) + 1}
                if found := self._pair(gap - longest, own):
                    return (longest, *found)
            longest = self.longest(longest - 1)
        return None

    def _pair(self, gap: int, taken: dict[int, int]) -> tuple[int, int] | None:
        longer = self.longest(gap - 1)
        while 2 * longer >= gap and longer:
            if self.any >> (gap - longer) & 1 and self.fits(taken, longer, gap - longer):
                return longer, gap - longer
            longer = self.longest(longer - 1)
        return None

    def _pair_sums(self, most: int) -> int:
        """Bit s is set where two lengths left sum to s, up to `most`."""
        sums, length, mask = 0, self.longest(most - 1), (1 << (most + 1)) - 1
        while length:
            sums |= self.any << length & mask
            length = self.longest(length - 1)
        return sums


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> list[Run]:
    """Runs for `counts[l]` pieces of each length l from 1 to `capacity`."""
    lengths = _Lengths(counts)
    runs: list[Run] = []
    sequence = 0
    while lengths.any:
        first = lengths.longest(capacity)
        taken, order, gap = {first: 1}, [(first, 1)], capacity - first
        while gap:
            if found := lengths.exact(gap, taken):
                for length in found:
                    taken[length] = taken.get(length, 0) + 1
                    order.append((length, 1))
                break
            best = lengths.longest(gap)
            while best and lengths.left[best] <= taken.get(best, 0):
                best = lengths.longest(best - 1)
            if not best:
                break
            # One at a time while a rest could still be filled exactly, else as many as fit.
            per = 1 if gap - best >= best else min(gap // best, lengths.left[best] - taken.get(best, 0))
            if gap > 8 * best:
                per = min(gap // best - 3, lengths.left[best] - taken.get(best, 0))
            taken[best] = taken.get(best, 0) + per
            order.append((best, per))
            gap -= best * per
        times = min(lengths.left[length] // n for length, n in taken.items())
        offset = 0
        for length, per in order:
            runs.append(Run(length, lengths.used[length], times, per, sequence, offset))
            lengths.used[length] += times * per
            lengths.left[length] -= times * per
            offset += length * per
            if not lengths.left[length]:
                lengths.any &= ~(1 << length)
        sequence += times
    return runs


def _ranked(pieces: DataFrame) -> DataFrame:
    """`pieces` with `rank`, its number from 0 among those of its length.

    Slots cut every length into parts that one task can number; parts get their offsets from counts.
    """
    slots = max(1, pieces.count() // SLOT_ROWS)
    slotted = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)))
    held = slotted.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slot")) - F.col("n")
    within = Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32")
    return (
        slotted.withColumn("rank", F.row_number().over(within) - 1)
        .join(held.select("length", "slot", before.alias("before")), ["length", "slot"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .drop("slot", "before")
    )


def place(pieces: DataFrame, runs: list[Run], capacity: int = CAPACITY) -> DataFrame:
    """Ranked pieces with `sequence_id` and `offset` by the runs, which number a few per length."""
    table = np.array(sorted((r.length, r.rank, r.times, r.per, r.sequence, r.offset) for r in runs), np.int64).reshape(-1, 6)
    firsts = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    fields = [(name, pa.int64()) for name in ("sequence_id", "offset")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for some in np.split(order, edges[1:]) if len(order) else []:
                low, high = firsts[length[some[0]]], firsts[length[some[0]] + 1]
                run = table[low + np.searchsorted(table[low:high, 1], rank[some], "right") - 1]
                nth = rank[some] - run[:, 1]
                sequence[some] = run[:, 4] + nth // run[:, 3]
                offset[some] = run[:, 5] + nth % run[:, 3] * run[:, 0]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                schema=pa.schema([*(batch.schema.field(c) for c in kept), *fields]),
            )

    kinds = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes if name != "rank")
    return pieces.mapInArrow(look_up, f"{kinds}, sequence_id long, offset long")


def pack_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of `token_pieces` with the `sequence_id` they share and their `offset` there, gapless from 0.

    Ties between pieces of a length are broken by doc_id, piece and checksum; equal rows are interchangeable.
    """
    pieces = stage(token_pieces(docs, path, doc_id, text, capacity), "token-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    return place(_ranked(pieces), plan_packing(counts, capacity), capacity)
