"""Packing documents into sequences: combinations that fill a sequence exactly, then best fit.

How pieces fit depends on their lengths only, so the plan is made on the histogram of lengths, which
has at most `capacity` entries however many documents there are. Each piece then finds its place by its
rank among the pieces of its length: counters of the writing task give the rank inside a task's
output, and a sum over tasks for each length gives what lies before it. No piece is sorted or moved to be placed.

Null texts are empty documents and still hold the end id; repeated rows are packed each for itself; texts of any length are cut
into pieces; pieces of equal length (ties) are placed in the order they were written;
an empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxweave.llm import tokens
from taxweave.llm.common import settle

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, task long, rank_in_task long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece, with its ids; written once, as encoding is the costly part."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        names = [f.split()[0] for f in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for doc_id, ids in tokens.encoded(batches, tokenizer, end_id):
            for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                length = len(part) // 4
                rows.append((doc_id, number, at // 4, length, part, zlib.crc32(part), task, seen[length]))
                seen[length] += 1
                held += len(part)
            if held > 4 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return settle(tokens.texts_of(docs).mapInArrow(pieces, PIECES), "pieces")


class Plan:
    """Which lengths share a sequence: (lengths of a sequence, how many such sequences)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.left[length] = count
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._exact()
        self._best_fit()

    def _take(self, lengths: tuple[int, ...]) -> None:
        """Consume this combination as often as its lengths are available."""
        need = Counter(lengths)
        times = min(int(self.left[n]) // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= times * k
        if times:
            self.patterns.append((lengths, times))

    def _exact(self) -> None:
        """From the longest length down: one, two or three lengths that fill its gap exactly."""
        self._take((self.capacity,))
        for length in range(self.capacity - 1, 0, -1):
            gap = self.capacity - length
            if self.left[length]:
                self._take((length, gap))
            for fill in (self._pairs, self._triples):
                if self.left[length]:
                    fill(length, gap)

    def _pairs(self, length: int, gap: int) -> None:
        for a in range(gap - 1, (gap - 1) // 2, -1):
            if not self.left[length]:
                return
            if self.left[a] and self.left[gap - a]:
                self._take((length, a, gap - a))

    def _triples(self, length: int, gap: int) -> None:
        """For each first length, the index of sums of two is looked up as a pair of availability vectors."""
        for a in range(gap - 2, (gap - 1) // 3, -1):
            if not self.left[a]:
                continue
            rest = gap - a
            b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
            for k in b[(self.left[b] > 0) & (self.left[rest - b] > 0)]:
                if not self.left[length]:
                    return
                self._take((length, a, int(k), rest - int(k)))

    def _best_fit(self) -> None:
        """What is left, longest first, into the fullest open sequences that have room."""
        bins: dict[int, list[list]] = defaultdict(list)  # by gap: [lengths, how many]
        for length in range(self.capacity, 0, -1):
            count = int(self.left[length])
            while count:
                gap = min((g for g in bins if g >= length), default=None)
                if gap is None:
                    each = min(self.capacity // length, count)
                    bins[self.capacity - each * length].append([(length,) * each, count // each])
                    count -= count // each * each
                    continue
                lengths, times = bins[gap].pop()
                each = min(gap // length, count)
                used = min(times, count // each)
                if used < times:
                    bins[gap].append([lengths, times - used])
                if not bins[gap]:
                    del bins[gap]
                bins[gap - each * length].append([lengths + (length,) * each, used])
                count -= used * each
            self.left[length] = 0
        self.patterns += [(tuple(lengths), times) for open_bins in bins.values() for lengths, times in open_bins]

    def slots(self) -> dict[str, np.ndarray]:
        """For each place in each pattern, sorted by (length, first): pieces of this length with ranks
        from `first` go to sequences from `sequence` on, at `offset`."""
        rows, used, sequence = [], Counter(), 0
        for lengths, times in self.patterns:
            offset = 0
            for n in lengths:
                rows.append((n, used[n], sequence, offset))
                used[n] += times
                offset += n
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return dict(zip(("length", "first", "sequence", "offset"), table.T))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset of each piece."""
    counts = settle(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = Plan(total, capacity).slots()
    # (length, rank) as one number, so that one binary search finds the place.
    span = max(total.values(), default=0) + 1
    firsts = slots["length"] * span + slots["first"]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(firsts, length * span + rank, "right") - 1
            sequence = slots["sequence"][at] + rank - slots["first"][at]
            given = [batch.column(c) for c in ("doc_id", "piece", "start")]
            columns = [*given, pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(slots["offset"][at])]
            yield pa.record_batch(columns, [f.split()[0] for f in PLACED.split(", ")])

    ranked = pieces.join(earlier, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("rank_in_task")).alias("rank")
    )
    return ranked.mapInArrow(placed, PLACED)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the sequences themselves, at most `capacity` ids each."""
    ids = pieces.select("doc_id", "piece", "ids").join(placed, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return ids.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
