"""Best-fit packing of token sequences.

Best-fit decreasing looks at lengths only, so documents of one length are interchangeable. The plan is made on the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus): equal lengths that go to bins of equal remaining
capacity are placed together, as a range of ranks into a range of bins. A document then finds its place by its length and
its rank among those of this length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.encoding import encoder
from quadrat.session import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLAN = "length long, from_rank long, to_rank long, first_bin long, per_bin long, offset long"


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the smallest sufficient capacity in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity: ranges of bins, as (first, number)

    def _mark(self, capacity: int) -> None:
        node = self.leaves + capacity
        self.any[node] = bool(self.bins[capacity])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def add(self, capacity: int, first: int, number: int) -> None:
        if capacity and number:
            self.bins[capacity].append((first, number))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        found = self.bins[capacity].pop()
        self._mark(capacity)
        return found

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that is ``length`` or more."""
        node = self.leaves + length
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``histogram[length]`` documents: rows of (length, from_rank, to_rank, first_bin, per_bin, offset).

    Ranks ``from_rank <= rank < to_rank`` of a length go to bins from ``first_bin`` on, ``per_bin`` one after another in
    each, from ``offset`` on. Filling a bin with as many of one length as fit is what best fit does: the bin just used is
    the tightest. A row moves a whole range of bins, or ends its length.
    """
    bins, rows, fresh = OpenBins(capacity), [], 0
    for length in sorted((n for n in histogram if n > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            per_bin = (room or capacity) // length
            if room is None:
                room, first, number = capacity, fresh, -(-left // per_bin)
                fresh += number
            else:
                first, number = bins.take(room)
            full = min(number, left // per_bin)
            if full:
                rows.append((length, rank, rank + full * per_bin, first, per_bin, capacity - room))
                bins.add(room - per_bin * length, first, full)
                rank, left, first, number = rank + full * per_bin, left - full * per_bin, first + full, number - full
            if number and left and left < per_bin:
                rows.append((length, rank, rank + left, first, left, capacity - room))
                bins.add(room - left * length, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            bins.add(room, first, number)
    return rows


def token_pieces(docs: DataFrame, vocabulary: str, keeps_space: bool, end_id: int, capacity: int) -> DataFrame:
    """Token ids of each whole text (NULL: empty) and ``end_id``, cut into full pieces with a shorter first one if need be.

    ``task`` and ``nth`` number the pieces of one length within a task.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen, end = TaskContext.get().partitionId(), Counter(), end_id.to_bytes(4, "little")
        for df in frames:
            rows = []
            for doc_id, ids in zip(df["doc_id"], encoder(vocabulary, keeps_space).encode([t or "" for t in df["text"]])):
                data, n, start = ids.tobytes() + end, len(ids) + 1, 0
                for piece in range(-(-n // capacity)):
                    stop = start + (n - 1) % capacity + 1 if piece == 0 else start + capacity
                    length = stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(data[4 * start:4 * stop]), task, seen[length]))
                    seen[length] += 1
                    start = stop
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", keeps_space: bool = True, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens: pieces with sequence_id and offset.

    NULL and empty texts are one token, the end id. Repeated rows are packed each on its own; an empty table gives no rows.
    What the driver sees is the histogram of lengths; what is broadcast is the plan, whose rows depend on the number of
    different lengths and not on the number of documents.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, vocabulary, keeps_space, end_id, capacity), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_bins(histogram, capacity), PLAN)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    at = F.col("rank") - F.col("from_rank")
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "planned")),
                         (F.col("length") == F.col("planned")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first_bin") + F.floor(at / F.col("per_bin"))).cast("long").alias("sequence_id"),
                         (F.col("offset") + at % F.col("per_bin") * F.col("length")).cast("long").alias("offset"))
