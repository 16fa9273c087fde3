"""Packing documents into sequences: Martello-Toth reduction, then best fit for what it leaves.

Lengths are at most the capacity, so an instance is a histogram of `capacity` counts whatever the number of
documents. The driver solves that histogram; every step places many equal pieces into a range of sequences at
once, and the plan is a list of such runs. Pieces are numbered within their length by the cluster and look their
run up. A plan has at most 3 * capacity groups of sequences with at most sqrt(2 * capacity) different lengths each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, slices, table
from .tokens import encoder, vocabulary_path


@dataclass
class Plan:
    """runs: (length, first rank, ranks, first sequence, pieces a sequence, offset)."""

    capacity: int
    counts: list[int]
    taken: list[int] = field(init=False)
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    reduced: int = 0

    def __post_init__(self):
        self.counts = [int(x) for x in self.counts]
        self.taken = [0] * len(self.counts)

    def place(self, length: int, sequence: int, sequences: int, each: int, offset: int) -> None:
        n = sequences * each
        self.runs.append((length, self.taken[length], n, sequence, each, offset))
        self.taken[length] += n
        self.counts[length] -= n

    def fix(self, group: list[int], times: int) -> None:
        """`times` new sequences with the lengths of group each."""
        offset = 0
        for length in sorted(set(group), reverse=True):
            each = group.count(length)
            self.place(length, self.sequences, times, each, offset)
            offset += each * length
        self.sequences += times
        self.reduced += times


def _times(counts: list[int], group: list[int]) -> int:
    return min(counts[x] // group.count(x) for x in set(group))


def _dominant(counts: list[int], capacity: int, j: int) -> list[int] | None:
    """A set with j that dominates every other feasible set with j (Martello and Toth, at most three pieces), or None."""
    counts = counts.copy()
    counts[j] -= 1
    sizes = [x for x in range(1, capacity + 1) if counts[x]]
    room = capacity - j
    if not sizes or sizes[0] > room:
        return [j]
    best = max(x for x in sizes if x <= room)
    if best == room:
        return [j, best]
    smallest = [x for x in sizes[:3] for _ in range(min(3, counts[x]))][:3]
    if sum(smallest[:2]) > room or len(smallest) < 2:
        return [j, best]
    if len(smallest) == 3 and sum(smallest) <= room:
        return None  # more than two others may fit
    pair, low = (0, 0), 0
    for a in reversed(sizes):
        while low < len(sizes) and sizes[low] + a <= room:
            low += 1
        b = low - 1
        if b >= 0 and sizes[b] == a and counts[a] < 2:
            b -= 1
        if b >= 0 and sizes[b] <= a and a + sizes[b] > sum(pair):
            pair = (a, sizes[b])
    if best >= sum(pair):
        return [j, best]
    if best == pair[0]:
        between = sum(counts[x] for x in sizes if pair[1] < x < pair[0])
        above = [x for x in sizes if x > pair[1] for _ in range(min(2, counts[x]))][:2]
        if between <= 1 or len(above) < 2 or sum(above) > room:
            return [j, *pair]
    return None


def reduce(plan: Plan) -> None:
    """Fix dominating sets, largest pieces first, until none is left."""
    found = True
    while found:
        found = False
        for j in range(plan.capacity, 0, -1):
            while plan.counts[j] and (group := _dominant(plan.counts, plan.capacity, j)):
                plan.fix(group, max(1, _times(plan.counts, group)))
                found = True


def best_fit(plan: Plan) -> None:
    """The remaining pieces, longest first, each into the fullest sequence that has room."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges of sequences
    for size in range(plan.capacity, 0, -1):
        while left := plan.counts[size]:
            free = min((x for x in room if x >= size), default=plan.capacity)
            each = free // size
            if free not in room:
                n = -(-left // each)
                room[free] = [(plan.sequences, plan.sequences + n)]
                plan.sequences += n
            first, end = room[free].pop()
            whole = min(end - first, left // each)
            parts = [(whole, each)] if whole else [(1, left)]
            for n, pieces in parts:
                plan.place(size, first, n, pieces, plan.capacity - free)
                if rest := free - pieces * size:
                    room.setdefault(rest, []).append((first, first + n))
                first += n
            if first < end:
                room[free].append((first, end))
            if not room[free]:
                del room[free]


def solve(counts: list[int], capacity: int) -> Plan:
    """counts[k]: pieces of k tokens, for k from 0 to capacity; counts[0] is taken as 0."""
    plan = Plan(capacity, [0, *counts[1:]])
    reduce(plan)
    best_fit(plan)
    return plan


def cut_pieces(docs: DataFrame, capacity: int, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids and end_id: doc_id, piece, start, length, ids_crc32. Of a longer document every piece but the first is full."""
    prepare(docs.sparkSession)
    path = path or vocabulary_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(end_id)).astype("<u4")
                start, end, k = 0, (len(ids) - 1) % capacity + 1, 0
                while start < len(ids):
                    for column, value in zip(out, (doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())), strict=True):
                        column.append(value)
                    start, end, k = end, end + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document in as few sequences of at most `capacity` tokens as the method finds.

    A null or empty text is the end token alone. Repeated rows, of one id or of one text, are packed each on its
    own. An empty table gives no rows. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, capacity, end_id, path, id_col, text_col), "pieces")
    counts = [0] * (capacity + 1)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    plan = solve(counts, capacity)
    parts = max(16, min(1024, sum(counts) // 100_000))
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    pieces = pieces.withColumn("_p", part)
    inside = Window.partitionBy("length", "_p").orderBy("doc_id", "piece", "ids_crc32")
    before = pieces.groupBy("length", "_p").count()
    before = before.select("length", "_p", (F.sum("count").over(Window.partitionBy("length").orderBy("_p")) - F.col("count")).alias("_before"))
    ranked = pieces.withColumn("_r", F.row_number().over(inside) - 1).join(before, ["length", "_p"]).withColumn("_r", F.col("_r") + F.col("_before"))
    runs = spark.createDataFrame(plan.runs, "_length long, _first long, _n long, _sequence long, _each long, _offset long")
    found = ranked.join(F.broadcast(runs), (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_first")) & (F.col("_r") < F.col("_first") + F.col("_n")))  # bounded, see above
    at = F.col("_r") - F.col("_first")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(at / F.col("_each")).cast("long")).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).alias("offset"),
    )


def op6_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLE = {}
