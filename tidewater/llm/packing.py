"""Packing token pieces into sequences: large-item matching, then best fit.

Lengths are whole numbers up to the capacity, so a packing is worked out on the histogram of lengths (at most
``capacity`` counters, however many documents there are): items above a third of the capacity are matched
greedily, two to a bin at most; the others go, longest first, into the smallest gap that holds them. The plan
says, for runs of ranks within a length, which run of bins and which offset they get; every piece then finds
its place from its rank. Ranks are dealt by (task, length) and a prefix sum, so no length is gathered anywhere.

Cases: a null or empty text is a document of the end id alone; repeated rows and repeated or null doc_ids are
packed as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import encoder, map_arrow, read, strings, table, vocabulary

ITEMS = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def pieces(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document's ids (with the end id), ranked among the pieces of its length in its task."""

    def cut(batches):
        enc, task, seen = encoder(vocab), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                ids = np.concatenate([enc.encode(text).astype("<u4"), end])
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    out.append((doc, k, a, len(part), zlib.crc32(part), task, seen[len(part)]))
                    seen[len(part)] += 1
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ITEMS.split(", ")])

    return map_arrow(docs.select("doc_id", "text"), cut, ITEMS)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placements (length, first rank, ranks, first bin, offset), in order of length and rank, and the number of bins.

    Placement (L, r, n, b, o): the n items of length L from rank r on go to bins b, b + 1, ... at offset o.
    """
    left = {x: n for x, n in counts.items() if n}
    used: Counter = Counter()
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []  # gaps that some run of bins has
    bins = 0

    def place(x: int, n: int, first: int, offset: int) -> None:
        out.append((x, used[x], n, first, offset))
        used[x] += n
        left[x] -= n

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        x = large[-1]
        if not left[x]:
            large.pop()
            continue
        k = bisect.bisect_right(large, min(x, capacity - x)) - 1
        while k >= 0 and left[large[k]] < (2 if large[k] == x else 1):
            if not left[large[k]]:
                large.pop(k)
            k -= 1
        if k < 0:  # no partner is left
            n, y = left[x], 0
        else:
            y = large[k]
            n = left[x] // 2 if x == y else min(left[x], left[y])
        place(x, n, bins, 0)
        if y:
            place(y, n, bins, x)
        keep(capacity - x - y, bins, n)
        bins += n
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[x]:
            k = bisect.bisect_left(order, x)
            if k < len(order):
                gap = order[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(k)
            else:
                gap, first = capacity, bins
                n = -(-left[x] // (capacity // x))
                bins += n
            each = min(gap // x, left[x])  # best fit goes on with the same bin, whose gap is now the smallest
            full = min(n, left[x] // each)
            for j in range(each):
                place(x, full, first, capacity - gap + j * x)
            keep(gap - each * x, first, full)
            keep(gap, first + full, n - full) if gap < capacity else None
            if gap == capacity and n > full:
                rest = left[x]
                for j in range(rest):
                    place(x, 1, first + full, j * x)
                keep(gap - rest * x, first + full, 1)
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5), bins


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to ``items`` (a written table, as its tasks' ranks must not change)."""
    by = items.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = by.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where, _ = plan(counts, capacity)
    keys = where[:, 0] << 44 | where[:, 1]

    def assign(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            b = b.drop_columns(["rank"])
            yield b.append_column("sequence_id", pa.array(where[k, 3] + rank - where[k, 1])).append_column("offset", pa.array(where[k, 4]))

    placed = items.join(before.select("length", "task", "base"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return map_arrow(placed, assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", 0)


def pack_documents(docs: DataFrame, vocab: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(table(pieces(docs, vocab or vocabulary(), capacity, end_id), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
