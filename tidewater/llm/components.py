"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is an aggregation with a map-side part and a join on node ids; no component is gathered in a task.
The table of links is written after each round, so lost executors redo one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import drop, map_arrow, table


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def forest(links: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Each task's links as stars around their smallest nodes, in runs of at most ``most`` links."""

    def shrink(batches):
        held, n = [], 0

        def stars():
            nodes, root = roots(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
            far = nodes != root
            return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], names=["a", "b"])

        for x in batches:
            if x.num_rows:
                held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
                n += x.num_rows
            if n >= most:
                yield stars()
                held, n = [], 0
        if held:
            yield stars()

    return map_arrow(links.select("a", "b"), shrink, "a long, b long", 0)


def components(links: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) of every node that ``links`` (a, b: long, not null) has."""
    now = table(forest(links).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    was = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = table(small.distinct(), "links")
        is_ = tuple(new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        drop(now)
        now = new
        if is_ == was:
            break
        was = is_
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
