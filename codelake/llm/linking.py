"""Connected components of links between 64-bit names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import saved


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each number below ``n`` the least one that the links (a, b) connect it with."""
    p = np.arange(n)
    while len(a):
        x, y = p[a], p[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = p[p]
            if np.array_equal(up, p):
                break
            p = up
    return p


#: Links that a task holds before it passes on what connects the same.
HELD = 1_000_000


def contracted(links: DataFrame, held: int = HELD) -> DataFrame:
    """Fewer links (src, dst) that connect the same names: each task points what it sees connected to the least name."""
    def star(src, dst):
        names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        p = labels(len(names), at[: len(src)], at[len(src) :])
        moved = np.flatnonzero(p != np.arange(len(p)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[p[moved]])], names=["src", "dst"])

    def run(batches):
        src, dst = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            src, dst = (np.append(own, batch.column(c).to_numpy()) for own, c in ((src, "src"), (dst, "dst")))
            if len(src) >= held:
                made = star(src, dst)
                src, dst = made.column("src").to_numpy(), made.column("dst").to_numpy()
                if len(src) > held // 2:  # little was connected: pass on and start anew
                    yield made
                    src, dst = src[:0], dst[:0]
        if len(src):
            yield star(src, dst)

    return links.select("src", "dst").mapInArrow(run, "src bigint, dst bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all linked names; the component is its least name.

    Tasks of about a million links contract them first, so what is left is little more than a
    link for each name, however many partitions the links came in.  Then, round by round, each name takes the least label
    among its neighbours' and that label's own label, so chains shorten by half.
    """
    links = saved(links.select("src", "dst"))
    links = saved(contracted(links.coalesce(max(1, -(-links.count() // HELD)))).distinct())
    both = saved(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    known = saved(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(known.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        told = known.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = known.select(F.col("node").alias("new"), F.col("component").alias("far"))
        moved = saved(told.join(jump, "new").select("node", "old", F.least("new", "far").alias("component")))
        known = moved.select("node", "component")
        if moved.filter("component != old").isEmpty():
            return known
