"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is joins and min-aggregates only: no adjacency list is ever gathered, so a hub with a third of
all edges is an ordinary skewed join, which adaptive execution splits. Rounds are written to the shared
folder, which keeps plans short and survives lost executors.

Up to ``FEW`` edges (16 MB of longs) take one task with a union-find instead, with the same result: a round is a dozen
stages of as many tasks as there are shuffle partitions, and the driver keeps something of each task and plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import forget, materialize, release, shuffled

FEW = 1 << 20


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` of longs to ``(node, component)``; component is the smallest node reachable.

    Rounds go on until a round changes nothing; there is no bound on them. The smallest node of a component is not listed, nor are nodes without an edge to another. Null ends and self-loops link nothing.
    """
    big, small = F.greatest("src", "dst"), F.least("src", "dst")
    e = edges.where("src is not null and dst is not null and src <> dst").select(big.alias("a"), small.alias("b")).distinct()
    e = materialize(e, "edges")
    seen = _digest(e)
    if 0 < seen[0] <= FEW:
        out = materialize(e.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
        release(e)
        return out
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(shuffled(low), "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(shuffled(low), "a")
        star = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = materialize(star.distinct(), "stars")
        release(e)
        e, before, seen = new, seen, _digest(new)
        if seen == before:
            break
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out._tributary_path = e._tributary_path  # type: ignore[attr-defined]  # for release
    return out


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, component)`` of all edges ``(a, b)`` of the one task, by union-find."""
    forget()
    edges = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    nodes, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *edges], axis=1), return_inverse=True)
    root = list(range(len(nodes)))  # nodes are sorted: the smallest place is the smallest node

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for x, y in zip(*at.reshape(2, -1).tolist(), strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    top = np.array([find(i) for i in range(len(nodes))], np.int64)
    led = top != np.arange(len(nodes))
    out = pa.RecordBatch.from_arrays([pa.array(nodes[led]), pa.array(nodes[top[led]])], names=["node", "component"])
    for lo in range(0, out.num_rows, 1 << 16):
        yield out.slice(lo, 1 << 16)


def _digest(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)
