"""Connected components by alternating small and large stars, in tables; nothing is gathered on the driver.

Each task first puts the edges that it reads, ``CHUNK`` nodes at a time, as stars around their smallest node. A star step then costs one
table of what each node's neighbours span, which also tells whether only stars are left, so that no step is made just to see no change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import tidy
from threadlens.work import Workspace

#: Nodes that a task holds at once while it contracts its edges.
CHUNK = 100_000


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: stars that connect what the edges (a, b) of each task connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            if len(parent) >= CHUNK:
                yield stars()
        yield stars()

    return edges.select("a", "b").mapInArrow(tidy(run), "u long, v long")


def members(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for every node that has an edge (a, b) with another; root is its component's smallest node."""
    e, small = work.keep(contracted(edges), "edges"), True
    while True:
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        # a table of its own, so that the joins can split a hub's rows
        spans = work.keep(e.unionByName(turned).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")), "spans")
        if spans.where("NOT (low > u OR (high < u AND low = high))").isEmpty():  # all are centres, or leaves of one centre
            work.drop(e)
            return spans.select(F.col("u").alias("node"), F.least("u", "low").alias("root"))
        least = spans.select("u", F.least("u", "low").alias("m"))
        if small:
            met = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.*")
            now = work.keep(met.where("u <> v").distinct(), "small")
        else:  # an edge gives an edge
            now = work.keep(turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        work.drop(e, spans)
        e, small = now, not small


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's smallest; root is that smallest node."""
    return members(edges, work).where("node <> root")
