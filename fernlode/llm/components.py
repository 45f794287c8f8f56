"""Union-find grouping: connected components of a link table that no task or driver holds whole.

Each task first unites the links of its own partition, which leaves at most one link per node
and task.  Alternating large and small stars then shrink what is left to one star per
component; every round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlode.storage import broadcast_if_small, map_batches, materialize

BROADCAST_NODES = 400_000
FLUSH_LINKS = 2_000_000
LINKS_DDL = "src long, dst long"


def _unite_partition(links: DataFrame) -> DataFrame:
    """(src, dst) with dst < src: each task's links as stars around their smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        def stars() -> pa.RecordBatch:
            nodes = [x for x in parent if root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["src", "dst"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > FLUSH_LINKS:
                yield stars()
                parent.clear()
        yield stars()

    return map_batches(links.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), run, LINKS_DDL)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One large or small star over (src, dst) with dst < src."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else links
    # A written table of minima: either broadcast within the bound, or a join whose hot keys Spark can split.
    least = broadcast_if_small(materialize(both.groupBy("src").agg(F.min("dst").alias("_m")), "least", narrow=True), BROADCAST_NODES)
    joined = both.join(least, "src").withColumn("_m", F.least("src", "_m"))
    if large:
        out = joined.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("_m").alias("dst"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("_m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("_m").alias("dst")))).alias("e")).select("e.*")
    return materialize(out.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("_n")).drop("_n"), "links", narrow=True)


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (src, dst) that is not its component's smallest.

    Rounds go on until nothing changes; their number grows with the square of the logarithm of the nodes at most.
    """
    now = materialize(_unite_partition(links.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")), "links", narrow=True)
    if now.isEmpty():
        return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    sign = None
    while True:
        now = _star(_star(now, True), False)
        before, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if sign == before:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
