"""Connected components of a links table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import shared


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition, contracted to stars around the smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while up.get(x, x) != x:
            path.append(x)
            x = up[x]
        for y in path:
            up[y] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    roots = [root(x) for x in nodes]
    keep = [i for i, (x, r) in enumerate(zip(nodes, roots)) if x != r]
    for i in range(0, len(keep), 100_000):
        part = keep[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in part], pa.int64()), pa.array([roots[k] for k in part], pa.int64())], ["a", "b"])


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of `links` (a, b) that is not the smallest of its component.

    Every step is a hash aggregation and a join on node ids; the loop ends when a
    round leaves the links as they are.  Each round is written to the shared folder,
    so lineage stays short and a lost executor repeats one round at most.  After a set
    number of `rounds` the roots may still be finer than the components.
    """
    done = 0
    edges = shared.written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(shared.lean(_forest), "a long, b long").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("m"))
        large = both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        small = down.join(least, F.col("a") == F.col("_a")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = shared.written(small, "links")
        done += 1
        if done == rounds:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
