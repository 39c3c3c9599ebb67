"""Connected components of a graph given by its links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.skew import attach
from quire.llm.shared import giving_back, written


def find(parent: dict, x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x], x = root, up
    return root


def unite(parent: dict, a: int, b: int) -> bool:
    """Joins two trees under the smaller root; false if they were one already."""
    a, b = find(parent, a), find(parent, b)
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


#: Links kept in memory by one pass of the local reduction before its forest is passed on.
FOREST = 500_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a partition by stars that connect the same nodes."""

    def stars(parent: dict) -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(parent, x) for x in nodes], pa.int64())], ["u", "v"])

    parent: dict = {}
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            unite(parent, u, v)
        if len(parent) > FOREST:
            yield stars(parent)
            parent = {}
    if parent:
        yield stars(parent)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: every node of a link with the smallest node reachable from it.

    Large and small stars alternate until nothing changes; the number of rounds grows with the
    logarithm of the largest component. The neighbours of one node are never gathered: each round
    takes minima, combined before the shuffle, and joins them back with splittable partitions.
    Links with a null end and links of a node with itself are ignored; repeated links change nothing.
    """
    edges = (
        links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .mapInArrow(giving_back(_forest), "u long, v long").where("u <> v")
    )
    edges, before = written(edges.distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = attach(both, least, ["u"], "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = attach(large, low, ["u"], "inner")
        small = joined.select("v", "m").union(low.select("u", "m")).toDF("u", "v").where("u <> v")
        edges = written(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct()).distinct()
