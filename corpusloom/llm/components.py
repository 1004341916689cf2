"""Connected components of an edge table by alternating large and small stars.

Before these rounds, edges are dealt out in parts of at most CHUNK, and each task leaves of its part an edge from each node to the least that it
reaches there: that connects the same nodes with no more edges, and with many less where nodes have many edges each. The parts are dealt out anew as long as that pays.

A hub's edges are many rows of one key: the least neighbours are summed up within tasks first and stored, so that the
join with the edges has shuffles of its own, which a skewed key's rows can be split over.

Defined results: edges from a node to itself, and repeated edges, count for nothing; an empty table gives no rows; null ends
are no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise

#: Edges of a part that one task contracts.
CHUNK = 1 << 15


def united(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `count` places the least place of its component under the edges (a, b)."""
    up = np.arange(count)
    while (open_ := up[a] != up[b]).any():
        x, y = up[a[open_]], up[b[open_]]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while ((above := up[up]) != up).any():
            up = above
    return up


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges (a, b): an edge from each node to the least that it reaches by them. Over twice CHUNK of them are contracted part by part."""

    def star(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(k).to_numpy() for b in edges]) for k in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        least = nodes[united(len(nodes), at[: len(ends[0])], at[len(ends[0]) :])]
        return pa.RecordBatch.from_arrays([pa.array(c[least != nodes]) for c in (nodes, least)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) > 2 * CHUNK:
            yield star(held)
            held = []
    if held:
        yield star(held)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a > b, distinct) that connect what the given ones (materialised) connect, no more than these."""
    left = edges.count()
    while left:
        parts, before, were = -(-left // CHUNK), edges, left
        edges = materialise(before.repartition(parts).mapInArrow(stars, "a long, b long").distinct(), "links")
        drop_scratch(before.sparkSession, before)
        left = edges.count()
        if parts == 1 or 4 * left > 3 * were:
            break
    return edges


def _to_least(edges: DataFrame, of: str, other: str) -> DataFrame:
    """least: the smallest of each node's neighbours and itself, beside each of its edges."""
    least = materialise(edges.groupBy(of).agg(F.min(other).alias("least")).withColumn("least", F.least("least", of)), "least")
    return edges.join(least, of)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _to_least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges with a > b."""
    stars = _to_least(edges, "a", "b")
    links = stars.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(stars.select("a", F.col("least").alias("b")))
    return links.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that can be reached) of every node with an edge; edges has longs a and b.

    Each round is written to the shared folder, so lost executors cost at most a round; rounds grow with
    the logarithm of the longest way.
    """
    now = contracted(materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"))
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark, before = seen, now
        now = materialise(_small(_large(now)), "links")
        drop_scratch(edges.sparkSession, before)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
