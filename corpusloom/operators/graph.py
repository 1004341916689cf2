"""The graph as two frames, vertices (id, label, type) and edges (src, dst, fact_id, ...), always recomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vertices(concepts: DataFrame) -> DataFrame:
    return concepts.select("id", "label", "type").dropDuplicates(["id"])


def edges(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge a (src, fact_id, dst), only between nodes that are there."""
    there = nodes.select("id")
    some = facts.dropDuplicates(["src", "fact_id", "dst"])
    return some.join(there.withColumnRenamed("id", "src"), "src", "left_semi").join(there.withColumnRenamed("id", "dst"), "dst", "left_semi")


def undirected(found: DataFrame) -> DataFrame:
    rest = [c for c in found.columns if c not in ("src", "dst")]
    return found.select("src", "dst", *rest).unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def neighbours(found: DataFrame, nodes: DataFrame, seeds: DataFrame, limit: int = 50) -> DataFrame:
    """seed, id, label, predicate, confidence, fact_id: the `limit` surest of each seed's edges, either way."""
    near = undirected(found).join(seeds.withColumnRenamed("seed", "src"), "src", "left_semi")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("confidence"), "fact_id", "dst"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= limit)
    return best.join(nodes.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("seed"), F.col("dst").alias("id"), "label", "predicate", "confidence", "fact_id", "rank")
