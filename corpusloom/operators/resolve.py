"""Concept resolution: exact label, normalised label, nearest embedding at or over a threshold, else a new concept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .search import small, stored
from .similar import cosine_join

THRESHOLD, CANDIDATES = 0.86, 2000


def canonicalise(refs: DataFrame, known: DataFrame, threshold: float = THRESHOLD, pool: int | None = CANDIDATES, embed: bool = True) -> DataFrame:
    """label, type, concept_id, method, score of the distinct refs (label, type) against known (concept_id, label, type, occurrences).

    Each pass sees only what the one before left. The similarity pass compares with the `pool` most frequent concepts, a
    bound of the method, or with all (None); of equally similar ones it takes the most frequent.
    """
    refs = refs.select("label", "type").distinct()
    exact = refs.join(known.groupBy("label", "type").agg(F.min("concept_id").alias("concept_id")), ["label", "type"]).select("label", "type", "concept_id", F.lit("exact").alias("method"), F.lit(1.0).alias("score"))
    rest = refs.join(exact, ["label", "type"], "left_anti")
    keys = [T.normalize_label(F.col("label")).alias("nl"), T.normalize_label(F.col("type")).alias("nt")]
    folded = known.select("concept_id", *keys, "occurrences", "label").groupBy("nl", "nt").agg(F.max_by("concept_id", F.struct("occurrences", "label", "concept_id")).alias("concept_id"))
    normal = rest.select("label", "type", *keys).join(folded, ["nl", "nt"]).select("label", "type", "concept_id", F.lit("normalized").alias("method"), F.lit(1.0).alias("score"))
    rest = rest.join(normal, ["label", "type"], "left_anti")
    out = exact.unionByName(normal)
    surface = F.concat(F.col("type"), F.lit(": "), F.col("label"))
    if embed:
        order = [F.desc("occurrences"), F.col("label"), F.col("concept_id")]
        theirs = known if pool is None else known.orderBy(*order).limit(pool)
        theirs = stored(theirs.select("concept_id", "label", "occurrences", T.trigram_embedding(surface).alias("vector")), "known-vectors")
        ours = rest.select(F.struct("label", "type").alias("id"), T.trigram_embedding(surface).alias("vector"))
        met = cosine_join(ours, theirs.select(F.struct("concept_id", "label", "occurrences").alias("id"), "vector"), threshold)
        first = F.min_by("b", F.struct(-F.col("score"), -F.col("b.occurrences"), "b.label", "b.concept_id"))
        best = met.groupBy("a").agg(first.alias("b"), F.max("score").alias("score")).select("a.label", "a.type", "b.concept_id", "score")
        near = best.where(F.col("score") >= threshold).select("label", "type", "concept_id", F.lit("embedding").alias("method"), F.round("score", 4).alias("score"))
        rest = rest.join(near, ["label", "type"], "left_anti")
        out = out.unionByName(near)
    minted = rest.select("label", "type", T.digest(F.lit("concept"), keys[1], keys[0]).alias("concept_id"), F.lit("new").alias("method"), F.lit(0.0).alias("score"))
    return out.unionByName(minted)


def find_concept(names: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, concept_id: by label, else by alias; only A-Z fold; the smallest id of equals."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    every = concepts.select(fold("label").alias("key"), "concept_id", F.lit(0).alias("prio")).unionByName(aliases.select(fold("raw_label").alias("key"), "concept_id", F.lit(1).alias("prio")))
    return small(names).withColumn("key", fold("name")).join(every, "key").groupBy("name").agg(F.min_by("concept_id", F.struct("prio", "concept_id")).alias("concept_id"))
