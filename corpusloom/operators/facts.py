"""The append-only, bitemporal fact log: every write is a new frame, every read says which facts it means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new to append: one a key, none whose key is there."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def upsert_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of each key the row with the greatest seq."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), seq).alias("r")).select(*keys, "r.*")


def upsert_sum(deltas: DataFrame, key: str, amount: str, seq: str, first: list[str]) -> DataFrame:
    """Amounts added up by key; the columns `first` keep their values at the first seq."""
    return deltas.groupBy(key).agg(F.sum(amount).alias(amount), *[F.min_by(c, seq).alias(c) for c in first])


def supersede(facts: DataFrame, chunks: DataFrame, replaced: DataFrame) -> DataFrame:
    """facts with superseded_by set, where unset, for the chunks of each replaced version (version_id, run_id)."""
    hit = chunks.select("chunk_id", "version_id").join(replaced, "version_id").select("chunk_id", F.col("run_id").alias("by_run"))
    return facts.join(hit, "chunk_id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "by_run")).drop("by_run")


def current(facts: DataFrame) -> DataFrame:
    return facts.where("superseded_by IS NULL")


def as_of(facts: DataFrame, runs: DataFrame, moment: Column) -> DataFrame:
    """What was known and not yet superseded at the moment; a superseding run counts from its start."""
    started = runs.select(F.col("run_id").alias("superseded_by"), F.col("started_at").alias("closed_at"))
    return facts.where(F.col("knowledge_time") <= moment).join(started, "superseded_by", "left").where(F.col("closed_at").isNull() | (F.col("closed_at") > moment)).drop("closed_at")


def queue(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Chunks without facts: the work that is left, found from the data."""
    return chunks.join(facts.select("chunk_id"), "chunk_id", "left_anti")


def latest(versions: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return versions.withColumn("rn_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rn_ = 1").drop("rn_")


def run_states(events: DataFrame) -> DataFrame:
    """run_id with started_at, finished_at, status: of start and finish events in order of seq."""
    return events.groupBy("run_id").agg(F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"), F.max_by("status", "seq").alias("status"), F.substring(F.max_by("error", "seq"), 1, 2000).alias("error"))


def vocabulary(facts: DataFrame, column: str, limit: int = 60) -> DataFrame:
    return current(facts).groupBy(F.col(column).alias("term")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(limit)
