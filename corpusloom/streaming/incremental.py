"""Structured Streaming forms of the incremental work: sources are files, triggers run until all is read.

Query state and results lie under the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..session import shared_dir


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)


def run_out(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there; its last result as a table. A complete result is rewritten by each batch; an update's batches hold changes alone, so they aren't for this."""
    if mode == "update":
        raise ValueError("an update's batches have to be merged by key")
    spark, out, state = stream.sparkSession, place(stream.sparkSession, name), place(stream.sparkSession, f"{name}-state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ingest(stream: DataFrame, target: str, key: str | list[str], state: str, once: bool = True) -> None:
    """Append the rows whose key the target lacks; a repeated batch changes nothing, and a stream without rows leaves an empty target.

    Of a batch's rows with one key the target gets one, or all if not `once`. A null key is one key.
    """
    keys = [key] if isinstance(key, str) else key
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("append").parquet(target)

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates(keys) if once else df
        there = spark.read.schema(df.schema).parquet(target).select(*[F.col(k).alias(f"there_{k}") for k in keys])
        new.join(there, reduce(and_, [F.col(k).eqNullSafe(F.col(f"there_{k}")) for k in keys]), "left_anti").write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def superseded_stream(spark: SparkSession, stream: DataFrame, key: str, by: str, order: str) -> DataFrame:
    """The stream's versions, each with the key of the version that closes it: batches append what is new, and the
    log tells which row closes which, so a late version takes its place between those around it."""
    target = place(spark, "versions")
    ingest(stream, target, key, place(spark, "versions-state"))
    w = Window.partitionBy(by).orderBy(order, key)
    return spark.read.schema(stream.schema).parquet(target).withColumn("closed_by", F.lead(key).over(w))


def entry_names(entries: DataFrame, order: str) -> DataFrame:
    """file: the name, with -2, -3, ... where it is taken."""
    n = ranked(entries, ["name"], [order], "n")
    return n.select(order, F.concat("name", F.when(F.col("n") > 1, F.concat(F.lit("-"), "n")).otherwise(""), F.lit(".md")).alias("file"))


def counted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = files(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return run_out(counts, "counts", "complete")


def deduped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct user and type: repeats within a day of the watermark are dropped by bounded state, later ones by what the target holds."""
    keys = ["user_id", "event_type"]
    events = files(spark, sf_dir, "events").select(*keys, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(keys)
    stream, target = events.select(*keys), place(spark, "distinct")
    ingest(stream, target, keys, place(spark, "distinct-state"))
    return spark.read.schema(stream.schema).parquet(target).select(*keys)


def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts; late rows count until the watermark passes them, and complete output keeps every window."""
    hours = files(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return run_out(hours.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n"), "hours", "complete")


def ingested_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into a table by id, twice: the second run finds nothing new. Rows that share an id are in one batch, so all of them are taken."""
    stream = files(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    target = place(spark, "ingested")
    for _ in range(2):
        ingest(stream, target, "doc_id", place(spark, "ingest-state"), once=False)
    return spark.read.schema(stream.schema).parquet(target)
