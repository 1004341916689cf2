"""What the operators of this package share: table access, shared scratch tables, packed texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: White space of every contract here: [\x20\x09-\x0D].
SPACES = bytes(b" "[0] if i in b"\t\n\x0b\x0c\r " else i for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later reads survive lost executors and never recompute."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of materialised frames that no result reads any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and the whole text as UTF-8 bytes (null: empty); other columns of docs, whatever their names, go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *extra)


def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, text) of each row of batches made by texts()."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, weigh=lambda row: 64, most: int = 4 << 20, count: int = 8192) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of a bounded weight (bytes, as weigh tells) and count."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= most or len(held) >= count:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
