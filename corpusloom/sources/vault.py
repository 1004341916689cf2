"""Sources of notes and records: a vault of Markdown files, JSON fixtures, compressed run logs; and the run-log sink."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..operators.search import small
from ..operators.segment import _FRONT, body_offset
from ..session import qualified

# Directories that are never part of a vault; the last is this library's own state.
EXCLUDED = (".git", ".obsidian", ".trash", "node_modules", ".corpusloom")


def scan_vault(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """relative_path, content (bytes), content_hash, byte_size of every *.md and *.markdown file, but none in an excluded folder.

    Files are listed through Hadoop's file system, so any store works and names that begin with a dot
    or an underscore, which Spark's own listing drops, are found too. The list is made on the driver: vault_format lists in tasks.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(conf)
    base = store.resolvePath(top).toUri().getPath().rstrip("/")
    found, files = [], store.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath()
        relative = path.toUri().getPath()[len(base) + 1 :]
        if relative.endswith((".md", ".markdown")) and not set(relative.split("/")) & set(excluded):
            found.append((relative, path.toString()))
    listed = spark.createDataFrame(found, "relative_path string, path string")
    if not found:
        return listed.select("relative_path", F.lit(b"").alias("content"), F.lit("").alias("content_hash"), F.lit(0).cast("long").alias("byte_size"))
    read = spark.read.format("binaryFile").load([p.replace("\\", "\\\\") for _, p in found]) if all(not _hidden(r) for r, _ in found) else _read_each(spark, found)
    joined = read.join(small(listed), "path") if "path" in read.columns else read
    return joined.select("relative_path", "content", F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("byte_size"))


def _hidden(relative: str) -> bool:
    return any(part.startswith(("_", ".")) for part in relative.split("/"))


def _read_each(spark: SparkSession, found: list[tuple[str, str]]) -> DataFrame:
    """Read files by tasks through pyarrow's file systems."""

    def rows(batches):
        for batch in batches:
            for relative, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                with store.open_input_stream(name, compression=None) as file:
                    yield pa.RecordBatch.from_arrays([pa.array([relative]), pa.array([file.read()], pa.binary())], ["relative_path", "content"])

    listed = spark.createDataFrame(found, "relative_path string, path string")
    return listed.repartition(max(1, min(200, len(found) // 100))).mapInArrow(rows, "relative_path string, content binary")


def decoded(files: DataFrame) -> DataFrame:
    """files with text: UTF-8 without a byte order mark; other bytes are an error of the query."""
    text = F.when(F.is_valid_utf8("content"), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "relative_path")))
    return files.withColumn("text", F.regexp_replace(text, "^﻿", ""))


@F.pandas_udf(K.MapType(K.StringType(), K.StringType()))
def front_matter(text: pd.Series) -> pd.Series:
    """The leading YAML block as strings: {} if there is none or it isn't a mapping; bad YAML is an error."""
    import yaml

    def one(text: str | None) -> dict[str, str]:
        found = _FRONT.match(text or "")
        values = yaml.safe_load(found[1]) if found else None
        return {str(k): v.isoformat() if hasattr(v, "isoformat") else str(v) for k, v in values.items()} if isinstance(values, dict) else {}

    return text.map(one)


@F.pandas_udf(K.IntegerType())
def body_start(text: pd.Series) -> pd.Series:
    """Where the body begins behind the front matter, in characters."""
    return text.map(lambda t: body_offset(t or ""))


def write_notes(notes: DataFrame, root: str) -> None:
    """Write each row (relative_path, text) as a file under root, by the tasks that hold them; a retried task writes the same file again."""
    root = qualified(notes.sparkSession, root)

    def write(batches):
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for relative, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{top}/{relative}".rpartition("/")[0])
                with store.open_output_stream(f"{top}/{relative}", compression=None) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["relative_path"])

    notes.select("relative_path", "text").mapInArrow(write, "relative_path string").count()


def expectations(spark: SparkSession, path: str) -> DataFrame:
    """Expected claims: JSON arrays of subject, predicate, object, note; '' matches anything."""
    return spark.read.schema("subject string, predicate string, object string, note string").json(path, multiLine=True)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of compressed JSON-lines logs; blank lines are none."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.parse_json("value").alias("record"))


def append_run_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").option("compression", "gzip").json(path)
