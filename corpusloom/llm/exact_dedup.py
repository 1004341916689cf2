"""Exact dedup over content-defined chunk recipes.

Each normalised text is cut into content-defined chunks; a chunk's 128-bit hash becomes its
identifier once the corpus-wide check shows that no two different chunks share it (else the
next seed is tried). A document is then its ordered list of chunk identifiers, and equal lists
are equal texts: only 16 bytes a chunk are grouped and joined, never the long texts.

Defined results: a null text is the empty text; a null doc_id counts as larger than any other;
of repeated rows that share the smallest doc_id, one is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, in_batches, materialise, pairs, table, texts

LEAST, MASK_BITS, MOST = 512, 11, 16384


def normalise(text: bytes) -> bytes:
    r"""Each run of [\x20\x09-\x0D] becomes one space."""
    text = text.translate(SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def cut_points(text: bytes, least: int = LEAST, bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks: where a hash of the 8 bytes before it has `bits` zero bits, at least `least` and at most `most` apart."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    words = np.ndarray((n - 7,), "<u8", text, strides=(1,))
    hits = np.flatnonzero((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) == 0) + 8
    ends, start = [], 0
    for hit in [*hits.tolist(), n]:
        while hit - start > most:
            start += most
            ends.append(start)
        if hit - start >= least or hit == n and hit > start:
            ends.append(start := hit)
    return ends


def chunks(text: bytes) -> Iterator[bytes]:
    start = 0
    for end in cut_points(text):
        yield text[start:end]
        start = end


def recipes(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, recipe (its chunks' identifiers, 16 bytes each, in order), text_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("recipe", pa.binary()), ("text_sha256", pa.string())])

    def rows(batches):
        for doc_id, text in pairs(batches):
            text = normalise(text)
            yield doc_id, b"".join(xxhash.xxh3_128_digest(c, seed) for c in chunks(text)), hashlib.sha256(text).hexdigest()

    return texts(docs).mapInArrow(lambda b: in_batches(rows(b), schema), "doc_id long, recipe binary, text_sha256 string")


def collisions(docs: DataFrame, seed: int) -> DataFrame:
    """Identifiers that two different chunks share; each distinct chunk of a partition is moved once."""
    schema = pa.schema([("id", pa.binary()), ("chunk", pa.binary())])

    def rows(batches):
        seen: dict[bytes, bytes] = {}
        held = 0
        for _, text in pairs(batches):
            for chunk in chunks(normalise(text)):
                key = xxhash.xxh3_128_digest(chunk, seed)
                if seen.get(key) != chunk:
                    yield key, chunk
                    if held > 32 << 20:  # the memory of what was sent is bounded; sending a chunk again is harmless
                        seen.clear()
                        held = 0
                    seen[key] = chunk
                    held += len(chunk) + 150

    sent = texts(docs).mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: len(r[1]) + 16), "id binary, chunk binary")
    return sent.groupBy("id").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("lo <> hi").select("id")


def exact_dedup(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: see the module's docstring."""
    while not collisions(docs, seed).isEmpty():
        seed += 1
    found = recipes(docs, seed)
    # by recipe and doc_id, before the join: rows of one group of copies are spread, and the join by recipe alone can be split if skewed
    first = F.row_number().over(Window.partitionBy("recipe", "doc_id").orderBy("text_sha256")) == 1
    marked = found.withColumn("first", first)
    # stored, so that the join has a shuffle of its own on both sides, which a skewed recipe's rows can be split over
    groups = materialise(found.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    return (
        marked.join(groups, "recipe")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first"))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""
