"""Vector code compression: product codes whose nearest entries are found by a VA-file filter, in integers only.

A component x becomes floor(1024 * x); a vector is cut into equal parts, and each part is coded by the index of the nearest of
that part's 256 codebook entries. The entries start as the parts of the smallest vec_ids and are moved by rounds of Lloyd's
algorithm with floored means. All of it is integer arithmetic, so the result doesn't depend on how rows are dealt out.

The nearest entry is found as in a VA-file: each entry coordinate is quantised to a cell of a few bits, a query gets a table of
its least and greatest squared distance to each cell of each dimension, sums over these tables bound the distance to
every entry, and only entries whose lower bound doesn't exceed the least upper bound are compared by exact integer distances.

What goes to the driver is the codebooks (256 x dimension) and a sum for each entry; each task sends at most a row an entry.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are those that don't have
the table's dimension, which is its commonest (of equally common ones the largest). Null vec_ids sort last among the first entries; rows that share a vec_id are
told apart by their components. With fewer than 256 kept vectors there are as many entries. Copies of a vector are rows
of their own. An empty table gives no rows. A dimension that the parts don't divide, or a scaled component of 2^62 or more,
is an error; an error (distance) of 2^63 or more is null, as are the sums that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SCALE, MOST = 1024, 1 << 62


@dataclass(frozen=True)
class Coder:
    """parts of a vector; entries of a part's codebook (256 at most, for two hex digits); rounds; bits of a coordinate's cell."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    bits: int = 4


class Cells:
    """The VA-file of one part's entries: for each dimension the cell of each entry and the range that each cell spans."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries = entries
        n, width = entries.shape
        count = min(1 << bits, n)
        order = np.argsort(entries, axis=0, kind="stable")
        self.cell = np.empty((n, width), np.int64)
        np.put_along_axis(self.cell, order, np.broadcast_to((np.arange(n) * count // n)[:, None], (n, width)), 0)
        ranked, edge = np.take_along_axis(entries, order, 0), [-(-c * n // count) for c in range(count + 1)]
        self.low = np.array([ranked[a] for a in edge[:-1]], entries.dtype).reshape(count, width)
        self.high = np.array([ranked[b - 1] for b in edge[1:]], entries.dtype).reshape(count, width)

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Whether each entry may be the nearest of each query."""
        lower = np.zeros((len(queries), len(self.entries)), queries.dtype)
        upper = lower.copy()
        for d in range(queries.shape[1]):
            q, low, high = queries[:, d, None], self.low[:, d], self.high[:, d]
            near = (np.maximum(low - q, 0) + np.maximum(q - high, 0)) ** 2
            far = np.maximum(high - q, q - low) ** 2
            lower += near[:, self.cell[:, d]]
            upper += far[:, self.cell[:, d]]
        return (lower <= upper.min(1)[:, None]).astype(bool)

    def nearest(self, queries: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The index of each query's nearest entry (of equally near ones the first), and its squared distance."""
        index, distance = np.zeros(len(queries), np.int64), np.zeros(len(queries), queries.dtype)
        for k in range(0, len(queries), block):
            part = queries[k : k + block]
            row, entry = np.nonzero(self.candidates(part))
            exact = ((part[row] - self.entries[entry]) ** 2).sum(1)
            start = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(exact, start)
            hit = np.flatnonzero(exact == least[row])
            first = hit[np.searchsorted(row[hit], np.arange(len(part)))]
            index[k : k + block], distance[k : k + block] = entry[first], least
        return index, distance


def scaled(vectors: DataFrame, coder: Coder) -> tuple[DataFrame, int]:
    """The kept rows as vec_id, label and v (scaled components), stored; and their dimension."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL").where(finite)
    fits = F.transform("embedding", lambda x: F.when(F.abs(x) < MOST // SCALE, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"a component of {MOST // SCALE} or more has no exact code"))).cast("long"))
    sizes = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = sizes.n if sizes else 0
    if dim % coder.parts:
        raise ValueError(f"{coder.parts} parts don't divide a dimension of {dim}")
    return materialise(kept.where(F.size("embedding") == dim).select("vec_id", "label", fits.alias("v")), "scaled-vectors"), dim


def first_entries(rows: DataFrame, dim: int, coder: Coder) -> list[list[int]]:
    """The vectors of the smallest vec_ids, in order."""
    return [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(coder.entries).collect()]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def exact(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where no sum of squares can pass 63 bits, else as Python's."""
    most = max([1, *(int(np.abs(x).max()) for x in (v, books) if x.size)])
    wide = 4 * most * most * max(1, v.shape[1]) >= 1 << 63
    return (v.astype(object), books.astype(object)) if wide else (v, books)


def coded(v: np.ndarray, books: np.ndarray, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each part of each vector, and the squared distances to them; books: an entry's vector a row, all parts side by side."""
    v, books = exact(v, books)
    width = v.shape[1] // coder.parts
    found = [Cells(books[:, p * width : (p + 1) * width], coder.bits).nearest(v[:, p * width : (p + 1) * width]) for p in range(coder.parts)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def moved(rows: DataFrame, books: np.ndarray, coder: Coder) -> np.ndarray:
    """The codebooks after a round: each entry that parts were assigned to is their floored mean."""
    dim = books.shape[1]
    width = dim // coder.parts

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((coder.parts, len(books), width), object), np.zeros((coder.parts, len(books)), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            v = matrix(batch.column(0), dim)
            index, _ = coded(v, books, coder)
            wide = exact(v, books)[0].dtype == object or len(v) * int(np.abs(v).max(initial=1)) >= 1 << 62
            for p in range(coder.parts):
                own = np.zeros((len(books), width), object if wide else np.int64)
                np.add.at(own, index[:, p], v[:, p * width : (p + 1) * width].astype(own.dtype))
                total[p] += own
                count[p] += np.bincount(index[:, p], minlength=len(books))
        part, entry = np.nonzero(count)
        texts = [[str(x) for x in total[p, e]] for p, e in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(texts, pa.list_(pa.string()))], ["part", "entry", "n", "v"])

    sent = rows.select("v").mapInArrow(sums, "part int, entry int, n long, v array<string>")
    summed = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[k].cast("decimal(38,0)")).alias(f"v{k}") for k in range(width)])
    books = books.copy()
    for part, entry, n, *total in summed.collect():  # a row an entry
        books[entry, part * width : (part + 1) * width] = [int(x) // n for x in total]
    return books


def digest(books: np.ndarray, coder: Coder) -> str:
    """Of all components, by part, entry and place."""
    width = books.shape[1] // coder.parts
    numbers = (str(x) for p in range(coder.parts) for x in books[:, p * width : (p + 1) * width].ravel().tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def vector_codes(vectors: DataFrame, coder: Coder | None = None) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of each kept vector (stored), and the codebooks."""
    coder = coder or Coder()
    rows, dim = scaled(vectors, coder)
    first = first_entries(rows, dim, coder)
    books = np.array(first, np.int64).reshape(len(first), dim)
    for _ in range(coder.rounds if len(books) else 0):
        books = moved(rows, books, coder)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            index, distance = coded(matrix(batch.column(2), dim), books, coder)
            errors = [e if e < 1 << 63 else None for e in distance.astype(object).sum(1).tolist()]
            code = [row.tobytes().hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return materialise(rows.mapInArrow(codes, f"vec_id long, label {kind}, code string, error long"), "vector-codes"), books


def with_label_errors(found: DataFrame) -> DataFrame:
    """found with label_error, the error summed over the rows of its label (nulls together)."""
    whole = F.when(F.count("*") == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)")))
    # stored, so that a hot label's rows can be split in the join
    sums = materialise(found.groupBy(F.col("label").alias("label_")).agg(whole.try_cast("long").alias("label_error")), "label-errors")
    return found.join(sums, found["label"].eqNullSafe(sums["label_"])).drop("label_")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = Coder()
    found, books = vector_codes(table(spark, sf_dir, "embeddings"), coder)
    return with_label_errors(found).select("vec_id", "code", "error", "label_error", F.lit(digest(books, coder)).alias("codebooks_sha256"), "label")
