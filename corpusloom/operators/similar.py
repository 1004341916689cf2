"""A cosine threshold join of unit vectors by prefix-filtered inverted lists.

Dimensions are ordered by how few vectors use them. Of a vector, the prefix is as many of its dimensions, in that order, as leave
a rest whose norm is below the threshold: two vectors that have no dimension of both prefixes in common have a dot product of at most
that norm. So vectors are only listed under the dimensions of their prefix, and pairs meet list by list, in blocks of both sides
with bounded numbers of rows; a pair that meets in several lists counts in the first.

Defined results: null vectors and zero vectors are in no pair; ids that are repeated give their pairs each; the smallest threshold is above 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .search import stored

#: Rows of each side that meet in a group.
BLOCK = 2048


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def prefix_lengths(ranked: np.ndarray, threshold: float) -> np.ndarray:
    """Of vectors whose columns are in order: how many columns, from the first, leave a rest below the threshold."""
    rest = np.sqrt(np.maximum(np.cumsum((ranked**2)[:, ::-1], 1)[:, ::-1], 0))  # the norm from each column on
    return (rest >= threshold - 1e-9).sum(1)


def listed(rows: DataFrame, order: list[int], threshold: float) -> DataFrame:
    """dim (its place in the order), id, vector (its columns in order), upto (its prefix) of each dimension of each row's prefix."""
    kind = to_arrow_type(rows.schema["id"].dataType)
    columns = np.array(order)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                v = _rows(part.column(1))[:, columns]
                upto = prefix_lengths(v, threshold)
                row, dim = np.nonzero((v != 0) & (np.arange(v.shape[1]) < upto[:, None]))
                vector = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * v.shape[1], pa.int32()), pa.array(v[row].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(dim, pa.int32()), part.column(0).take(pa.array(row)).cast(kind), vector, pa.array(upto[row], pa.int32())], ["dim", "id", "vector", "upto"])

    return rows.mapInArrow(lists, f"dim int, id {rows.schema['id'].dataType.simpleString()}, vector array<double>, upto int")


def cosine_join(left: DataFrame, right: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a, b, score (rounded to nine digits): the pairs of left's (id, vector) and right's whose dot product is the threshold or more; vectors are unit vectors."""
    left, right = (stored(x.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL"), "cosine-side") for x in (left, right))
    used = right.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.count(F.when(F.col("x") != 0, 1)).alias("n")).collect()  # a row a dimension
    order = [r.dim for r in sorted(used, key=lambda r: (r.n, r.dim))]
    kinds = [to_arrow_type(x.schema["id"].dataType) for x in (left, right)]
    shape = f"a {left.schema['id'].dataType.simpleString()}, b {right.schema['id'].dataType.simpleString()}, score double"
    if not order:
        return left.sparkSession.createDataFrame([], shape)
    sides = [stored(listed(x, order, threshold), "cosine-lists") for x in (left, right)]
    # how many blocks each list takes on each side: at most a row a dimension
    blocks = [{r.dim: max(1, -(-r.n // block)) for r in x.groupBy("dim").agg(F.count("*").alias("n")).collect()} for x in sides]
    number = lambda k: F.create_map(*[F.lit(x) for d in range(len(order)) for x in (d, blocks[k].get(d, 1))])[F.col("dim")]
    own = lambda k: F.pmod(F.xxhash64("id", "vector"), number(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), number(k) - 1))
    one = sides[0].withColumn("x", own(0)).withColumn("y", every(1))
    two = sides[1].withColumn("y", own(1)).withColumn("x", every(0))

    def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = [], [], []
        if len(a) and len(b):
            dim = key[0].as_py()
            va, vb = (_rows(t.column("vector").combine_chunks()) for t in (a, b))
            score = np.round(va @ vb.T, 9)
            # dimensions before this one that both use, within both prefixes, which end after it
            before = (va[:, :dim] != 0).astype(np.float32) @ (vb[:, :dim] != 0).astype(np.float32).T
            x, y = np.nonzero((score >= threshold) & (before == 0))
            out = a.column("id").take(pa.array(x)), b.column("id").take(pa.array(y)), score[x, y]
        return pa.table([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in (out[0] if len(out[0]) else pa.array([], kinds[0]), out[1] if len(out[1]) else pa.array([], kinds[1]), pa.array(out[2], pa.float64()))], ["a", "b", "score"])

    return one.groupBy("dim", "x", "y").cogroup(two.groupBy("dim", "x", "y")).applyInArrow(meet, shape)
