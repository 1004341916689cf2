"""A stored vector table: blocks of vectors by pivot cell, exact nearest vectors by the triangle inequality.

The first write picks pivots among its vectors (one for each block's worth of them, up to a bound); each vector lies in the cell of its nearest pivot, and cells are cut by the distance to
the pivot into blocks of bounded size that carry their least and greatest distance. For a query at distance d of a pivot no
vector of a block is nearer than d - greatest or least - d, so blocks beyond the query's bound are not read. The bound comes from counts alone.

Queries and blocks meet by shelf: neighbouring stretches, which are consecutive blocks of a cell, of at most `STRETCH` numbers together. A group is one shelf and some
`QUERIES` queries, whatever their number, and gives each query's best of all the shelf's vectors, so what is planned and shuffled grows with queries times shelves, not blocks.

A key that is written again replaces its vector: a delta's keys hide those of earlier generations. Dimension and model are
part of the stored metadata, and writing other ones is an error.

Defined results: null keys or vectors aren't stored; of repeated keys in one write one row stays (the greatest vector); distances are rounded to six digits
and dot products to nine, ties go to the smaller key; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .search import POOL, held, stored
from .tables import Generations, kept_root

#: Vectors of a block, queries of a group, pivots at most.
VECTORS, QUERIES, PIVOTS = 1024, 2048, 64
#: Numbers of a shelf's vectors; distances, or numbers of pairs, that a task holds at once.
STRETCH = 1 << 21
#: Shelves of a table that could do with fewer, so that tasks share it.
SPREAD = 8


class Mismatch(ValueError):
    """Vectors of another dimension or model than the table holds."""


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


class VectorTable:
    """Vectors under a folder. key: the column that names one, kind: its type."""

    def __init__(self, spark: SparkSession, root: str, key: str = "vec_id", kind: str = "bigint", block: int = VECTORS, pivots: int = PIVOTS):
        self.spark, self.key, self.kind, self.block, self.most_pivots = spark, key, kind, block, pivots
        self.table, self._chosen = Generations(spark, root), {}
        self.shape = f"cell int, part long, n long, least double, greatest double, keys array<{kind}>, vectors array<float>"

    # -- metadata

    def metadata(self) -> dict:
        """dimensions, model and rows (with replaced ones) of the table; {} before the first write."""
        rows = self.table.committed()
        return {"dimensions": int(rows[0].what["dimensions"]), "model": rows[0].what["model"], "rows": sum(int(r.what["rows"]) for r in rows)} if rows else {}

    def check(self, dimensions: int, model: str) -> None:
        have = self.metadata()
        if have and (have["dimensions"], have["model"]) != (dimensions, model):
            raise Mismatch(f"this table holds {have['dimensions']}-dimensional vectors of {have['model']}, not {dimensions}-dimensional ones of {model}: write them to a new table")

    def pivots(self) -> np.ndarray:
        """At most `pivots` vectors."""
        return self._pivots(self.table.committed()[0].what["pivots"])

    def _pivots(self, home: str) -> np.ndarray:
        if home not in self._chosen:
            rows = self.spark.read.parquet(self.table.path(home, "pivots")).orderBy("cell").collect()
            self._chosen = {home: np.array([r.pivot for r in rows], np.float64).reshape(len(rows), -1)}
        return self._chosen[home]

    # -- writes

    def write(self, rows: DataFrame, model: str, vector: str = "embedding", merge_at: int = 16) -> int:
        """Add vectors, or replace those whose key is there; how many were written."""
        rows = rows.select(F.col(self.key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).where("key IS NOT NULL AND vector IS NOT NULL")
        rows = stored(rows.groupBy("key").agg(F.max("vector").alias("vector")), "vectors-new")
        sizes = rows.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
        if not sizes.n:
            return 0
        if sizes.least != sizes.most:
            raise Mismatch(f"vectors of {sizes.least} to {sizes.most} dimensions in one write")
        self.check(sizes.most, model)
        generation, old = self.table.fresh(), self.table.committed()
        if old:
            home = old[0].what["pivots"]
        else:
            home = generation
            cells = min(self.most_pivots, max(1, sizes.n // self.block))
            picked = rows.orderBy(F.xxhash64("vector"), "vector").select("vector").limit(cells).collect()
            chosen = sorted({tuple(r.vector) for r in picked})
            self.spark.createDataFrame([(k, list(v)) for k, v in enumerate(chosen)], "cell int, pivot array<float>").coalesce(1).write.parquet(self.table.path(generation, "pivots"))
        self._write(rows, generation, self._pivots(home))
        self.table.commit(generation, {"rows": sizes.n, "dimensions": sizes.most, "model": model, "pivots": home})
        if len(self.table.committed()) >= merge_at:
            self.merge()
        return sizes.n

    def _write(self, rows: DataFrame, generation: str, pivots: np.ndarray) -> None:
        parts, most, shape, dim = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.block, self.shape, pivots.shape[1]
        kind = to_arrow_type(rows.schema["key"].dataType)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = _far(_matrix(batch.column(1), dim), pivots)
                cell = away.argmin(1) if len(batch) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell]), *batch.columns], ["cell", "away", "key", "vector"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                cells = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
                for start, stop in zip(edges[:-1], edges[1:], strict=True):
                    while start < stop:
                        if held and held[0].column(0)[0].as_py() != cells[start]:
                            yield block_of(held)
                            held = []
                        room = most - sum(map(len, held))
                        held.append(batch.slice(start, min(room, stop - start)))
                        start += len(held[-1])
                        if len(held[-1]) == room:
                            yield block_of(held)
                            held = []
            if held:
                yield block_of(held)

        def block_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            away = rows.column("away").to_numpy()
            keys, flat = rows.column("key").to_pylist(), rows.column("vector").combine_chunks().flatten()
            one = [pa.array([held[0].column(0)[0].as_py()], pa.int32()), pa.array([0]), pa.array([len(away)]), pa.array([away.min()]), pa.array([away.max()])]
            return pa.RecordBatch.from_arrays([*one, pa.array([keys], pa.list_(kind)), pa.array([flat], pa.list_(pa.float32()))], ["cell", "part", "n", "least", "greatest", "keys", "vectors"])

        near = rows.mapInArrow(placed, f"cell int, away double, key {self.kind}, vector array<float>")
        ranged = near.repartitionByRange(parts, "cell", "away", "key").sortWithinPartitions("cell", "away", "key")
        blocks = ranged.mapInArrow(packed, shape)
        blocks.withColumn("part", F.monotonically_increasing_id()).write.parquet(self.table.path(generation, "blocks"))  # no two blocks share it
        rows.select("key").write.parquet(self.table.path(generation, "keys"))

    def merge(self) -> None:
        """Write what counts of all generations as one, in the cells of the first one's pivots."""
        old = self.table.committed()
        if len(old) > 1:
            generation = self.table.fresh()
            self._write(stored(self.vectors().select(F.col(self.key).alias("key"), F.col("embedding").alias("vector")), "vectors-merged"), generation, self.pivots())
            n = self.table.read("keys", f"key {self.kind}", [generation]).count()
            self.table.commit(generation, old[0].what | {"rows": n}, [r.generation for r in old])

    # -- reads

    def _hidden(self) -> DataFrame | None:
        """key, generation of each vector that a later generation replaces; None if there is one generation."""
        names = [r.generation for r in self.table.committed()]
        if len(names) < 2:
            return None
        order = F.create_map(*[F.lit(x) for k, g in enumerate(names) for x in (g, k)])
        keys = self.table.read("keys", f"key {self.kind}", names)
        last = keys.groupBy("key").agg(F.max(F.struct(order[F.col("generation")].alias("k"), "generation")).alias("last"), F.count("*").alias("times")).where("times > 1")
        return keys.join(last.select("key", F.col("last.generation").alias("stays")), "key").where("generation <> stays").select("key", "generation")

    def blocks(self) -> DataFrame:
        return self.table.read("blocks", self.shape, [r.generation for r in self.table.committed()])

    def vectors(self) -> DataFrame:
        """The key and embedding of every vector that counts."""
        dim = self.metadata().get("dimensions", 1)
        each = self.blocks().select("generation", "vectors", F.posexplode("keys").alias("k", "key")).select("key", "generation", F.slice("vectors", F.col("k") * dim + 1, dim).alias("embedding"))
        hidden = self._hidden()
        each = each if hidden is None else each.join(hidden, ["key", "generation"], "left_anti")
        return each.select(F.col("key").alias(self.key), "embedding")

    def nearest(self, queries: DataFrame, limit: int = POOL, kind: str = "l2") -> DataFrame:
        """qid, the key, value, rank: the `limit` vectors of least L2 distance, or of greatest dot product, of each query (qid, query).

        For dot products every block is read: they obey no triangle inequality.
        """
        meta = self.metadata()
        qid = queries.schema["qid"].dataType.simpleString()
        if not meta:
            return self.spark.createDataFrame([], f"qid {qid}, {self.key} {self.kind}, value double, rank int")
        dim, pivots, queries = meta["dimensions"], self.pivots(), held(queries.select("qid", F.col("query").cast("array<double>").alias("query")).where("query IS NOT NULL"), "vector-queries", QUERIES)
        stretches = self.stretches()
        visits = self.visits(queries, limit, kind, pivots, stretches)
        groups = max(1, -(-queries.count() // QUERIES))
        ours = visits.where("lead").select("shelf", F.pmod(F.xxhash64("qid", "query"), F.lit(groups)).cast("int").alias("deal"), "qid", "query", "bound")
        visited = held(stretches.join(held(visits.select("cell", "turn", "shelf").distinct(), "vector-visited"), ["cell", "turn"]).select("generation", "cell", "part", "shelf"), "vector-visits")
        names, blocks, hidden = ["generation", "cell", "part"], self.blocks(), self._hidden()
        if hidden is not None:  # replaced vectors are left out before the best are kept
            blocks = self._without(blocks, stored(hidden, "vectors-hidden"), names, dim)
        theirs = blocks.join(visited, names).select("shelf", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("deal"), "keys", "vectors")
        keys = ["shelf", "deal"]
        kinds = [to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(self.blocks().schema["keys"].dataType.elementType)]

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [pa.array([], k) for k in (*kinds, pa.float64())]
            if len(left) and len(right):
                names, flat = (right.column(c).combine_chunks().flatten() for c in ("keys", "vectors"))
                order = pc.sort_indices(names)  # so that ties go to the smaller key
                names, v = names.take(order), flat.to_numpy().reshape(-1, dim)[order.to_numpy()].astype(np.float64)
                q, bound = _matrix(left.column("query").combine_chunks(), dim), left.column("bound").to_numpy()
                most = max(1, STRETCH // len(v))
                found = [(k, *_kept(q[k : k + most], v, bound[k : k + most], limit, kind)) for k in range(0, len(q), most)]
                x, y, value = (np.concatenate(c) for c in zip(*[(k + x, y, value) for k, x, y, value in found], strict=True))
                out = [left.column("qid").combine_chunks().take(pa.array(x)), names.take(pa.array(y)), pa.array(value)]
            return pa.Table.from_arrays(out, ["qid", "key", "value"])

        met = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(meet, f"qid {qid}, key {self.kind}, value double")
        first = F.row_number().over(Window.partitionBy("qid").orderBy("value" if kind == "l2" else F.desc("value"), "key"))
        return met.withColumn("rank", first).where(F.col("rank") <= limit).select("qid", F.col("key").alias(self.key), "value", "rank")

    def _without(self, blocks: DataFrame, gone: DataFrame, keys: list[str], dim: int) -> DataFrame:
        """Blocks without the vectors whose key and generation are in gone; keys name a block."""
        listed = blocks.select(*keys, F.posexplode("keys").alias("k", "key")).join(gone, ["key", "generation"], "left_semi").groupBy(*keys).agg(F.collect_set("k").alias("gone"))  # of one block at most all its vectors
        stay = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda k: ~F.array_contains(F.col("gone"), k))
        rows = blocks.join(listed, keys, "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))).withColumn("stay", F.when(F.size("gone") == 0, F.sequence(F.lit(0), F.size("keys") - 1)).otherwise(stay))
        rows = rows.where("size(gone) < size(keys)")
        cut = F.flatten(F.transform("stay", lambda k: F.slice("vectors", k * dim + 1, dim)))
        return rows.select(*keys, F.when(F.size("gone") == 0, F.col("keys")).otherwise(F.transform("stay", lambda k: F.get("keys", k))).alias("keys"), F.when(F.size("gone") == 0, F.col("vectors")).otherwise(cut).alias("vectors"))

    def _room(self) -> int:
        """Vectors of a shelf, or of a stretch but for its last block: by vectors, as blocks that a partition's end cut off are small."""
        meta = self.metadata()
        return max(1, min(STRETCH // meta["dimensions"], -(-meta["rows"] // SPREAD)))

    def stretches(self) -> DataFrame:
        """The blocks' numbers (generation, cell, part, n, least, greatest) and the turn of each block's stretch in its cell, by distance to the pivot."""
        before = F.sum("n").over(Window.partitionBy("cell").orderBy("least", "generation", "part").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
        return held(self.blocks().select("generation", "cell", "part", "n", "least", "greatest", F.floor(F.coalesce(before, F.lit(0)) / self._room()).cast("int").alias("turn")), "vector-stretches")

    def visits(self, queries: DataFrame, limit: int, kind: str, pivots: np.ndarray, stretches: DataFrame | None = None) -> DataFrame:
        """qid, query, cell, turn, shelf, lead, bound: the stretches that can hold one of a query's nearest, which are at most `bound` away; for dot products all. One of a query and shelf leads."""
        replaced = self.metadata()["rows"] - self.table.read("keys", f"key {self.kind}").select("key").distinct().count() if len(self.table.committed()) > 1 else 0
        every = self.stretches() if stretches is None else stretches
        every = every.groupBy("cell", "turn").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
        every = sorted(every.collect(), key=lambda r: (r.cell, r.turn))  # a row a stretch
        cell, turn, counts, least, greatest = (np.array([r[k] for r in every]) for k in ("cell", "turn", "n", "least", "greatest"))
        shelf, used, room = [], 0, self._room()
        for r in every:
            new = used > 0 and used + r.n > room
            shelf.append(shelf[-1] + new if shelf else 0)
            used = r.n if new else used + r.n
        shelf = np.array(shelf)
        kinds, dim = to_arrow_type(queries.schema["qid"].dataType), pivots.shape[1]
        enough = limit + replaced  # as many vectors hold `limit` that count

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (b.slice(k, QUERIES) for b in batches for k in range(0, len(b), QUERIES)):
                bound = np.full(len(part), np.inf)
                beyond = np.zeros((len(part), len(cell)), bool)
                if kind == "l2":
                    away = _far(_matrix(part.column(1), dim), pivots)[:, cell]
                    reach = np.take_along_axis(away + greatest, order := np.argsort(away + greatest, 1), 1)
                    full = np.cumsum(counts[order], 1) >= enough
                    bound = np.where(full.any(1), reach[np.arange(len(away)), full.argmax(1)], np.inf) + 1e-5
                    beyond = np.maximum(away - greatest, least - away) > bound[:, None]
                row, at = np.nonzero(~beyond)
                own, place = part.take(pa.array(row)), row * len(cell) + shelf[at]
                numbers = [pa.array(c, pa.int32()) for c in (cell[at], turn[at], shelf[at])]
                yield pa.RecordBatch.from_arrays([own.column(0).cast(kinds), own.column(1), *numbers, pa.array(np.diff(place, prepend=-1) > 0), pa.array(bound[row])], ["qid", "query", "cell", "turn", "shelf", "lead", "bound"])

        qid = queries.schema["qid"].dataType.simpleString()
        return queries.select("qid", "query").mapInArrow(near, f"qid {qid}, query array<double>, cell int, turn int, shelf int, lead boolean, bound double")


def _kept(q: np.ndarray, v: np.ndarray, bound: np.ndarray, limit: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and vectors, and values, of each query's best `limit` within its bound; of equal values the first vectors stay."""
    last = lambda far: np.partition(far, limit - 1, 1)[:, limit - 1] if limit <= len(v) else np.full(len(q), np.inf)
    if kind == "dot":
        value = np.round(q @ v.T, 9)
        x, y = np.nonzero((-value <= last(-value)[:, None]) & np.isfinite(value))
        value = value[x, y]
        sign = -value
    else:
        # squares by one product, off by little, tell which pairs' distances are worked out by differences
        ours, theirs = (q * q).sum(1), (v * v).sum(1)
        off = (q.shape[1] + 8) * 1e-15 * (ours + theirs[np.isfinite(theirs)].max(initial=0))
        square = q @ v.T
        square *= -2
        square += ours[:, None]
        square += theirs
        np.fmin(square, np.inf, out=square)  # not a number counts as farthest
        upper = np.fmin(np.sqrt(np.maximum(last(square), 0) + off), bound) + 2e-6  # rounding moves both by half a millionth
        x, y = np.nonzero(square <= ((upper * upper) * (1 + 1e-12) + off)[:, None])
        step = max(1, STRETCH // v.shape[1])
        pieces = [np.round(np.sqrt(((q[x[k : k + step]] - v[y[k : k + step]]) ** 2).sum(1)), 6) for k in range(0, len(x), step)]
        value = np.concatenate([np.empty(0), *pieces])
        stay = value <= bound[x]
        x, y, value = x[stay], y[stay], value[stay]
        sign = value
    order = np.lexsort((y, sign, x))
    x, y, value = x[order], y[order], value[order]
    first = np.arange(len(x)) - np.searchsorted(x, x) < limit
    return x[first], y[first], value[first]


def of_table(spark: SparkSession, table: str, vectors: DataFrame, key: str = "vec_id", model: str = "given") -> VectorTable:
    """The vectors of a table: what was stored for the same files, else it is written."""
    found = VectorTable(spark, kept_root(spark, table, "vectors"), key, vectors.schema[key].dataType.simpleString())
    if not found.table.committed():
        found.write(vectors, model)
    return found
