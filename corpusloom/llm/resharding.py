"""Minimum-cost-flow resharding.

The old layout lies in files: a folder a shard, in it a folder a block, its rows placed by a hash of what identifies
them alone, so growth of the table moves no row to another old shard. From the old shards' sizes and the new shards' capacities (equal bytes) a
minimum-cost flow tells how many bytes go from where to where; staying costs nothing, so the fewest bytes
move. Each old shard's blocks are dealt to its flows in order: most stay or move whole. The few blocks in
which a flow ends are dealt by cells, finer pieces of the same hash, the largest first, to where most room is left.

Only affected blocks, those that lose or give a row, are rewritten: all of their rows go to new files
under their new shard. The new layout of a shard is its blocks that were left alone and its new files, and the result is
read from these.

The flow is solved on the driver over old and new shards, a bounded number of block sizes, and the cells of split
blocks, whatever the number of rows. Law `bytes`: shards differ by about a small cell, which is a few rows of a small table and
some 1 in 65,536 of a large one. Defined results: a null text has size 8; repeated rows are placed each for itself; with no
rows the result is empty; slots within a shard are gapless from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, table


@dataclass(frozen=True)
class Layout:
    """blocks: folders of an old shard; cells: pieces of a block. Both are bounds of the plan, not of the rows."""

    old: int = 16
    new: int = 24
    blocks: int = 16
    cells: int = 256


ROW = "doc_id long, text binary, size long, text_crc32 long, cell int"


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[dict[int, int]]:
    """Bytes from each old shard to each new one at the least cost(i, j) a byte: successive shortest paths.

    supply and capacity must have equal sums. Graph: source, old shards, new shards, sink.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost; the edge back is next to it
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def link(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, bytes_ in enumerate(supply):
        link(source, i, bytes_, 0)
    for i in range(n):
        for j in range(m):
            link(i, n + j, min(supply[i], capacity[j]), cost(i, j))
    for j, bytes_ in enumerate(capacity):
        link(n + j, sink, bytes_, 0)
    while True:
        far, way, queue = {source: 0}, {}, [source]
        while queue:  # Bellman-Ford by queue
            a = queue.pop(0)
            for e in out[a]:
                b, room, price = edges[e]
                if room > 0 and far[a] + price < far.get(b, 1 << 60):
                    far[b], way[b] = far[a] + price, e
                    if b not in queue:
                        queue.append(b)
        if sink not in way:
            break
        path, at = [], sink
        while at != source:
            path.append(way[at])
            at = edges[way[at] ^ 1][0]
        move = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= move
            edges[e ^ 1][1] += move
    flows: list[dict[int, int]] = [{} for _ in supply]
    for i in range(n):
        for e in out[i]:
            if not e & 1 and edges[e ^ 1][1]:
                flows[i][edges[e][0] - n] = edges[e ^ 1][1]
    return flows


def deal(blocks: dict[int, int], flows: dict[int, int], home: int) -> tuple[dict[int, int], dict[int, list[tuple[int, int]]]]:
    """One old shard's blocks by destination, and the blocks to split with their destinations' bytes; the shard's own part is first."""
    whole, split = {}, {}
    parts = sorted(flows.items(), key=lambda f: (f[0] != home, f[0]))
    k, room = 0, parts[0][1] if parts else 0
    for block, size in sorted(blocks.items()):
        shares = []
        while size > room and k + 1 < len(parts):
            if room:
                shares.append((parts[k][0], room))
            size -= room
            k += 1
            room = parts[k][1]
        shares.append((parts[k][0], size))
        room -= size
        if len(shares) == 1:
            whole[block] = shares[0][0]
        else:
            split[block] = shares
    return whole, split


def capacities(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def write_old(docs: DataFrame, layout: Layout, path: str) -> DataFrame:
    """Write docs as the old layout, shard=i/block=b; returns it as it is on disk."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    every = layout.old * layout.blocks
    piece = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(every * layout.cells))
    rows = rows.withColumn("piece", piece).withColumn("cell", (F.col("piece") % layout.cells).cast("int")).withColumn("block", F.expr(f"CAST(piece DIV {layout.cells} AS INT)"))
    rows = rows.withColumn("shard", F.expr(f"block DIV {layout.blocks}").cast("int")).drop("piece")
    # a block's rows meet in as many tasks as there are partitions a block
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "block", F.pmod("cell", F.lit(-(-parts // every)))).write.partitionBy("shard", "block").option("compression", "zstd").parquet(path)
    return spark.read.schema(f"{ROW}, shard int, block int").parquet(path)


def shared_out(cells: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """Each cell's destination: the largest first, to where most room is left; room is what is left then."""
    to = {}
    for cell, size in sorted(cells.items(), key=lambda c: (-c[1], c[0])):
        to[cell] = shard = max(room, key=lambda j: (room[j], -j))
        room[shard] -= size
    return to


@dataclass
class Plan:
    """Blocks that stay whole, the shard of each that moves whole, and of each cell of a split block."""

    stay: list[int]
    blocks: dict[int, int]
    cells: dict[tuple[int, int], int]


def planned(old: DataFrame, layout: Layout) -> Plan:
    """From the block sizes (at most old * blocks rows) and the cell sizes of split blocks (at most cells for each of old + new flows)."""
    sizes = {r.block: r.bytes for r in old.groupBy("block").agg(F.sum("size").alias("bytes")).collect()}
    of_shard = [{b: s for b, s in sizes.items() if b // layout.blocks == i} for i in range(layout.old)]
    supply = [sum(x.values()) for x in of_shard]
    flows = min_cost_flow(supply, capacities(sum(supply), layout.new), lambda i, j: 0 if i == j else 1)
    plan, split = Plan([], {}, {}), []
    for i, blocks in enumerate(of_shard):
        whole, parts = deal(blocks, flows[i], i)
        plan.stay += [b for b, j in whole.items() if i == j]
        plan.blocks |= {b: j for b, j in whole.items() if i != j}
        split.append(parts)
    found = old.where(F.col("block").isin([b for parts in split for b in parts])).groupBy("block", "cell").agg(F.sum("size").alias("bytes")).collect()
    over: dict[int, int] = {}  # what an old shard's cells left or took too much is made up for by the next one's
    for parts in split:
        room: dict[int, int] = {}
        for shares in parts.values():
            for j, share in shares:
                room[j] = room.get(j, over.pop(j, 0)) + share
        plan.cells |= shared_out({(r.block, r.cell): r.bytes for r in found if r.block in parts}, room)
        over |= room
    return plan


def rewritten(old: DataFrame, plan: Plan) -> DataFrame:
    """The rows of affected blocks, with the shard they go to."""
    spark = old.sparkSession
    blocks = spark.createDataFrame(list(plan.blocks.items()), "block int, to int")  # at most old * blocks rows
    cells = spark.createDataFrame([(*k, j) for k, j in plan.cells.items()], "block int, cell int, to int")  # at most cells for each flow
    whole = old.where(F.col("block").isin(list(plan.blocks))).join(F.broadcast(blocks), "block")
    split = old.where(F.col("block").isin(sorted({b for b, _ in plan.cells}))).join(F.broadcast(cells), ["block", "cell"])
    return whole.unionByName(split).select("doc_id", "text", "size", "text_crc32", "cell", "block", F.col("shard").alias("old_shard"), F.col("to").alias("shard"))


def new_layout(spark: SparkSession, path: str, stay: list[int]) -> DataFrame:
    """Every row of the new layout as it is on disk: blocks left alone, and new files. moved: whether it lay in another shard."""
    kept = spark.read.schema(f"{ROW}, shard int, block int").parquet(f"{path}/old").where(F.col("block").isin(stay)).withColumn("moved", F.lit(False))
    new = spark.read.schema(f"{ROW}, block int, old_shard int, shard int").parquet(f"{path}/new").withColumn("moved", F.col("shard") != F.col("old_shard"))
    return kept.unionByName(new.drop("old_shard"))


def reshard(docs: DataFrame, layout: Layout | None = None, path: str | None = None) -> DataFrame:
    """Write the old layout under path/old and the affected rows under path/new; returns where each row of the new layout is: doc_id, size, text_crc32, shard, slot, block, moved."""
    layout, spark = layout or Layout(), docs.sparkSession
    path = path or shared_path(spark, "reshard")
    old = write_old(docs, layout, f"{path}/old")
    plan = planned(old, layout)
    rewritten(old, plan).write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/new")
    every = new_layout(spark, path, plan.stay)
    pieces = every.groupBy("shard", "block", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block", "cell").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # sizes and checksums are those of the texts that were read back
    read = every.select("doc_id", (F.octet_length("text") + F.lit(8)).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), "shard", "block", "cell", "moved")
    inside = F.row_number().over(Window.partitionBy("shard", "block", "cell").orderBy("doc_id", "text_crc32", "size"))
    return read.withColumn("inside", inside).join(base, ["shard", "block", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("inside") - 1).cast("long").alias("slot"), "block", "moved")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reshard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved")
