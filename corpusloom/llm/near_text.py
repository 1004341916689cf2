"""Near-duplicate texts by SimHash, Golay keys and least hashes, verified by exact similarity, for filtering a corpus.

Documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Candidates meet

- by the Golay keys of a 64-bit fingerprint over single words (one segment of it has at most one error) together with one
  of three least shingle hashes, and
- by 16 bands of four least shingle hashes each: pairs at a similarity of 0.8 share one in 9,998 of 10,000 cases, whatever
  their word fingerprints say.

Within a bucket, pairs whose five-word-shingle fingerprints of 128 bits differ in more than 44 bits are left out: a
similarity of 0.8 is expected to make 19.4 differ, with a deviation of 4. For all others the shingle sets
themselves are compared, unless the two are known to be in one group already: of a bucket of more than SMALL nodes first the pairs of a tree of least distances are
compared (in one of SPANNED such buckets), which holds each node's nearest and puts most of a group together with as many pairs as nodes; then all pairs of every such bucket
that are not in one group by then, within tasks that hand on nodes (those near to another group by fingerprint) and links alone.

Equal word sequences are one node.

Defined results: of a group the rows with the smallest doc_id stay; null doc_ids come last; a null text is
the empty text; texts without words are one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialise
from .components import components, united
from .simhash import LOWER, SEGMENTS, SMALL, Golay, shingle_hashes
from .suffix_dedup import in_runs, mix

WORDS, LEASTS, BANDS, BAND = 5, 3, 16, 4
#: Differing bits of the 128 up to which shingle sets are compared.
SHINGLE_BITS = 44
#: In buckets over SMALL, the nodes that one tree spans in the first pass.
BLOCK = 4096
#: One in so many large buckets gets a tree in the first pass: a group's nodes share many buckets, so a few put most of it together, with a few pairs a node.
SPANNED = 4
#: Nodes of a block when large buckets are compared by fingerprints, and when pools are by shingle sets.
BLOCKED, POOLED = 8192, 256
#: Most candidate nodes that are sent to every task to pick their texts; more are joined by shuffles.
BROADCAST_NODES = 500_000
_ODD = np.arange(1, 2 * BANDS * BAND, 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
_FOLD = np.arange(1, 2 * BAND, 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
PRINTS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.int64()), ("word", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("least", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band of least hashes of a set of shingles."""
    if not len(shingles):
        return [0] * BANDS
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, mix(shingles[k : k + 2048, None] * _ODD).min(0))
    return mix((least.reshape(BANDS, BAND) * _FOLD).sum(1, dtype=np.uint64) + _BAND_SALT).view(np.int64).tolist()


def prints(text: bytes) -> tuple:
    """node, word fingerprint, two shingle fingerprints, least shingle hashes, band keys."""
    shingles = shingle_hashes(text, WORDS)
    node = xxhash.xxh3_64_intdigest(b" ".join(text.translate(LOWER).split())) - (1 << 63)
    least = [int(mix(shingles * np.uint64(2 * k + 1) + np.uint64(k)).min().view(np.int64)) if len(shingles) else 0 for k in range(LEASTS)]
    distinct = np.unique(shingles)
    return node, _majority(shingle_hashes(text, 1)), _majority(distinct), _majority(mix(distinct * np.uint64(0x9E3779B97F4A7C15))), least, band_keys(distinct)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets (sorted, distinct) is 0.8 or more."""
    every = len(x) + len(y)
    if 9 * min(len(x), len(y)) < 4 * every:
        return False
    both = np.sort(np.concatenate([x, y]))
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * every


def closest(one: np.ndarray, two: np.ndarray, turn: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs: a tree of least distances. Over BLOCK places, one for each of the overlapping runs of both orders, each turned by `turn` bits."""
    n = len(one)
    if n > BLOCK:
        t = np.uint64(turn % 63 + 1)
        for by in (one, two):
            order = np.argsort(by << t | by >> (np.uint64(64) - t), kind="stable")
            for start in range(0, n - BLOCK // 2, BLOCK // 2):
                run = order[start : start + BLOCK]
                for x, y in closest(one[run], two[run]):
                    yield run[x], run[y]
        return
    rest, to = np.arange(1, n), np.zeros(n - 1, np.int64)
    far = np.bitwise_count(one[rest] ^ one[0]) + np.bitwise_count(two[rest] ^ two[0])
    x, y = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64)
    for i in range(n - 1):
        k = int(far.argmin())
        x[i], y[i] = to[k], (at := rest[k])
        rest[k], to[k], far[k] = rest[-1], to[-1], far[-1]
        rest, to, far = rest[:-1], to[:-1], far[:-1]
        now = np.bitwise_count(one[rest] ^ one[at]) + np.bitwise_count(two[rest] ^ two[at])
        nearer = now < far
        to[nearer] = at
        far[nearer] = now[nearer]
    yield x, y


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, one, two) for each least shingle and Golay key, and each band, of each node."""
    golay = Golay()
    names = ["key", "node", "one", "two"]
    for batch in batches:
        for start in range(0, len(batch), 4096):
            part = batch.slice(start, 4096)
            node, word, one, two = (part.column(k).to_numpy() for k in range(4))
            least = part.column(4).flatten().to_numpy().reshape(-1, LEASTS).view(np.uint64)
            for s, (at, n) in enumerate(SEGMENTS):
                codes = golay.keys((word.view(np.uint64) >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64))
                row, col = np.nonzero(codes >= 0)
                for k in range(LEASTS):
                    key = mix(least[row, k] + ((codes[row, col] << 4 | s << 2 | k).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node[row], one[row], two[row])], names)
            bands = part.column(5).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bands, *(np.repeat(c, BANDS) for c in (node, one, two)))], names)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes (a < b; part 0) of a bucket whose shingle sets are to be compared: all of a small one, a tree's of some large ones. The
    nodes of large ones go on (a: the key, b: the node, one, two; part 1)."""
    for columns in in_runs(batches):
        key, node = columns[0].to_numpy(), columns[1].to_numpy()
        one, two = (c.to_numpy().view(np.uint64) for c in columns[2:])
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(edge, len(key)))
        small = np.repeat(length <= SMALL, length)
        met = []
        for off in range(1, min(SMALL, int(length.max()))):
            at = np.flatnonzero((key[:-off] == key[off:]) & small[:-off])
            met.append((at, at + off))
        for start, n in zip(edge[length > SMALL].tolist(), length[length > SMALL].tolist(), strict=True):
            if key[start] % SPANNED:
                continue
            met += ((x + start, y + start) for x, y in closest(one[start : start + n], two[start : start + n], int(key[start])))
        pairs = near_pairs(node, one, two, met)
        none = np.zeros(len(pairs), np.int64)
        large = [c.filter(pa.array(~small)) for c in columns]
        for part, rows in ((0, [pa.array(c) for c in (pairs[:, 0], pairs[:, 1], none, none)]), (1, large)):
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.full(len(rows[0]), part, np.int32))], ["a", "b", "one", "two", "part"])


def near_pairs(node: np.ndarray, one: np.ndarray, two: np.ndarray, met) -> np.ndarray:
    """The distinct pairs (a < b), of pairs of places, whose fingerprints are near."""
    out = []
    for x, y in met:
        near = (np.bitwise_count(one[x] ^ one[y]) + np.bitwise_count(two[x] ^ two[y]) <= SHINGLE_BITS) & (node[x] != node[y])
        out.append(np.stack([np.minimum(node[x], node[y])[near], np.maximum(node[x], node[y])[near]], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def crossed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links (a, b) between the roots of the nodes (node, one, two, root, set) of two blocks: enough of them to put together what is alike but has different roots.

    Roots, not nodes: what many blocks find of the same two roots is one link.

    Near fingerprints are compared first; pairs whose roots these links have put together by then are not.
    """
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        (one, two, ra), (three, four, rb) = ([t.column(k).to_numpy() for k in ("one", "two", "root")] for t in (left, right))
        sets = [t.column("set").to_pylist() for t in (left, right)]
        far = np.bitwise_count((one[:, None] ^ three).view(np.uint64)) + np.bitwise_count((two[:, None] ^ four).view(np.uint64))
        x, y = np.nonzero((far <= SHINGLE_BITS) & (ra[:, None] != rb))
        order = np.argsort(far[x, y], kind="stable")
        up: dict[int, int] = {}

        def top(r: int) -> int:
            while (above := up.get(r, r)) != r:
                up[r] = up.get(above, above)
                r = above
            return r

        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            r, s = top(int(ra[i])), top(int(rb[j]))
            if r != s and similar(np.frombuffer(sets[0][i], np.uint64), np.frombuffer(sets[1][j], np.uint64)):
                up[max(r, s)] = min(r, s)
                out.append((int(ra[i]), int(rb[j])))
    return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_apart(one: np.ndarray, two: np.ndarray, root: np.ndarray, side: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places that are near, across the sides (bits 1 and 2), to a place of another root; and of all places the least place of their component by such nearness.

    Each pass unites every component with at least one other that it is near to, so passes grow with the logarithm of their number.
    """
    some, label = np.zeros(len(one), bool), np.arange(len(one))
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    while True:
        edges = []
        for start in range(0, len(left), step):
            x = left[start : start + step]
            near = np.bitwise_count(one[x, None] ^ one[right]) + np.bitwise_count(two[x, None] ^ two[right]) <= SHINGLE_BITS
            near &= (root[x, None] != root[right]) & (label[x, None] != label[right])
            rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            edges += [(x[rows], right[near[rows].argmax(1)]), (right[columns], x[near[:, columns].argmax(0)])]
        a, b = (np.concatenate(c) for c in zip(*edges, strict=True)) if edges else (left, left)
        if not len(a):
            return np.flatnonzero(some), label
        some[a] = True
        label = united(len(one), label[a], label[b])[label]
        left, right = left[some[left]], right[some[right]]


def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs (run, node, one, two, root, side): each node that is near one of another root, and the first of those it hangs together with."""
    for columns in in_runs(batches):
        run, node, root, side = (columns[k].to_numpy() for k in (0, 1, 4, 5))
        one, two = (columns[k].to_numpy().view(np.uint64) for k in (2, 3))
        edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        for start, end in zip(edge.tolist(), np.append(edge[1:], len(run)).tolist(), strict=True):
            at, label = near_apart(one[start:end], two[start:end], root[start:end], side[start:end])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[start + at]), pa.array(node[start + label[at]])], ["a", "b"])


def crossing(docs: DataFrame, found: DataFrame, large: DataFrame) -> DataFrame:
    """Links (a, b) that large buckets (key, node, one, two, root) hold beyond those of the roots.

    First buckets are compared by fingerprints alone, in blocks: what is near to something of another root goes on, as rows of a node, not of a pair. What
    hangs together by that is one pool, whatever buckets it came from, so that a pair which meets in many of them is compared once; a pool's shingle sets are compared
    block by block, and what a task is given is two blocks, whatever the size of bucket and pool.
    """
    blocks = F.ceil(F.count("*") / BLOCKED).cast("int").alias("blocks")
    split = large.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), blocks).where("least <> most").select("key", "blocks")
    rest = materialise(large.join(split, "key").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) AS int)")), "near-rest")
    dealt = rest.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("run"), "node", "one", "two", "root", F.expr("CASE WHEN own = other THEN 3 WHEN own < other THEN 1 ELSE 2 END").alias("side")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = dealt.repartition(parts, "run").sortWithinPartitions("run").mapInArrow(ties, "a long, b long").distinct()
    pools = materialise(components(tied).withColumnRenamed("root", "pool"), "near-pools")
    nodes = rest.select("node", "one", "two", "root").dropDuplicates(["node"]).join(pools, "node")
    sets = shingle_sets(docs, found, nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    counts = pools.groupBy("pool").agg(F.ceil(F.count("*") / POOLED).cast("int").alias("blocks"))
    full = materialise(nodes.join(sets, "node").join(counts, "pool").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) AS int)")), "near-pooled")
    columns = ["pool", "x", "y", "node", "one", "two", "root", "set"]
    one = full.withColumn("x", F.col("own")).withColumn("y", F.explode(F.expr("sequence(own, blocks - 1)"))).select(*columns)
    two = full.withColumn("y", F.col("own")).withColumn("x", F.explode(F.expr("sequence(0, own)"))).select(*columns)
    by = ["pool", "x", "y"]
    return one.groupBy(*by).cogroup(two.groupBy(*by)).applyInArrow(crossed, "a long, b long").distinct()


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, a_set, b_set) whose sets are similar."""
    for batch in batches:
        sets = [[np.frombuffer(s, np.uint64) for s in batch.column(k).to_pylist()] for k in (2, 3)]
        good = pa.array([similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(good)


def shingle_sets(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, set (its distinct shingle hashes, sorted, as bytes) of the nodes in pairs; the text is that of a node's first row."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    spots = found.join(wanted, "node").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("did"), "mark")).alias("first")).select("node", "first.*")
    spots = materialise(spots, "spots")
    if spots.count() <= BROADCAST_NODES:
        spots = F.broadcast(spots)
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def rows(batches):
        for batch in batches:
            for node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield node, np.unique(shingle_hashes(text, WORDS)).tobytes()

    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("did"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))
    sets = plain.join(spots, ["did", "mark"]).select("node", "text").mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: 40 + len(r[1])), "node long, set binary")
    return materialise(sets.dropDuplicates(["node"]), "shingle-sets")


def linked(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""
    pairs = materialise(pairs, "near-pairs")
    sets = shingle_sets(docs, found, pairs)
    both = pairs.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b").select("a", "b", "a_set", "b_set")
    return both.mapInArrow(verified, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), node and root (equal for the documents of a group) of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def rows(batches):
        for batch in batches:
            for doc_id, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield doc_id, mark, *prints(text)

    found = materialise(plain.mapInArrow(lambda b: in_batches(rows(b), PRINTS, lambda r: 250), "doc_id long, mark long, node long, word long, one long, two long, least array<long>, bands array<long>"), "prints")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = found.select("node", "word", "one", "two", "least", "bands").dropDuplicates(["node"]).repartition(parts)
    dealt = nodes.mapInArrow(deal, "key long, node long, one long, two long")
    met = materialise(dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(candidates, "a long, b long, one long, two long, part int"), "near-met")
    links = linked(docs, found, met.where("part = 0").select("a", "b").distinct())
    # pairs of large buckets that these links have not put together
    roots = materialise(components(links), "near-roots")
    large = met.where("part = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "one", "two").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = crossing(docs, found, materialise(large.select("key", "node", "one", "two", "root"), "near-large"))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)).withColumnRenamed("node", "member")
    return found.join(roots, found["node"] == roots["member"], "left").select("doc_id", "mark", "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns as they are."""
    groups = near_groups(docs)
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("did")
    first = groups.groupBy("root").agg(F.min(F.struct(last, "mark")).alias("first")).select("first.*").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    return keyed.join(first, ["did", "mark"], "left_semi").select("row_.*")
