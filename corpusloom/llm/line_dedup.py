r"""Line dedup by a segment-partition edit join.

Lines are the pieces between newlines. Of equal lines the first (by doc_id, then
line number) represents them. Representatives of at least `least` characters within `edits` edits (insert,
delete or replace a character) of each other are linked: each is split into edits + 1
segments, of which one must be untouched; each line probes the segments of lines of its own
length and up to `edits` less at the places where they can lie, and who meets is verified by a banded
bit-parallel edit distance. A line goes if it is not the first of its equals, or if it is linked to an earlier
representative (by first occurrence). Blank lines always stay.

A segment that very many different lines share is not paired within its bucket: its lines get
finer keys instead. They are cut into many pieces, of which edits touch at most `edits`, and a key is what is left of a line without so
many pieces, each stretch shifted as edits can shift it. Lines that meet in crowds again are cut finer once more. So
the number of pairs follows the links, not the square of a bucket, and no bucket is held in memory.

Texts move once, compressed, by document; lines move only where they are candidates.

Defined results: a null text is the empty text; null doc_ids come last; rows of equal doc_id
and text count as one document and are each returned; rows of one doc_id with different texts
are ordered by a hash of the text; a document keeps its newlines only between lines that stay; shorter lines than
`least` are linked to none, but their repeats go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialise, table
from .components import components

EDITS, LEAST = 2, 20
#: Lines that may share a segment before they get finer keys; for each step, pieces a segment that these are made of, and lines that may
#: share one before the next step.
HOT, FINER = 48, ((4, 1024), (16, 0))
#: Most documents of candidate lines that are sent to every task; more are joined by shuffles.
BROADCAST_DOCS = 300_000
LAST = (1 << 63) - 1
SPOT = ("did", "tie", "line")


def characters(line: bytes) -> bytes | str:
    """A line as a sequence of characters: itself if they are bytes."""
    return line if line.isascii() else line.decode("utf-8", "surrogateescape")


def common_prefix(a: bytes | str, b: bytes | str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: bytes | str, b: bytes | str, edits: int = EDITS) -> bool:
    """Whether the edit distance is at most `edits`: one bit vector an error count over a band of a, moved along b."""
    if abs(len(a) - len(b)) > edits:
        return False
    k = common_prefix(a, b)
    a, b = a[k:], b[k:]
    k = common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    places: dict[int | str, int] = {}
    for i, one in enumerate(a):
        places[one] = places.get(one, 0) | 1 << i
    # bit j of rows[e]: a[:j] becomes what was read of b with e errors
    rows = [(2 << e) - 1 for e in range(edits + 1)]
    for i, one in enumerate(b):
        low = max(0, i + 1 - edits)
        band, same = ((2 << 2 * edits) - 1) << low, places.get(one, 0)
        new: list[int] = []
        for e, row in enumerate(rows):
            now = (row & same) << 1
            if e:
                now |= rows[e - 1] | rows[e - 1] << 1 | new[e - 1] << 1
            new.append(now & band)
        rows = new
        if not any(rows):
            return False
    return any(row >> len(a) & 1 for row in rows)


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, size) of edits + 1 segments of a line, the longer ones last."""
    size, longer = divmod(length, edits + 1)
    out, start = [], 0
    for i in range(edits + 1):
        n = size + (i >= edits + 1 - longer)
        out.append((start, n))
        start += n
    return out


def probes(length: int, indexed: int, edits: int = EDITS) -> Iterator[tuple[int, int, int]]:
    """(segment, start, size) of the substrings of a line of `length` that may equal a segment of one of `indexed`, not longer."""
    shift = length - indexed
    for i, (start, n) in enumerate(segments(indexed, edits)):
        for at in range(max(start - i, start + shift - (edits - i)), min(start + i, start + shift + (edits - i)) + 1):
            if 0 <= at <= length - n:
                yield i, at, n


@lru_cache(16384)
def key_plan(n: int, edits: int) -> list[tuple[int, int, int]]:
    """(start, end, seed) of a line's own segments (edits + 1), then of its other probes."""
    own = [(at, at + size, i << 40 | n) for i, (at, size) in enumerate(segments(n, edits))]
    asked = [(at, at + size, i << 40 | n - less) for less in range(min(edits, n) + 1) for i, at, size in probes(n, n - less, edits)]
    return own + [x for x in dict.fromkeys(asked) if x not in own]


def line_keys(line: bytes | str, edits: int = EDITS) -> list[int]:
    """Hashes of its own segments (edits + 1), then of its probes of lines of equal or shorter length."""
    digest, whole = xxhash.xxh3_64_intdigest, isinstance(line, bytes)
    return [digest(line[a:b] if whole else line[a:b].encode("utf-8", "surrogateescape"), seed) - (1 << 63) for a, b, seed in key_plan(len(line), edits)]


def letters(codes: np.ndarray) -> int:
    """How often the characters of each of 16 classes occur, modulo 16, four bits each."""
    counts = np.bincount(codes % 16, minlength=16).astype(np.uint64) % np.uint64(16)
    return int((counts << np.arange(0, 64, 4, dtype=np.uint64)).sum().view(np.int64))


def letters_allow(x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    """Whether lines with such letters() can be within `edits`: an edit takes one letter at most, and brings one at most."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    more, less = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
    for at in range(0, 64, 4):
        d = (x >> np.uint64(at)) - (y >> np.uint64(at)) & np.uint64(15)
        more += np.where(d < 8, d, 0).astype(np.uint64)
        less += np.where(d < 8, 0, np.uint64(16) - d).astype(np.uint64)
    return np.maximum(more, less) <= edits


def shifts(edits: int, less: int) -> list[tuple[int, ...]]:
    """Shifts of the stretches between `edits` pieces that may be touched: from 0 to `less`, by at most `edits` steps altogether."""
    every = product(range(-edits, edits + 1), repeat=edits - 1)
    return [s for s in ((0, *middle, less) for middle in every) if sum(abs(x - y) for x, y in zip(s, s[1:], strict=False)) <= edits]


@lru_cache(256)
def fine_plan(n: int, edits: int, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of each key of a line of n characters, a salt, and whether the key is its own; own ones first."""
    rows = []
    for less in range(edits + 1):
        size = n - less
        m = min(pieces * (edits + 1), size)
        cuts = [size * k // max(1, m) for k in range(m + 1)]
        for number, out in enumerate(combinations(range(m), edits)):
            begin, end = [0, *[cuts[k + 1] for k in out]], [*[cuts[k] for k in out], size]
            for s in shifts(edits, less):
                a, b = [x + y for x, y in zip(begin, s, strict=True)], [x + y for x, y in zip(end, s, strict=True)]
                if a[0] >= 0 and b[-1] <= n and all(x <= y for x, y in zip(b, a[1:], strict=False)):
                    rows.append((bool(less or any(s)), size << 32 | number, a, b))
    rows.sort(key=lambda r: r[0])
    salt = np.array([r[1] for r in rows], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.array([r[2] for r in rows], np.int64).reshape(-1, edits + 1), np.array([r[3] for r in rows], np.int64).reshape(-1, edits + 1), salt, np.array([not r[0] for r in rows], bool)


def fine_keys(line: bytes | str, edits: int, pieces: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of a line, which are its own, and its letters(): of two lines within `edits` edits the longer has one of the other's own keys."""
    codes = np.frombuffer(line, np.uint8) if isinstance(line, bytes) else np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    n, base = len(codes), 0x9E3779B97F4A7C15
    begin, end, salt, own = fine_plan(n, edits, pieces)
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(base)), dtype=np.uint64)])
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(pow(base, -1, 1 << 64))), dtype=np.uint64)])
    upto = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
    stretch = (upto[end] - upto[begin]) * back[begin]
    stretch = (stretch ^ stretch >> np.uint64(31)) * (np.arange(1, 2 * edits + 2, 2, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    mixed = stretch.sum(1, dtype=np.uint64) + salt
    keys, first = np.unique(((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64), return_index=True)
    return keys, own[first], letters(codes)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, did (last if null), tie (a hash of the text), text compressed, and rest_: the row's other columns."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    plain = docs.select(F.struct(*rest).alias("rest_"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            dids = pa.array([LAST if i is None else i for i in ids], pa.int64())
            columns = [batch.column(0), batch.column(1), dids, pa.array(map(tie, texts), pa.int32()), pa.array(map(zstd.compress, texts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rest_", "doc_id", "did", "tie", "text"])

    return plain.mapInArrow(pack, f"rest_ {plain.schema['rest_'].dataType.simpleString()}, doc_id long, did long, tie int, text binary")


def tie(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text) - (1 << 31)


def representatives(docs: DataFrame, least: int, edits: int) -> DataFrame:
    """did, tie, line of the first of each set of equal lines that aren't blank, and its keys (null below `least` characters)."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()), ("tie", pa.int32()), ("line", pa.int32()), ("keys", pa.binary())])

    def rows(batches):
        seen: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spot = (LAST if doc_id is None else doc_id, tie(text))
                for k, line in enumerate(text.split(b"\n")):
                    if line.strip():
                        digest = xxhash.xxh3_128_digest(line)
                        if (before := seen.get(digest)) is not None and before <= (*spot, k):
                            continue
                        if len(seen) > 300_000:  # sending a line again is harmless
                            seen.clear()
                        seen[digest] = (*spot, k)
                        yield int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), *spot, k, np.array(line_keys(own, edits), np.int64).tobytes() if len(own := characters(line)) >= least else None

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    sent = plain.mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: 200), "h1 long, h2 long, did long, tie int, line int, keys binary")
    return sent.groupBy("h1", "h2").agg(F.min(F.struct("did", "tie", "line", "keys")).alias("first")).select("first.*")


PAIR = "a_did long, a_tie int, a_line int, b_did long, b_tie int, b_line int"
_PAIR = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in PAIR.split(", ")])


def _before(cols: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the spots of rows x come before those of rows y."""
    out = cols[3][x] < cols[3][y]
    for c in (cols[2], cols[1]):
        out = (c[x] < c[y]) | (c[x] == c[y]) & out
    return out


KEYS = "key long, did long, tie int, line int, own boolean"
_KEYS = pa.schema([("key", pa.int64()), ("did", pa.int64()), ("tie", pa.int32()), ("line", pa.int32()), ("own", pa.bool_())])


def dealt_keys(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """KEYS of rows (did, tie, line, keys)."""
    for whole in batches:
        for start in range(0, len(whole), 4096):
            batch = whole.slice(start, 4096)
            parts = batch.column(3).to_pylist()
            n = np.fromiter(map(len, parts), np.int64, len(parts)) // 8
            own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) <= edits
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(parts), np.int64)), *(pa.array(np.repeat(batch.column(k).to_numpy(), n)) for k in range(3)), pa.array(own)], schema=_KEYS)


def meet(batches: Iterator[pa.RecordBatch], hot: int, edits: int = EDITS) -> Iterator[pa.RecordBatch]:
    """Pairs within the runs of equal keys of sorted rows (key, did, tie, line, own, letters if known); of longer runs each line alone, b null.

    A pair has at least one side with its own key, and letters that allow it. hot 0: all runs are paired. Of a run beyond `hot` nothing is held.
    """

    def alone(cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[1:4]), *(pa.nulls(len(cols[0]), f.type) for f in list(_PAIR)[3:])], schema=_PAIR)

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, own = cols[0], cols[4].astype(bool)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(edge, len(key)))
        big = np.repeat(length > hot, length) if hot else np.zeros(len(key), bool)
        for off in range(1, int(length[length <= hot].max(initial=1)) if hot else int(length.max())):
            at = np.flatnonzero((key[:-off] == key[off:]) & ~big[:-off] & (own[:-off] | own[off:]))
            at = at[np.any([c[at] != c[at + off] for c in cols[1:4]], axis=0)]
            if len(cols) > 5 and len(at):
                at = at[letters_allow(cols[5][at], cols[5][at + off], edits)]
            if len(at):
                x, y = at, at + off
                first = _before(cols, x, y)
                one, two = np.where(first, x, y), np.where(first, y, x)
                for k in range(0, len(one), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[x[k : k + 50_000]]) for x in (one, two) for c in cols[1:4]], schema=_PAIR)
        if big.any():
            yield alone([c[big] for c in cols])

    held: list[np.ndarray] | None = None
    crowded: int | None = None  # the key of a run that has passed `hot`
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if crowded is not None and len(cols[0]):
            n = int(np.searchsorted(cols[0], crowded, "right"))
            if n:
                yield alone([c[:n] for c in cols])
                cols = [c[n:] for c in cols]
            if len(cols[0]):
                crowded = None
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        if last:
            yield from out([c[:last] for c in cols])
        held = [c[last:] for c in cols]
        if hot and len(held[0]) > hot:
            crowded = int(held[0][0])
            yield alone(held)
            held = None
    if held and len(held[0]):
        yield from out(held)


def joined(keys: DataFrame, hot: int, edits: int) -> DataFrame:
    """meet() over keys dealt out by key."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: meet(b, hot, edits), PAIR)


def lines_of(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """did, tie, line, content of the asked lines, stored."""
    schema = pa.schema([("did", pa.int64()), ("tie", pa.int32()), ("line", pa.int32()), ("content", pa.binary())])
    asked = materialise(spots.groupBy("did").agg(F.collect_set(F.struct("tie", "line")).alias("asked")), "asked-lines")
    if asked.count() <= BROADCAST_DOCS:
        asked = F.broadcast(asked)

    def rows(batches):
        for batch in batches:
            for did, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, parts = tie(text), text.split(b"\n")
                for x in wanted:
                    if x["tie"] == own:
                        yield did, own, x["line"], parts[x["line"]]

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = plain.join(asked, "did").select("did", "text", "asked").mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: len(r[3]) + 40), "did long, tie int, line int, content binary")
    # rows of equal doc_id and text give equal lines
    return materialise(found.dropDuplicates(list(SPOT)), "line-contents")


def links(reps: DataFrame, docs: DataFrame, edits: int) -> DataFrame:
    """PAIR of representatives within `edits` edits, a before b."""
    keys = reps.where("keys IS NOT NULL").select(*SPOT, "keys").mapInArrow(lambda b: dealt_keys(b, edits), KEYS)
    met = materialise(joined(keys, HOT, edits).distinct(), "line-pairs")
    pairs = met.where("b_did IS NOT NULL")
    schema = _KEYS.append(pa.field("letters", pa.int64()))

    def finer(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, tie_, line, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, mine, held = fine_keys(characters(content), edits, pieces)
                same = lambda v, t, n=len(k): pa.array(np.full(n, v, t))
                yield pa.RecordBatch.from_arrays([pa.array(k), same(did, "int64"), same(tie_, "int32"), same(line, "int32"), pa.array(mine), same(held, "int64")], schema=schema)

    for pieces, hot in FINER:
        lone = met.where("b_did IS NULL").select(F.col("a_did").alias("did"), F.col("a_tie").alias("tie"), F.col("a_line").alias("line"))
        if lone.isEmpty():
            break
        fine = lines_of(docs, lone).mapInArrow(lambda b, n=pieces: finer(b, n), f"{KEYS}, letters long")
        met = materialise(joined(fine, hot, edits).distinct(), "line-pairs")
        pairs = pairs.unionByName(met.where("b_did IS NOT NULL")).distinct()
    a, b = ([F.col(f"{side}_{c}").alias(c) for c in SPOT] for side in "ab")
    content = lines_of(docs, pairs.select(*a).unionByName(pairs.select(*b)))
    sides = [content.select(*[F.col(c).alias(f"{s}_{c}") for c in (*SPOT, "content")]) for s in "ab"]
    both = pairs.join(sides[0], [f"a_{c}" for c in SPOT]).join(sides[1], [f"b_{c}" for c in SPOT]).select(*_PAIR.names, "a_content", "b_content")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                if not (x.isascii() and y.isascii()):
                    x, y = x.decode("utf-8", "surrogateescape"), y.decode("utf-8", "surrogateescape")
                good.append(within(x, y, edits))
            yield pa.RecordBatch.from_arrays(batch.columns[:6], schema=_PAIR).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(verified, PAIR)


def line_links(docs: DataFrame, least: int = LEAST, edits: int = EDITS) -> DataFrame:
    """PAIR of every two linked lines, a before b: a row a link, which are many where many lines are alike."""
    return links(materialise(representatives(docs, least, edits), "lines"), docs, edits)


def line_dedup(docs: DataFrame, least: int = LEAST, edits: int = EDITS, classes: bool = False) -> DataFrame:
    """rest_ (the other columns of docs), doc_id, did, tie, text (what is left, bytes), n_lines, n_removed, n_links, linked of every row.

    linked: (line, links) of each line that first occurs in this document and is linked, with the number of its links. classes: class_id as well, the
    smallest doc_id that links between lines lead to, its own included (null: only rows without one).
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = packed(docs).repartition(parts, "did", "tie")
    reps = materialise(representatives(docs, least, edits), "lines")
    found = materialise(links(reps, docs, edits), "line-links")
    gone = found.select(*[F.col(f"b_{c}").alias(c) for c in SPOT]).distinct()
    kept = reps.select(*SPOT).join(gone, list(SPOT), "left_anti").groupBy("did", "tie").agg(F.collect_list("line").alias("kept"))
    ends = [found.select(*[F.col(f"{s}_{c}").alias(c) for c in SPOT]) for s in "ab"]
    counts = ends[0].unionByName(ends[1]).groupBy(*SPOT).agg(F.count("*").alias("links"))
    linked = counts.groupBy("did", "tie").agg(F.sum("links").alias("n_links"), F.array_sort(F.collect_list(F.struct("line", "links"))).alias("linked"))
    if classes:
        roots = components(found.select(F.col("a_did").alias("a"), F.col("b_did").alias("b"))).withColumnsRenamed({"node": "did", "root": "class_"})
        linked = linked.join(roots, "did", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.slice(start, 512)
                left, lines, gone = [], [], []
                for text, keep in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                    every, keep = zstd.decompress(text).split(b"\n"), set(keep or ())
                    stay = [line for k, line in enumerate(every) if k in keep or not line.strip()]
                    left.append(b"\n".join(stay))
                    lines.append(len(every))
                    gone.append(len(every) - len(stay))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(left, pa.binary()), pa.array(lines), pa.array(gone)], ["rest_", "doc_id", "did", "tie", "text", "n_lines", "n_removed"])

    done = texts.join(kept, ["did", "tie"], "left").select("rest_", "doc_id", "did", "tie", "text", "kept")
    kind = done.schema["rest_"].dataType.simpleString()
    left = done.mapInArrow(rows, f"rest_ {kind}, doc_id long, did long, tie int, text binary, n_lines long, n_removed long")
    done = left.join(linked, ["did", "tie"], "left").withColumns({"n_links": F.coalesce("n_links", F.lit(0)), "linked": F.coalesce("linked", F.array().cast("array<struct<line:int,links:bigint>>"))})
    return done.withColumn("class_id", F.nullif(F.coalesce("class_", "did"), F.lit(LAST))).drop("class_") if classes else done


def deduped_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs with the text that is left; a document all of whose lines went (they stand elsewhere) goes."""
    found = line_dedup(docs).where("n_removed < n_lines OR n_lines = 0 OR length(text) > 0")
    text = F.col("text").cast("string")
    columns = {c: F.col(f"rest_.`{c}`") for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), classes=True)
    return found.select("doc_id", "n_lines", "n_removed", "n_links", "class_id", F.sha2("text", 256).alias("kept_sha256"), "linked")
