"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of WINDOW bytes that covers it also starts earlier in the corpus. Sorting
every suffix of the corpus isn't needed for that: each window of WINDOW bytes holds a canonical
anchor, the leftmost of its GRAM-byte strings with the least hash. Equal windows have equal anchors at
equal offsets, so windows need comparing only with those of an equal anchor. An anchor stands for
a run of windows, whose bytes are its context.

1. Each task finds its documents' anchors, and keeps the first of those with an equal context;
   the others' contexts are repeats.
2. Anchors are dealt out by hash. Of equal contexts the first stays; anchors that occur with
   different contexts ask for comparison.
3. The asked contexts are cut from their documents and dealt out by anchor. The suffixes that begin their windows are put in
   order by a mergesort whose comparisons find the common extension of two suffixes by
   binary search over prefix polynomial hashes; neighbours with 100 bytes in common are
   verified byte by byte, and all but the first of equal windows are repeats.
4. Each document's repeats are united and cut out.

An anchor with very many different contexts (a phrase that a large share of documents hold) is dealt
out by whole windows instead, so no task gets all its occurrences. Contexts count as equal by the hash of the anchor
and one 64-bit hash of all their bytes, seeded by the anchor's offset, in 1 and 2, and by their bytes in 3.

Defined results: a null text is the empty text; null doc_ids come last; rows of equal doc_id and text count as
one document and are each returned; rows of one doc_id with different texts are ordered by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, table
from .line_dedup import LAST, packed, tie

WINDOW, GRAM = 100, 32
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Different contexts of an anchor from which it is dealt out by windows.
HOT = 2000
FIRST, MARK, REPEAT, WINDOWS, CONTEXT = range(5)
ROWS = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("did", pa.int64()), ("tie", pa.int32()), ("act", pa.int64())])
_SQL = "key long, context long, did long, tie int, act long"


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * MIX[1]
    return x ^ x >> np.uint64(29)


def gram_hashes(text: bytes, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the GRAM bytes from each position, or from those in `at`."""
    n = len(text) - GRAM + 1
    out = np.zeros(n if at is None else len(at), np.uint64)
    for k, odd in enumerate(MIX):
        words = np.ndarray((n,), "<u8", text, offset=8 * k, strides=(1,))
        out += (words if at is None else words[at]) * odd
    return mix(out)


def anchors(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents joined in `text`, ending at `ends`: document, anchor, its first and last window, and the anchor's hash."""
    ends = np.asarray(ends, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(0, ends - starts - WINDOW + 1)
    if not counts.sum():
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    hashes = gram_hashes(text)
    width, size, value, index = WINDOW - GRAM + 1, 1, hashes, np.arange(len(hashes), dtype=np.int32)
    while True:  # leftmost least of 2, 4, ... positions, then of `width`
        step = min(size, width - size)
        if not step:
            break
        later = value[step:] < value[:-step]
        index, value = np.where(later, index[step:], index[:-step]), np.minimum(value[:-step], value[step:])
        size += step
    doc = np.repeat(np.arange(len(ends)), counts)
    window = np.arange(len(doc)) + np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    anchor = index[window].astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(edge[1:], len(doc)) - 1
    return doc[edge], anchor[edge], window[edge], window[last], hashes[anchor[edge]]


def pack(anchor: np.ndarray, first: np.ndarray, last: np.ndarray, kind) -> np.ndarray:
    return anchor << 19 | (anchor - first) << 11 | (anchor - last) << 3 | kind


def unpack(act: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first window, last window, kind."""
    anchor = act >> 19
    return anchor, anchor - (act >> 11 & 255), anchor - (act >> 3 & 255), act & 7


def find_anchors(batches: Iterator[pa.RecordBatch], hot_from: int = HOT, block: int = 1 << 20, flush: int = 800_000) -> Iterator[pa.RecordBatch]:
    """ROWS of a task's anchors: FIRST, dealt by hash; REPEAT of a context before; WINDOWS, and a MARK for others, of hot anchors."""
    held: list[tuple[np.ndarray, ...]] = []
    texts: list[bytes] = []
    spots: list[tuple[int, int]] = []

    def gather() -> None:
        if not texts:
            return
        joined, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        doc, anchor, first, last, value = anchors(joined, ends)
        digest = xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(joined[a : b + WINDOW], c) for a, b, c in zip(first.tolist(), last.tolist(), (anchor - first).tolist(), strict=True)), np.uint64, len(doc))
        start = np.concatenate([[0], ends[:-1]])[doc]
        dids, ties = np.array([s[0] for s in spots], np.int64), np.array([s[1] for s in spots], np.int32)
        held.append((value.view(np.int64), context.view(np.int64), dids[doc], ties[doc], anchor - start, first - start, last - start))
        texts.clear()
        spots.clear()

    def out() -> Iterator[pa.RecordBatch]:
        gather()
        if not held:
            return
        key, context, did, tie_, anchor, first, last = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((anchor, tie_, did, context, key))
        key, context, did, tie_, anchor, first, last = (x[order] for x in (key, context, did, tie_, anchor, first, last))
        # a repeated row's anchors are those of the row before, not repeats of them
        again = np.concatenate([[False], np.all([x[1:] == x[:-1] for x in (key, context, did, tie_, anchor, first)], axis=0)])
        key, context, did, tie_, anchor, first, last = (x[~again] for x in (key, context, did, tie_, anchor, first, last))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        fresh = new_key | np.concatenate([[True], context[1:] != context[:-1]])
        run = np.cumsum(new_key) - 1
        hot = np.bincount(run, fresh)[run] >= hot_from
        kind = np.where(~fresh, REPEAT, np.where(hot, WINDOWS, FIRST))
        # repeats and hot anchors need not meet others: they are spread
        spread = mix(did.view(np.uint64) * MIX[0] + anchor.view(np.uint64)).view(np.int64)
        act, dealt = pack(anchor, first, last, kind), np.where(kind == FIRST, key, spread)
        marks = np.flatnonzero(new_key & hot)
        zero = np.zeros(len(marks), np.int64)
        columns = [np.concatenate(x) for x in ((dealt, key[marks]), (context, zero), (did, zero), (tie_, zero.astype(np.int32)), (act, zero + MARK))]
        for k in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], schema=ROWS)

    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(text) >= WINDOW:
                texts.append(text)
                spots.append((LAST if doc_id is None else doc_id, tie(text)))
                size += len(text)
                if size >= block:
                    gather()
                    size = 0
                    if sum(len(x[0]) for x in held) >= flush:
                        yield from out()
    yield from out()


def in_runs(batches: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[list]:
    """Columns of sorted batches, joined and cut so that rows of a key (the first column) stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            whole = pa.concat_batches(held)
            key = whole.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield whole.slice(0, last).columns
            held = [whole.slice(last)]
    if held and sum(map(len, held)):
        yield pa.concat_batches(held).columns


ACTS = pa.schema([("did", pa.int64()), ("tie", pa.int32()), ("act", pa.int64())])


def settle(batches: Iterator[pa.RecordBatch], hot_from: int = HOT) -> Iterator[pa.RecordBatch]:
    """ACTS of the corpus's repeated anchors: REPEAT, or CONTEXT or WINDOWS of those that ask for comparison."""
    for columns in in_runs(batches):
        key, context, did, tie_, act = (c.to_numpy(zero_copy_only=False) for c in columns)
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(new_key) - 1
        kind = act & 7
        done = (kind == REPEAT) | (kind == WINDOWS)
        keep = done | (np.bincount(run)[run] > 1) & (kind == FIRST)
        marked = (np.bincount(run, kind == MARK) > 0)[run]
        todo = np.flatnonzero(keep & ~done)
        todo = todo[np.lexsort((act[todo], tie_[todo], did[todo], context[todo], run[todo]))]
        if len(todo):  # as above, for repeated rows of different tasks
            todo = todo[np.concatenate([[True], ~np.all([x[todo][1:] == x[todo][:-1] for x in (run, context, did, tie_, act)], axis=0)])]
        new_run = np.concatenate([[True], run[todo][1:] != run[todo][:-1]]) if len(todo) else np.empty(0, bool)
        fresh = new_run | np.concatenate([[True], context[todo][1:] != context[todo][:-1]]) if len(todo) else new_run
        classes = np.bincount(run[todo], fresh, minlength=run[-1] + 1)[run[todo]]
        hot = marked[todo] | (classes >= hot_from)
        now = np.where(~fresh, REPEAT, np.where(hot, WINDOWS, np.where(classes > 1, CONTEXT, FIRST)))
        act = act.copy()
        act[todo] = act[todo] & ~np.int64(7) | now
        at = np.concatenate([np.flatnonzero(done), todo[now != FIRST]])
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at[k : k + 100_000]]) for c in (did, tie_, act)], schema=ACTS)


CONTEXTS = pa.schema([("key", pa.int64()), ("did", pa.int64()), ("tie", pa.int32()), ("act", pa.int64()), ("bytes", pa.binary())])


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CONTEXTS of the asked anchors; of equal ones in a batch the first, the others as REPEAT without bytes."""
    zstd = zstandard.ZstdDecompressor()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        first: dict[tuple[int, int, bytes], tuple] = {}
        for did, tie_, text, acts in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            text, acts = zstd.decompress(text), np.array(acts, np.int64)
            anchor, start, last, kind = unpack(acts)
            keys = gram_hashes(text, anchor).view(np.int64).tolist()
            for key, a, s, e, k in zip(keys, anchor.tolist(), start.tolist(), last.tolist(), kind.tolist(), strict=True):
                if k == CONTEXT:
                    asked = [(key, a, s, e, text[s : e + WINDOW])]
                else:
                    asked = [(xxhash.xxh3_64_intdigest(w := text[p : p + WINDOW]) - (1 << 63), p, p, p, w) for p in range(s, e + 1)]
                for key_, a_, s_, e_, body in asked:
                    one = (did, tie_, s_, a_, e_, key_)
                    name = (key_, a_ - s_, body)
                    before = first.get(name)
                    if before is None:
                        first[name] = one
                    else:
                        first[name], later = min(one, before), max(one, before)
                        yield hash(later) >> 1, later[0], later[1], later[3] << 19 | (later[3] - later[2]) << 11 | (later[3] - later[4]) << 3 | REPEAT, None
        for (key_, _, body), (did, tie_, s_, a_, e_, _) in first.items():
            yield key_, did, tie_, a_ << 19 | (a_ - s_) << 11 | (a_ - e_) << 3 | CONTEXT, body

    for batch in batches:
        yield from in_batches(rows(batch), CONTEXTS, lambda r: 40 + len(r[4] or b""))


class Suffixes:
    """Suffixes of a text, compared over at most WINDOW bytes by prefix polynomial hashes."""

    def __init__(self, text: bytes):
        self.bytes = np.frombuffer(text, np.uint8)
        n = len(text)
        base = int(MIX[0])
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, MIX[0]), dtype=np.uint64)])
        self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(pow(base, -1, 1 << 64))), dtype=np.uint64)])
        # bytes by an odd-multiplied square, so that regular texts don't cancel out
        spread = mix((self.bytes.astype(np.uint64) + np.uint64(1)) * MIX[2])
        self.upto = np.concatenate([[np.uint64(0)], np.cumsum(spread * power[:n], dtype=np.uint64)])

    def hash(self, at: np.ndarray, size) -> np.ndarray:
        return (self.upto[at + size] - self.upto[at]) * self.back[at]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), WINDOW, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.hash(x, middle) == self.hash(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        at = np.minimum(n, WINDOW - 1)
        return (n < WINDOW) & (self.bytes[x + at] < self.bytes[y + at])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes `at` within each group (sorted): a stable bottom-up mergesort, all merges of a level at once."""
        order = np.arange(len(at))
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(at)))
        begin, count = np.repeat(start, size), np.repeat(size, size)
        run = 1
        while run < size.max(initial=0):
            place = np.flatnonzero(count > run)
            inside = place - begin[place]
            pair = inside // (2 * run) * (2 * run)
            right = inside - pair >= run
            # the sibling run
            low = np.minimum(np.where(right, pair, pair + run), count[place])
            high = np.minimum(np.where(right, pair + run, pair + 2 * run), count[place])
            first, x = low.copy(), at[order[place]]
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                middle = (low[k] + high[k]) // 2
                y = at[order[begin[place[k]] + middle]]
                goes = np.where(right[k], ~self.less(x[k], y), self.less(y, x[k]))
                low[k], high[k] = np.where(goes, middle + 1, low[k]), np.where(goes, high[k], middle)
            own = inside - np.where(right, pair + run, pair)
            target = begin[place] + pair + own + (low - first)
            moved = order.copy()
            moved[target] = order[place]
            order, run = moved, 2 * run
        return order


def equal_windows(text: bytes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a window equals an earlier one of its group; windows come in order within sorted groups."""
    suffixes = Suffixes(text)
    # windows without a twin by hash can't be repeats and needn't be sorted
    name = suffixes.hash(at, WINDOW) ^ mix(group.view(np.uint64))
    _, inverse, counts = np.unique(name, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[inverse] > 1)
    order = some[suffixes.sort(at[some], group[some])]
    one, two = order[:-1], order[1:]
    twin = group[one] == group[two]
    twin[twin] = suffixes.common(at[one[twin]], at[two[twin]]) >= WINDOW
    checked, k = np.flatnonzero(twin), np.arange(WINDOW)
    same = np.concatenate([np.empty(0, bool), *((suffixes.bytes[at[one[c]][:, None] + k] == suffixes.bytes[at[two[c]][:, None] + k]).all(1) for c in np.array_split(checked, len(checked) // 50_000 + 1))])
    out = np.zeros(len(at), bool)
    if same.all():
        out[two[twin]] = True
        return out
    seen: set[tuple[int, bytes]] = set()  # two strings with one hash: compare the bytes themselves
    for i, (a, g) in enumerate(zip(at.tolist(), group.tolist(), strict=True)):
        one_ = (g, text[a : a + WINDOW])
        out[i] = one_ in seen
        seen.add(one_)
    return out


SPANS = pa.schema([("did", pa.int64()), ("tie", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SPANS of the repeats among CONTEXTS sorted by key."""
    for columns in in_runs(batches, 15_000):
        key, did, tie_, act = (c.to_numpy(zero_copy_only=False) for c in columns[:4])
        anchor, first, last, kind = unpack(act)
        bodies = columns[4].to_pylist()
        spans = [(did[i], tie_[i], first[i], last[i] + WINDOW) for i in np.flatnonzero(kind == REPEAT)]
        todo = np.flatnonzero(kind == CONTEXT)
        todo = todo[np.lexsort((first[todo], tie_[todo], did[todo], key[todo]))]
        seen: set[tuple[int, int, bytes]] = set()
        fresh = []
        for i in todo.tolist():
            name = (int(key[i]), int(anchor[i] - first[i]), bodies[i])
            if name in seen:
                spans.append((did[i], tie_[i], first[i], last[i] + WINDOW))
            else:
                seen.add(name)
                fresh.append(i)
        rows = np.array(fresh, np.int64)
        if len(rows):
            _, inverse, counts = np.unique(key[rows], return_inverse=True, return_counts=True)
            rows = rows[counts[inverse] > 1]
        if len(rows):
            text = b"".join(bodies[i] for i in rows.tolist())
            base = np.concatenate([[0], np.cumsum(last[rows] + WINDOW - first[rows])[:-1]])
            n = last[rows] - first[rows] + 1
            row = np.repeat(np.arange(len(rows)), n)
            step = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            offset = (anchor[rows] - first[rows])[row] - step
            _, number = np.unique(key[rows], return_inverse=True)
            group = number[row] * 256 + offset
            order = np.argsort(group, kind="stable")
            repeat = np.zeros(len(row), bool)
            repeat[order] = equal_windows(text, (base[row] + step)[order], group[order])
            hit = np.flatnonzero(repeat)
            if len(hit):
                edge = np.concatenate([[True], (row[hit][1:] != row[hit][:-1]) | (np.diff(hit) != 1)])
                a, b = hit[edge], hit[np.append(np.flatnonzero(edge)[1:], len(hit)) - 1]
                r = rows[row[a]]
                spans += zip(did[r], tie_[r], first[r] + step[a], first[r] + step[b] + WINDOW, strict=True)
        yield from in_batches(iter(spans), SPANS)


def cut_out(text: bytes, acts: list[int], spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal runs removed."""
    _, first, last, kind = unpack(np.array(acts, np.int64))
    every = list(zip(first[kind == REPEAT].tolist(), (last[kind == REPEAT] + WINDOW).tolist(), strict=True)) + [(s["begin"], s["end"]) for s in spans]
    left, at, removed, runs = [], 0, 0, 0
    for begin, end in sorted(every):
        if begin > at or not runs:
            left.append(text[at:begin])
            runs += 1
            at = begin
        if end > at:
            removed += end - at
            at = end
    return b"".join([*left, text[at:]]), removed, runs


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, left (bytes), n_bytes, n_removed, n_spans of every row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spot = ["did", "tie"]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = plain.mapInArrow(lambda b: find_anchors(b, hot), _SQL).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: settle(b, hot), "did long, tie int, act long")
    # rows of equal doc_id and text say the same: once each
    acts = found.repartition(parts, *spot).groupBy(*spot).agg(F.collect_set("act").alias("acts"))
    # the same columns and filters wherever texts are joined, so that they are dealt out once
    texts = packed(docs.select("doc_id", "text")).drop("rest_").where("did IS NOT NULL AND tie IS NOT NULL").repartition(parts, *spot)
    asked = F.filter("acts", lambda a: a.bitwiseAND(F.lit(7)) >= WINDOWS)
    asks = texts.join(acts.select(*spot, asked.alias("asked")).where("size(asked) > 0"), spot).select("doc_id", *spot, "text", "asked").dropDuplicates(spot)
    contexts = asks.mapInArrow(cut_contexts, "key long, did long, tie int, act long, bytes binary")
    spans = contexts.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(compare, "did long, tie int, begin long, end long")
    cuts = spans.repartition(parts, *spot).groupBy(*spot).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    done = texts.join(acts, spot, "left").join(cuts, spot, "left").select("doc_id", "text", "acts", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("left", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def rows(batches):
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, text, acts_, spans_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = zstd.decompress(text)
                left, removed, runs = cut_out(text, acts_ or [], spans_ or [])
                yield doc_id, left, len(text), removed, runs

    return done.mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: 60 + len(r[1])), "doc_id long, left binary, n_bytes long, n_removed long, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"))
