"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each a word of the binary
Golay code [23, 12, 7]. A word's keys are the indices of all codewords within distance 4: one
or six of them, found by its syndrome. Two words within distance 2 always share a key (the
codeword nearest to a word between them lies within 4 of both). Where two fingerprints differ
in at most 4 bits, pigeonholes over the segments leave two cases:

- a segment is equal, and of the other two one has at most 2 errors: key = the equal
  segment whole, and a codeword of the other;
- every segment has an error, so none has more than 2: key = a codeword of each.

All distinct fingerprints are dealt out by these keys (some 180 each, of 34 to 36 bits), and
those that meet are verified. Within a bucket links are followed from one fingerprint to the ones not
reached yet, so a bucket yields fewer links than members, never all pairs, and links within it
stay connected as all pairs would be. Buckets hold distinct fingerprints, so exact copies,
however many, count once.

Defined results: a null text is the empty text; a text without words has fingerprint zero; a null doc_id
is no component's smallest unless there is no other; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialise, pairs, table, texts
from .components import components

WORDS, BITS, SEED = 4, 4, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
POLYNOMIAL = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Buckets up to this size are compared at once; larger ones by following links.
SMALL = 16


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included; of all words if there are fewer."""
    parts = text.translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bit k is 1 if it is set in over half the shingles' hashes."""
    hashes = shingle_hashes(text, words, seed)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _remainder(word: int) -> int:
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= POLYNOMIAL << (k - 11)
    return word


class Golay:
    """keys(x): indices of the codewords within distance 4 of each 23-bit word, 6 columns, -1 where there are fewer."""

    def __init__(self) -> None:
        self.low = np.array([_remainder(w) for w in range(1 << 12)], np.int32)
        self.high = np.array([_remainder(w << 12) for w in range(1 << 11)], np.int32)
        errors: list[list[int]] = [[] for _ in range(1 << 11)]
        bits = [(1 << k, _remainder(1 << k)) for k in range(23)]
        layer = [(0, 0, -1)]
        for weight in range(5):
            for word, syndrome, _ in layer:
                errors[syndrome].append(word)
            if weight < 4:
                layer = [(word | bits[k][0], syndrome ^ bits[k][1], k) for word, syndrome, last in layer for k in range(last + 1, 23)]
        self.errors = np.array([(e + [-1] * 6)[:6] for e in errors], np.int64)
        assert max(map(len, errors)) == 6

    def keys(self, words: np.ndarray) -> np.ndarray:
        errors = self.errors[self.low[words & 0xFFF] ^ self.high[words >> 12]]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def bucket_keys(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every bucket of each fingerprint."""
    prints = prints.astype(np.uint64)
    parts = [(prints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    codes = [golay.keys(p) for p in parts]
    keys, rows, every = [], [], np.arange(len(prints))

    def put(kind: int, payload: np.ndarray, good: np.ndarray) -> None:
        at = np.nonzero(good)
        keys.append(payload[at] | np.int64(kind) << np.int64(40))
        rows.append(np.broadcast_to(every.reshape(-1, *[1] * (payload.ndim - 1)), payload.shape)[at])

    for kind, (equal, other) in enumerate((z, o) for z in range(3) for o in range(3) if z != o):
        put(kind, parts[equal][:, None] << 12 | codes[other], codes[other] >= 0)
    a, b, c = codes[0][:, :, None, None], codes[1][:, None, :, None], codes[2][:, None, None, :]
    put(6, a << 24 | b << 12 | c, (a >= 0) & (b >= 0) & (c >= 0))
    return np.concatenate(keys), np.concatenate(rows)


def links(prints: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among a bucket's fingerprints: each reached one with those it reaches first."""
    rest = prints.astype(np.uint64)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= bits
            if near.any():
                yield np.full(near.sum(), one), rest[near]
                queue.extend(rest[near])
                rest = rest[~near]


def bucket_links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Verified links within the runs of equal keys of sorted (key, print) rows."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def done(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        length = np.diff(np.append(edge, len(k)))
        small = np.repeat(length <= SMALL, length)
        out = []
        for off in range(1, min(SMALL, int(length.max(initial=1)))):
            at = np.flatnonzero((k[:-off] == k[off:]) & small[:-off])
            at = at[np.bitwise_count(f[at] ^ f[at + off]) <= bits]
            if len(at):
                out.append((f[at], f[at + off]))
        for start, n in zip(edge[length > SMALL], length[length > SMALL], strict=True):
            out += links(f[start : start + n], bits)
        if out:
            pair = np.unique(np.stack([np.concatenate(x).view(np.int64) for x in zip(*out, strict=True)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    for batch in batches:
        k = np.concatenate([held_k, batch.column(0).to_numpy()])
        f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
        last = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if last:
            yield from done(k[:last], f[:last])
        held_k, held_f = k[last:], f[last:]
    if len(held_k):
        yield from done(held_k, held_f)


def near_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: links among the distinct longs `print`, connected as all pairs within `bits` (at most 4) bits are."""
    if bits > BITS:
        raise ValueError("these keys find pairs of at most 4 differing bits")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            f = batch.column(0).to_numpy()
            for k in range(0, len(f), 2048):
                part = f[k : k + 2048]
                keys, rows = bucket_keys(part.view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "print"])

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out anew, since the few bytes of the fingerprints would meet in few tasks, and each becomes some 180 rows
    dealt = prints.select("print").distinct().repartition(parts).mapInArrow(deal, "key long, print long")
    found = dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: bucket_links(b, bits), "a long, b long")
    return found.distinct()


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, print (the 64 bits as a long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def rows(batches):
        for doc_id, text in pairs(batches):
            value = fingerprint(text, words)
            yield doc_id, value - (value >> 63 << 64)

    return texts(docs).mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: 16), "doc_id long, print long")


def classes(found: DataFrame, bits: int = BITS) -> DataFrame:
    """print, component_id (the smallest doc_id reachable over links) of every distinct fingerprint of fingerprints()."""
    least = found.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(found, bits))
    rooted = materialise(least.join(roots, least["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root")), "roots")
    # stored, so that the join has shuffles of its own, which a giant component's rows can be split over
    first = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return rooted.select("print", "root").join(first, "root").select("print", "component_id")


def near_dedup(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, print, component_id of every row."""
    found = materialise(fingerprints(docs, words), "fingerprints")
    return found.join(classes(found, bits), "print").select("doc_id", "print", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
