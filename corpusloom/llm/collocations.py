r"""Phrase collocation mining: phrases whose words stand together far more often than their parts would.

Texts are cut into pieces at punctuation and line ends; identical pieces of a language are one row with a multiplicity, so copies cost
nothing after that. Phrases are counted level by level, from words to the longest: a task turns its pieces into phrases with
weights, adds up equal ones and deals them out by phrase; each hash bucket is then counted in a duckdb database of its own, with a
memory limit and a spill folder, and keeps what reaches `least`. A phrase of m words is only sent if both its phrases of
m - 1 words may be frequent: those are marked in a bitmap by their hash (of a fixed size, so a task can hold it), which can let a rare phrase
through to be counted but never leaves a frequent one out.

The counts of a candidate's parts are found by requests: each cut of each candidate asks for both its parts, requests and counts are
shuffled by part, and the answers go back by candidate. A phrase is covered if a longer one holds it as often; since counts only fall
with each word that is added, it is enough to look at phrases with one word more.

Spill files are private to a task and deleted with it: they lie in the shared folder if executors see it as a plain one, else in
duckdb's memory alone is counted.

Defined results: a null text is the empty text, a null language is `und`; repeated rows count each; words are told apart by their code points
(only A-Z are lower-cased); a piece without words is none; an empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import qualified, shared_dir
from .common import materialise, table
from .suffix_dedup import mix

#: Fixed by the contract: where pieces end.
ENDS = r"[.,;:!?\x0A-\x0D]"
#: Words that a task turns into phrases at once.
CHUNK = 400_000
#: Bytes of a bitmap that are sent as a row.
PAGE = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


@dataclass(frozen=True)
class Miner:
    """least: occurrences of a candidate; longest: its words; most: phrases returned for each language; cover: percent of a phrase's
    occurrences that a longer one must have to cover it; bits: of a hash that address the bitmap (2^24 bits are 2 MB); memory: of a bucket's database."""

    least: int = 100
    longest: int = 5
    most: int = 2000
    cover: int = 100
    bits: int = 24
    memory: str = "200MB"


#: A-Z to a-z, tabs to spaces, ends of pieces to line feeds.
_PLAIN = bytes(10 if re.match(ENDS, chr(i)) else 32 if i == 9 else i + 32 if chr(i) in ascii_uppercase else i for i in range(128)) + bytes(range(128, 256))


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (its words, joined by a space), times: a row for each distinct piece of each language."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = Counter(), 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = text.translate(_PLAIN)
                while b"  " in plain:
                    plain = plain.replace(b"  ", b" ")
                found.update((lang, piece) for part in plain.split(b"\n") if (piece := part.strip(b" ")))
                size += len(text)
                if size >= 4 << 20:
                    yield _summed(found)
                    found, size = Counter(), 0
            if found:
                yield _summed(found)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(cut, "lang string, piece string, times long").groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def _summed(found: Counter) -> pa.RecordBatch:
    langs, texts = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "piece", "times"])


def word_hashes(langs: list[str], words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{lang}\0{word}") for lang, word in zip(langs, words, strict=True)], np.uint64)


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of phrases, each followed by a word (both by place)."""
    return mix(hashes * _STEP + words)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches in tables of some CHUNK words; a longer piece is in one by itself with what comes before it."""
    held, weight = [], 0
    for batch in batches:
        start = 0
        ends = np.cumsum(pc.count_substring(batch.column(1), " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        while start < len(batch):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK - weight, "right")))
            held.append(batch.slice(start, stop - start))
            weight += int(ends[stop - 1] - base)
            start = stop
            if weight >= CHUNK or start < len(batch):
                yield pa.Table.from_batches(held)
                held, weight = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Words:
    """The words of pieces (lang, piece, times), one after the other: the row of each, and the number of the word of its language."""

    def __init__(self, rows: pa.Table):
        lang, piece = (rows.column(k).combine_chunks() for k in range(2))
        split = pc.split_pattern(piece, " ")
        length = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        found, langs = split.flatten().dictionary_encode(), lang.dictionary_encode()
        self.times, self.row, n = rows.column(2).to_numpy(), np.repeat(np.arange(len(length)), length), max(1, len(found.dictionary))
        pair = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.row] * n + found.indices.to_numpy(zero_copy_only=False)
        if n * len(langs.dictionary) <= 8 * CHUNK:  # numbers of a small range are put in order without sorting
            there = np.zeros(n * len(langs.dictionary), bool)
            there[pair] = True
            pair, self.word = np.flatnonzero(there), (np.cumsum(there) - 1)[pair]
        else:
            pair, self.word = np.unique(pair, return_inverse=True)
        self.texts, self.langs = found.dictionary.take(pa.array(pair % n)), langs.dictionary.take(pa.array(pair // n))

    def hashes(self) -> np.ndarray:
        return word_hashes(self.langs.to_pylist(), self.texts.to_pylist())[self.word]

    def within(self, m: int) -> np.ndarray:
        """Where m words of one piece begin."""
        return np.flatnonzero(self.row[: len(self.row) - m + 1] == self.row[m - 1 :]) if len(self.row) >= m else np.empty(0, np.int64)


def phrases(rows: pa.Table, m: int, marked: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """The weighted phrases of m words of pieces (lang, piece, times), equal ones added up; of those whose shorter phrases are marked."""
    w = Words(rows)
    if m == 1:
        total = np.zeros(len(w.texts), np.int64)
        np.add.at(total, w.word, w.times[w.row])
        return pa.RecordBatch.from_arrays([w.langs, w.texts, pa.array(total)], schema=COUNTED)
    own, at, word = w.hashes(), w.within(m), w.word
    hashes = own
    for j in range(1, m):
        if j == m - 1:  # hashes are those of m - 1 words
            good = is_marked(marked, hashes, bits)
            at = at[good[at] & good[at + 1]]
        hashes = longer(hashes[: len(hashes) - 1], own[j:])
    _, first, same = np.unique(hashes[at], return_index=True, return_inverse=True)
    if any((word[at + j] != word[at[first][same] + j]).any() for j in range(m)):  # two phrases share a hash: tell them apart by their words
        _, first, same = np.unique(np.stack([word[at + j] for j in range(m)]), axis=1, return_index=True, return_inverse=True)
        same = same.ravel()
    total = np.zeros(len(first), np.int64)
    np.add.at(total, same, w.times[w.row[at]])
    spots = at[first]
    text = pc.binary_join_element_wise(*[w.texts.take(pa.array(word[spots + j])) for j in range(m)], " ")
    return pa.RecordBatch.from_arrays([w.langs.take(pa.array(word[spots])), text, pa.array(total)], schema=COUNTED)


def fragments(rows: pa.Table, marked: np.ndarray, bits: int) -> pa.RecordBatch:
    """What can hold frequent phrases of three words or more: the longest runs of words of a piece whose pairs are all marked."""
    w = Words(rows)
    own = w.hashes()
    pair = np.zeros(len(w.row) + 1, bool)  # whether a marked pair begins at a word
    at = w.within(2)
    pair[at] = is_marked(marked, longer(own[at], own[at + 1]) if len(at) else own[:0], bits)
    start, end = np.flatnonzero(pair & ~np.append(False, pair[:-1])), np.flatnonzero(pair[:-1] & ~pair[1:])
    long = end > start
    start, size = start[long], end[long] - start[long] + 2
    offsets = np.append(0, np.cumsum(size))
    spots = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), w.texts.take(pa.array(w.word[spots]))), " ")
    return pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.word[start])), text, pa.array(w.times[w.row[start]])], ["lang", "piece", "times"])


def is_marked(marked: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (marked[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """The marks of phrases (lang, phrase): pages of them are put together in tasks, and the driver gets each page once."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            words = [p.split(" ") for p in batch.column(1).to_pylist()]
            langs = batch.column(0).to_pylist()
            for m in {len(w) for w in words}:
                rows = [(a, w) for a, w in zip(langs, words, strict=True) if len(w) == m]
                hashes = word_hashes([a for a, _ in rows], [w[0] for _, w in rows])
                for j in range(1, m):
                    hashes = longer(hashes, word_hashes([a for a, _ in rows], [w[j] for _, w in rows]))
                slot = hashes >> np.uint64(64 - bits)
                np.bitwise_or.at(found, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        yield from _pages({k: found[k * PAGE : (k + 1) * PAGE] for k in np.unique(np.flatnonzero(found) // PAGE).tolist()})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[k] = found.get(k, 0) | np.frombuffer(page, np.uint8)
        yield from _pages(found)

    shape = "page int, marks binary"
    sent = frequent.select("lang", "phrase").mapInArrow(marks, shape)
    out = np.zeros(1 << bits - 3, np.uint8)
    for k, page in sent.repartition("page").mapInArrow(merged, shape).collect():
        out[k * PAGE : k * PAGE + len(page)] = np.frombuffer(page, np.uint8)
    return out


def _pages(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["page", "marks"])


def counted(batches: Iterator[pa.RecordBatch], least: int, memory: str, spill: str | None) -> Iterator[pa.RecordBatch]:
    """The phrases of a bucket (lang, phrase, n: all rows of a phrase are in it) with n summed, of at least `least`."""
    import duckdb

    if spill:
        os.makedirs(spill, exist_ok=True)
    folder = f"{spill}/{uuid.uuid4().hex}" if spill else ""
    with duckdb.connect(f"{folder}.db" if spill else ":memory:", config={"threads": 1, "temp_directory": folder} | ({"memory_limit": memory} if spill else {})) as db:
        try:
            db.execute("CREATE TABLE bucket (lang VARCHAR, phrase VARCHAR, n BIGINT)")
            empty = True
            for batch in batches:
                part = pa.Table.from_batches([batch])  # noqa: F841  duckdb reads it by its name
                db.execute("INSERT INTO bucket SELECT * FROM part")
                empty &= not len(batch)
            if not empty:
                sums = db.sql(f"SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS n FROM bucket GROUP BY lang, phrase HAVING sum(n) >= {least}")
                yield from (b.cast(COUNTED) for b in sums.to_arrow_reader(8192))
        finally:
            if spill:
                shutil.rmtree(folder, ignore_errors=True)
                db.close()
                for path in (f"{folder}.db", f"{folder}.db.wal"):
                    if os.path.exists(path):
                        os.unlink(path)


def spill_folder(spark: SparkSession, name: str) -> str | None:
    """A plain folder that the executors share, for duckdb's files; None if the shared folder is in a store that only Spark reads."""
    path = qualified(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return urlparse(path).path if path.startswith("file:") else None


def frequent_phrases(docs: DataFrame, miner: Miner) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n of every phrase of 1 to `longest` words that occurs `least` times or more; and lang, n of all words."""
    spark = docs.sparkSession
    bare = materialise(pieces(docs), "pieces")
    totals = bare.groupBy("lang").agg(F.sum(F.col("times") * F.size(F.split("piece", " "))).alias("n"))
    spill, bits = spill_folder(spark, "spill"), miner.bits
    least, memory = miner.least, miner.memory
    marked, out = None, None
    shape = "lang string, phrase string, n long"
    for m in range(1, miner.longest + 1):
        side = spark.sparkContext.broadcast(marked)  # of a fixed size

        def sent(batches, m=m, side=side):
            for rows in chunks(batches):
                yield phrases(rows, m, side.value, bits)

        dealt = bare.mapInArrow(sent, shape).repartition("lang", "phrase")
        level = materialise(dealt.mapInArrow(lambda b: counted(b, least, memory, spill), shape), "phrases")
        out = level if out is None else out.unionByName(level)
        if m < miner.longest:
            marked = bitmap(level, bits)
        if m == 2 < miner.longest:
            side = spark.sparkContext.broadcast(marked)

            def kept(batches, side=side):
                for rows in chunks(batches):
                    yield fragments(rows, side.value, bits)

            rest = bare.mapInArrow(kept, "lang string, piece string, times long")
            bare = materialise(rest.groupBy("lang", "piece").agg(F.sum("times").alias("times")), "fragments")
    return out, totals


def collocations(docs: DataFrame, miner: Miner | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: see the module's docstring."""
    miner = miner or Miner()
    found, totals = frequent_phrases(docs, miner)
    words = F.split("phrase", " ")
    candidates = found.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).where("size(words) > 1")
    # a request for each part of each cut: of the first k words (side 0) and of the rest (side 1)
    cut = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    part = lambda side: F.array_join(F.slice("words", 1, F.col("k")) if not side else F.slice("words", F.col("k") + 1, F.size("words")), " ")
    near = lambda side: F.size("words") - F.col("k") == 1 if not side else F.col("k") == 1
    asked = cut.select("lang", "phrase", "a", "k", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), part(s).alias("part"), near(s).alias("near")) for s in (0, 1)])).alias("q")).select("lang", "phrase", "a", "k", "q.*")
    asked = materialise(asked, "requests")
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = range(1, miner.longest)
    got = asked.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a").agg(
        *[F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"f{k}{s}") for k in cuts for s in (0, 1)]
    )
    covered = asked.where("near").groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("most"))
    got = got.join(covered, ["lang", "phrase"], "left").where(f"most IS NULL OR most * 100 < a * {miner.cover}").join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang")
    wide = "CAST({} AS DECIMAL(38,0))"
    score = lambda k: F.expr(f"CAST(({wide.format('a')} * {wide.format('n')} * 1000) div ({wide.format(f'f{k}0')} * {wide.format(f'f{k}1')}) AS BIGINT)")
    options = F.array_compact(F.array(*[F.when(F.col(f"f{k}0").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r"))) for k in cuts]))
    scored = got.select("lang", "phrase", "a", "n", F.array_min(options).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= miner.most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, trim(regexp_replace(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{ENDS}')), '[ \t]+', ' ', 'g'), ' ') AS piece FROM documents),
w AS (SELECT lang, string_split(piece, ' ') AS ws, count(*) AS times FROM p WHERE piece <> '' GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(times * len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
pos AS (SELECT lang, ws, times, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m, CAST(sum(times) AS BIGINT) AS f FROM pos, range(1, 6) AS lengths(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING sum(times) >= 100),
c AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS ws FROM g WHERE m > 1),
cov AS (SELECT lang, part AS phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:m - 1], ' '), array_to_string(ws[2:m], ' ')]) AS part FROM c) GROUP BY ALL),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y FROM c, range(1, 5) AS cuts(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, a, k, gx.f AS l, gy.f AS r, n, CAST((1000::HUGEINT * a * n) // (gx.f::HUGEINT * gy.f) AS BIGINT) AS score
  FROM k JOIN g gx ON gx.lang = k.lang AND gx.phrase = x JOIN g gy ON gy.lang = k.lang AND gy.phrase = y JOIN tot ON tot.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b LEFT JOIN cov ON cov.lang = b.lang AND cov.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= 2000"""
