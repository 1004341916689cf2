"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are binned; shallow trees are boosted on one feature at a time, round
after round, and summed into that feature's lookup table; then pairs of features are boosted
likewise into two-way tables on the residuals. A score is the logistic of summed table cells, so
scoring is binning and vectorised additions.

Features are computed for every document by tasks over their own rows. The model is fitted on the
driver over labelled rows that aren't held out, at most `most_rows` of them (a documented bound;
those with the smallest hash of the doc_id).

Defined results: a null text is the empty text; null doc_ids count as held out; a null label counts as none; a
label given twice counts once, at its larger value; without labelled rows, or with
one class only, every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialise, pairs, table, texts

THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "mean_word", "distinct_words", "repeated_next", "short_words", "long_words", "upper", "digits", "non_ascii",
    "sentence_ends", "commas", "exclamations", "bars", "marks", "other_punctuation", "log_line", "distinct_lines", "top_word", "spaces",
)
_MARKS = [b for b in b"#$%&*+<=>@\\^_`{}~"]
_OTHER = [b for b in b"\"'()-/:;[]"]


def features(text: bytes) -> tuple[float, ...]:
    """The FEATURES of a text, each finite for any text."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    distinct = Counter(words)
    often = max(distinct.values(), default=0) / w
    return (
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.sum()) / w, len(distinct) / w,
        sum(map(bytes.__eq__, words[1:], words)) / w, float((lengths <= 3).sum()) / w, float((lengths >= 12).sum()) / w,
        upper / max(1, upper + lower), int(count[48:58].sum()) / n, int(count[128:].sum()) / n,
        int(count[46] + count[63]) / w, int(count[44]) / w, int(count[33]) / w, int(count[124]) / w,
        int(count[_MARKS].sum()) / w, int(count[_OTHER].sum()) / w, np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), often,
        int(count[32]) / n,
    )


@dataclass
class Model:
    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    double: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features."""
        bins, total = self.bins(np.asarray(x, float).reshape(-1, len(FEATURES))), np.full(len(x), self.base)
        for k, t in enumerate(self.single):
            total += t[bins[:, k]]
        for (i, j), t in self.double.items():
            total += t[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step of each bin from a tree of up to `leaves` leaves over ordered bins with gradients g and weights h."""
    cells, step = [(0, len(g))], np.zeros(len(g))
    gains = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    while len(cells) < leaves:
        best = (1e-9, 0, 0)
        for c, (a, b) in enumerate(cells):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gain = left_g**2 / (left_h + ridge) + (g[a:b].sum() - left_g) ** 2 / (h[a:b].sum() - left_h + ridge) - gains(a, b)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), c, a + k + 1))
        if not best[2]:
            break
        a, b = cells.pop(best[1])
        cells += [(a, best[2]), (best[2], b)]
    for a, b in cells:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The step of each cell from one cut of each of two features (four leaves), and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    gain = sum(x**2 / (y + ridge) for x, y in zip(*parts, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.empty(g.shape)
    values = [x[i, j] / (y[i, j] + ridge) for x, y in zip(*parts, strict=True)]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return step, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pair_rounds: int = 40, pairs_kept: int = 8, rate: float = 0.1, ridge: float = 5.0) -> Model:
    """Cyclic boosting of single features, then of the pairs that explain most of what is left."""
    model = Model()
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    b, sizes = model.bins(x), [len(c) + 1 for c in model.cuts]
    p = y.mean()
    model.base = float(np.log(p / (1 - p)))
    model.single = [np.zeros(n) for n in sizes]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for k, n in enumerate(sizes):
            if n > 1:
                q = 1 / (1 + np.exp(-total))
                step = rate * _tree(np.bincount(b[:, k], y - q, n), np.bincount(b[:, k], q * (1 - q), n), 4, ridge)
                model.single[k] += step
                total += step[b[:, k]]
    q = 1 / (1 + np.exp(-total))
    found = []
    grid = lambda i, j, v: np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            if sizes[i] > 1 and sizes[j] > 1:
                found.append((_pair_tree(grid(i, j, y - q), grid(i, j, q * (1 - q)), ridge)[1], i, j))
    model.double = {(i, j): np.zeros((sizes[i], sizes[j])) for _, i, j in sorted(found, reverse=True)[:pairs_kept]}
    for _ in range(pair_rounds):
        for (i, j), t in model.double.items():
            q = 1 / (1 + np.exp(-total))
            step = rate * _pair_tree(grid(i, j, y - q), grid(i, j, q * (1 - q)), ridge)[0]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float64()))])

    def rows(batches):
        for doc_id, text in pairs(batches):
            yield doc_id, features(text)

    return texts(docs).mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: 200), "doc_id long, features array<double>")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(found: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Model:
    """Fit on the labelled rows of featured() that aren't held out, at most most_rows."""
    marks = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = found.where(~held_out(F.col("doc_id"))).join(marks, "doc_id")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # a hash range that holds a little more than most_rows is found first, so few rows beside those wanted go to the driver
    share = min(1.0, 1.2 * most_rows / max(1, known.count()) + 1e-3)
    some = known.where(place < int(share * (1 << 30)))
    rows = some.orderBy(place, "doc_id", "features").limit(most_rows).select("features", "quality").toPandas()
    return fit(np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES)), rows["quality"].to_numpy(float))


def scored(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of featured()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    out = found.select("doc_id", "features").mapInArrow(rows, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that the model doesn't reject."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                x = np.array([features(t or b"") for t in part.column(at).cast(pa.binary()).to_pylist()])
                yield part.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(kept, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(featured(table(spark, sf_dir, "documents")), "quality-features")
    return scored(found, train(found, table(spark, sf_dir, "labels")))
