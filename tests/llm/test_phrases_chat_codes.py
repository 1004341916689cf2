"""Phrases, chat examples and vector codes against plain loops, and their odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, collocations, vector_codes

# -- phrases ------------------------------------------------------------------------------------------------------------------


def mined(docs, miner):
    """collocations() by counting every phrase of every text."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, miner.longest + 1):
                    if i + m <= len(words):
                        f[lang, tuple(words[i : i + m])] += 1
    known = {p: a for p, a in f.items() if a >= miner.least}
    out = defaultdict(list)
    for (lang, w), a in known.items():
        if len(w) < 2:
            continue
        holds = lambda q: any(q[i : i + len(w)] == w for i in range(len(q) - len(w) + 1))
        if any(g == lang and len(q) > len(w) and holds(q) and 100 * b >= miner.cover * a for (g, q), b in known.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[: miner.most], 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_a_plain_count(spark, edge_docs, edge_rows, seed):
    rng = random.Random(seed)
    words = ["The", "of", "sea", "é", "über", "a", "x", "rare" + str(seed)]
    texts = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " \x0b"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), "s", 0) for k in range(80)]
    texts += texts[:30] * 3
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")).withColumns({n: F.lit("extra") for n in ("piece", "times", "phrase", "n", "rank")})
    plain = [(r[2], r[1]) for r in edge_rows] + [(t[2], t[1]) for t in texts]
    for miner in (collocations.Miner(least=4, most=50), collocations.Miner(least=9, most=1000, longest=3, cover=60, bits=15)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, miner).collect())
        assert got == mined(plain, miner)
    assert got


def test_a_full_bitmap_and_equal_hashes_change_nothing(spark, monkeypatch):
    text = "a b c d e f " * 9 + ". b a c b a d " * 7
    rows = pa.table({"lang": ["en", "de"], "piece": [" ".join(text.replace(".", "").split()), "a b c"], "times": pa.array([3, 2], pa.int64())})
    every = np.full(1 << 12, 255, np.uint8)
    want = collocations.phrases(rows, 3, every, 15).to_pylist()
    monkeypatch.setattr(collocations, "longer", lambda hashes, words: hashes * np.uint64(0))
    got = collocations.phrases(rows, 3, every, 15).to_pylist()
    key = lambda r: (r["lang"], r["phrase"])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 5


def test_fragments_are_runs_of_marked_pairs():
    rows = pa.table({"lang": ["en", "de", "en", "en"], "piece": ["a b c x a b", "a b c", "x", "c a b c a"], "times": pa.array([3, 2, 1, 5], pa.int64())})
    marked = np.zeros(1 << 13, np.uint8)
    for pair in ("a b", "b c", "c a"):
        h = collocations.word_hashes(["en"] * 2, pair.split())
        slot = int(collocations.longer(h[:1], h[1:])[0]) >> 48
        marked[slot >> 3] |= 1 << (slot & 7)
    got = sorted((r["lang"], r["piece"], r["times"]) for r in collocations.fragments(rows, marked, 16).to_pylist())
    assert got == [("en", "a b c", 3), ("en", "c a b c a", 5)]


def test_pieces_are_taken_in_chunks(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 10)
    rows = [("en", " ".join("w" * n), 1) for n in (3, 4, 5, 30, 2, 2, 11)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], ["lang", "piece", "times"]) for part in (rows[:3], rows[3:])]
    parts = list(collocations.chunks(iter(batches)))
    assert [r for p in parts for r in zip(*(c.to_pylist() for c in p.columns), strict=True)] == rows
    assert max(sum(len(x.split()) for x in p.column(1).to_pylist()) for p in parts if len(p) > 1) <= 40


def test_no_phrases(spark, no_docs):
    assert collocations.collocations(no_docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, " ,. \t", "en")], "doc_id long, text string, lang string")).collect() == []


# -- chat ---------------------------------------------------------------------------------------------------------------------

ODD = [
    "", None, "\\", "\\!", "\\\\n", "a\nb", "<|end|>", "<|end|>\n<|turn|>assistant\nno", "<", "<<|end|", "<|end|<|end|>\n", "\\<|turn|>\\!", "[[/INST]", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "日本 🎉" * 3, "$1 \\1", "<\\!|end|>",
]


def chat_turns():
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant"]), t) for k, t in enumerate(ODD * 2)]
    rows += [(2, 0, "user", "only a question"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (3, 1, "assistant", "b"), (3, None, "user", "late")]
    rows += [(None, 0, None, "x"), (None, 1, "assistant", None), (4, 0, "a\\n\n<|end|>\\", "odd role"), (4, 1, "assistant", "z" * 20_000)]
    return rows


def test_chat_examples_read_back(spark):
    rows = chat_turns()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("extra") for n in ("example", "whole_", "turns", "loss")}).repartition(3)
    found = chat.examples(turns)
    got = {r.conv_id: r for r in chat.digests(found).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, each in by.items():
        each.sort()
        replies = [t for *_, role, t in each if role == "assistant"]
        assert (got[c].n_turns, got[c].turns_sha256) == (len(each), sha("".join(f"{r}\n{t}\n" for *_, r, t in each)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len("".join(replies)), sha("".join(replies)))
    texts = defaultdict(list)
    for r in found.orderBy("conv_id", "example").collect():
        texts[r.conv_id].append(r)
    for c, each in texts.items():
        whole = each[-1].text
        assert each[-1].whole and sum(r.whole for r in each) == 1 and got[c].formatted_chars == sum(len(r.text) for r in each)
        for r in each:
            assert whole.startswith(r.text) and r.text.count("<|turn|>") == r.text.count("<|end|>\n") == r.n_turns
            role = by[c][r.n_turns - 1][2]
            assert (r.loss_start + r.loss_length == len(r.text) - len("<|end|>\n")) and (role == "assistant" or r.loss_length == 0)
        assert sum(by[c][r.n_turns - 1][2] == "assistant" for r in each) == sum(t[2] == "assistant" for t in by[c])


def test_control_strings_are_escaped(spark):
    template = chat.Template()
    df = spark.createDataFrame([(t,) for t in ODD], "text string").select("text", chat.escape(F.col("text"), template).alias("safe"))
    for text, safe, back in df.select("text", "safe", chat.unescape(F.col("safe"))).collect():
        assert text == back
        assert not any(s in (safe or "") for s in (template.begin, template.end, *template.escaped))


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.examples(none)).collect() == []


def test_chat_runs_no_python(spark):
    plan = chat.examples(spark.createDataFrame(chat_turns(), "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- vector codes -------------------------------------------------------------------------------------------------------------


def plain_codes(rows, coder):
    """By Python's integers, entry by entry."""
    kept = sorted([(i is None, i or 0, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)], key=lambda r: r[:3])
    dims = Counter(len(r[2]) for r in kept)
    dim = max(dims, key=lambda d: (dims[d], d))
    kept = [r for r in kept if len(r[2]) == dim]
    width = dim // coder.parts
    books = [[r[2][p * width : (p + 1) * width] for r in kept[: coder.entries]] for p in range(coder.parts)]

    def nearest(p, v):
        part = v[p * width : (p + 1) * width]
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(coder.rounds):
        new = [list(b) for b in books]
        for p in range(coder.parts):
            groups = defaultdict(list)
            for r in kept:
                groups[nearest(p, r[2])[1]].append(r[2][p * width : (p + 1) * width])
            for k, members in groups.items():
                new[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        books = new
    out = []
    for none, i, v, label in kept:
        best = [nearest(p, v) for p in range(coder.parts)]
        out.append((None if none else i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=str), sha


@pytest.mark.parametrize("coder", [vector_codes.Coder(entries=20), vector_codes.Coder(parts=2, entries=7, rounds=2, bits=2)])
def test_codes_equal_plain_integers(spark, coder):
    rng = np.random.default_rng(4)
    rows = [(int(k), rng.normal(0, 0.3, 12).astype(np.float32).astype(float).tolist(), int(rng.integers(3))) for k in range(150)]
    rows += [(3, rows[3][1], 1), (5, rows[9][1], None), (None, rows[7][1], None), (200, [0.0] * 12, 1), (201, [-0.0005] * 12, 1), (202, [0.0005] * 12, 2)]
    rows += [(-1, None, 1), (-2, [0.1] * 11 + [None], 1), (-3, [0.1] * 11 + [float("nan")], 1), (-4, [float("inf")] + [0.1] * 11, 1), (-5, [0.5, 0.5], 1), (-6, [], 1)]
    rows += [(300 + k, rows[11][1], 2) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({n: F.lit("extra") for n in ("v", "code", "n", "label_", "part")}).repartition(5)
    found, books = vector_codes.vector_codes(df, coder)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.with_label_errors(found).collect()), key=str)
    want, sha = plain_codes(rows, coder)
    assert got == want and vector_codes.digest(books, coder) == sha


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.integers(-(2**40), 2**40, 4) * 2.0**k).tolist() if k < 5 else rng.normal(0, 1, 4).tolist(), 0) for k in range(12)]
    coder = vector_codes.Coder(entries=5, rounds=1)
    found, books = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), coder)
    want, sha = plain_codes(rows, coder)
    assert vector_codes.digest(books, coder) == sha
    top = 1 << 63
    assert sorted((r.vec_id, r.code, r.error) for r in found.collect()) == sorted((i, c, e if e < top else None) for i, c, e, _ in want)


def test_filter_drops_entries_but_never_the_nearest():
    rng = np.random.default_rng(2)
    entries, queries = rng.integers(-500, 500, (256, 8)), rng.integers(-500, 500, (300, 8))
    cells = vector_codes.Cells(entries, 4)
    every = ((queries[:, None] - entries) ** 2).sum(2)
    index, distance = cells.nearest(queries)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert cells.candidates(queries).mean() < 0.25


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.with_label_errors(vector_codes.vector_codes(none)[0]).collect() == []
    with pytest.raises(ValueError, match="parts don't divide"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 6, 1)], "vec_id long, embedding array<float>, label int"))
