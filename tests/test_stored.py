"""Stored indexes, tolerant quotes, the vault format, keyed versions, the provider and the journal against plain loops."""

import hashlib
import json
import math
import os
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import lexical, provider, quotes, resolve, search, similar, vectors
from corpusloom.plans.journal import Journal
from corpusloom.sources import vault_format
from corpusloom.streaming import versions as keyed

# -- lexical index ------------------------------------------------------------------------------------------------------------


def ranked(docs, questions, limit):
    """BM25 over every document."""
    tokens = {k: re.findall(r"[^\W_]+", (t or "").lower()) for k, t in docs.items()}
    mean, n = sum(map(len, tokens.values())) / len(tokens), len(tokens)
    out = []
    for qid, question in questions:
        scores = Counter()
        for term in re.findall(r"[^\W_]+", question.lower()):
            df = sum(term in t for t in tokens.values())
            for k, t in tokens.items():
                if tf := t.count(term):
                    scores[k] += max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        out += [(qid, k, r, round(s, 5)) for r, (s, k) in enumerate(sorted((-round(s, 6), k) for k, s in scores.items())[:limit], 1) for s in [-s]]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(4000)]
    return {k: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for k in range(n)} | {n: None, n + 1: "w1 " * 300}


@pytest.mark.parametrize("block", [4, 512])
def test_index_gives_the_best_of_all(spark, tmp_path, block):
    docs = corpus(1, 400)
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/index", block=block, buckets=16)
    rows = [(k, t) for k, t in docs.items()]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    assert index.add(frame(rows[:150])) == 150 and index.add(frame(rows[100:300])) == 150 and index.add(frame(rows[:300])) == 0
    assert index.add(frame(rows[300:])) == len(rows) - 300 and len(index.table.committed()) == 3
    questions = [(1, "w1 w2 w7"), (2, "w1 w1 w399 w3 w50"), (3, "nothing"), (4, ""), (5, "w12")]
    ask = spark.createDataFrame(questions, "qid int, question string")
    for merge in (False, True):
        if merge:
            index.merge()
            index.table.vacuum()
            assert len(index.table.committed()) == 1
        got = [(r.qid, r.doc_id, r["rank"], round(r.score, 5)) for r in index.search(ask, 10).orderBy("qid", "rank").collect()]
        assert got == ranked(docs, questions, 10)
    postings = {(r.term, r.doc_id): r.tf for r in index.postings().collect()}
    assert postings == {(t, k): n for k, text in docs.items() for t, n in Counter(re.findall(r"[^\W_]+", (text or "").lower())).items()}


def test_a_question_reads_its_terms_buckets_and_skips_blocks(spark, tmp_path):
    docs = corpus(2, 3000)
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/index", block=16, buckets=32)
    index.add(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    terms = ["w1", "w2", "w9"]
    buckets = {r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(index.bucket(F.col("t"))).collect()}
    every, read = set(index.blocks().inputFiles()), index.blocks(sorted(buckets)).select("term", F.input_file_name().alias("f"), "_metadata.file_path")
    opened = {r.f for r in read.collect()}
    assert len(buckets) <= 3 and len(opened) < len(every) / 4 and {int(re.search(r"bucket=(\d+)", f)[1]) for f in opened} <= buckets
    ask = spark.createDataFrame([(1, "w1 w2 w9")], "qid int, question string")
    found = index.search(ask, 5)
    assert "PartitionFilters" in found._jdf.queryExecution().toString()
    assert [(r.qid, r.doc_id, r["rank"], round(r.score, 5)) for r in found.orderBy("rank").collect()] == ranked(docs, [(1, "w1 w2 w9")], 5)


def test_an_index_that_broke_off_counts_for_nothing(spark, tmp_path, monkeypatch):
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    monkeypatch.setattr(index.table, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(docs)
    monkeypatch.undo()
    assert index.postings().count() == 0 and index.add(docs) == 2 and index.postings().count() == 3


# -- vector table -------------------------------------------------------------------------------------------------------------


def test_vector_table_gives_the_nearest_of_all(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 5, (12, 8))
    v = (centres[rng.integers(12, size=900)] + rng.normal(0, 0.4, (900, 8))).astype(np.float32)
    v[7] = v[8] = v[9]
    table = vectors.VectorTable(spark, f"file://{tmp_path}/v", block=32, pivots=24)
    frame = lambda ids, m: spark.createDataFrame([(int(i), [float(x) for x in m[i]]) for i in ids], "vec_id long, embedding array<float>")
    assert table.write(frame(range(700), v), "m") == 700 and table.write(frame(range(700, 900), v), "m") == 200
    new = v.copy()
    new[::9] = (centres[rng.integers(12, size=100)] + rng.normal(0, 0.4, (100, 8))).astype(np.float32)
    queries = spark.createDataFrame([(int(q), [float(x) for x in v[q]]) for q in range(0, 900, 30)], "qid int, query array<float>")
    for step, m in enumerate((v, new, new)):
        if step == 1:
            assert table.write(frame(range(0, 900, 9), new), "m") == 100
        if step == 2:
            table.merge()
            table.table.vacuum()
        assert {r.vec_id: tuple(r.embedding) for r in table.vectors().collect()} == {i: tuple(float(x) for x in m[i]) for i in range(900)}
        for kind in ("l2", "dot"):
            w = m.astype(np.float64)
            value = (lambda q: np.round(np.sqrt(((w - v[q].astype(float)) ** 2).sum(1)), 6)) if kind == "l2" else (lambda q: -np.round(w @ v[q].astype(float), 9))
            got = {(r.qid, r["rank"]): r.vec_id for r in table.nearest(queries, 7, kind).collect()}
            want = {(q, k + 1): i for q in range(0, 900, 30) for k, i in enumerate(np.lexsort((np.arange(900), value(q)))[:7].tolist())}
            assert got == want
    pivots = table.pivots()
    visits = table.visits(queries.select("qid", F.col("query").cast("array<double>").alias("query")), 7, "l2", pivots)
    blocks, cells = table.blocks().count(), table.blocks().select("cell").distinct().count()
    per = visits.groupBy("qid").agg(F.count("*").alias("b"), F.countDistinct("cell").alias("c")).collect()
    assert max(r.c for r in per) < cells and sum(r.b for r in per) < 0.5 * blocks * len(per)


def test_many_queries_plan_few_rows_and_keep_no_more_than_asked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 16)
    monkeypatch.setattr(vectors, "STRETCH", 4 * 64 * 3)  # 64 blocks of four vectors
    rng = np.random.default_rng(8)
    v = (rng.normal(0, 1, (600, 3)) * 1000).round(1).astype(np.float32)
    v[200:500] = v[200]  # of equal distances more than are asked for
    table = vectors.VectorTable(spark, f"file://{tmp_path}/v", block=4, pivots=1)
    assert table.write(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>"), "m") == 600
    queries = spark.createDataFrame([(q, v[q].tolist()) for q in range(0, 600, 10)], "qid int, query array<float>")
    blocks = table.blocks().count()
    visits = table.visits(queries.select("qid", F.col("query").cast("array<double>").alias("query")), 5, "l2", table.pivots()).count()
    assert blocks >= 150 and visits <= 60 * 8  # not 60 times all blocks
    w = v.astype(float)
    for kind in ("l2", "dot"):
        value = (lambda q: np.round(np.sqrt(((w - w[q]) ** 2).sum(1)), 6)) if kind == "l2" else (lambda q: -np.round(w @ w[q], 9))
        got = {(r.qid, r["rank"]): (r.vec_id, r.value) for r in table.nearest(queries, 5, kind).collect()}
        far = {q: value(q) for q in range(0, 600, 10)}
        want = {(q, k + 1): (i, far[q][i]) for q in far for k, i in enumerate(np.lexsort((np.arange(600), far[q]))[:5].tolist())}
        assert {k: i for k, (i, _) in got.items()} == {k: i for k, (i, _) in want.items()}
        assert all(abs(abs(got[k][1]) - abs(want[k][1])) < 1e-6 * max(1, abs(want[k][1])) for k in want)
        x, y, _ = vectors._kept(w[:60], w, np.full(60, np.inf), 5, kind)
        assert np.bincount(x, minlength=60).tolist() == [5] * 60


def most_broadcast(frame):
    """The greatest number of rows that a broadcast of an executed frame has sent."""

    def nodes(node):
        yield node
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        inner += [node.children().apply(k) for k in range(node.children().size())]
        for child in inner:
            yield from nodes(child)

    found = [n for n in nodes(frame._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "BroadcastExchangeExec"]
    return max((n.metrics().apply("numOutputRows").value() for n in found), default=0)


def test_hits_of_all_query_vectors_are_not_broadcast(spark, tmp_path):
    from corpusloom.plans import registry

    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (5000, 16)).astype(np.float32)
    ids = [k * 100 if k < 2500 else 1_000_001 + k * 100 for k in range(5000)]
    spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>").coalesce(4).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k * 50, f"the word {k}") for k in range(60)], "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    frames = {name: registry.QUERIES[name](spark, f"file://{tmp_path}") for name in ("set_found_by_both", "set_union_ranks")}
    rows = {name: [tuple(r) for r in f.collect()] for name, f in frames.items()}
    near = {q: [ids[k] for k in np.lexsort((ids, np.round(np.sqrt(((v.astype(float) - v[q - 1].astype(float)) ** 2).sum(1)), 6)))[:40]] for q in range(1, 2501)}
    first = [k * 50 for k in range(40)]  # equal scores: the smallest ids
    assert sorted(rows["set_found_by_both"]) == sorted((1, i) for i in near[1] if i in first) and rows["set_found_by_both"]
    score = Counter({(q, i): 1 / (61 + k) for q, hits in near.items() for k, i in enumerate(hits)})
    score.update({(1, i): 1 / (61 + k) for k, i in enumerate(first)})
    assert sorted((q, i, s) for q, i, s in rows["set_union_ranks"]) == sorted((q, i, round(s, 8)) for (q, i), s in score.items())
    assert {name: most_broadcast(f) <= search.BROADCAST_ROWS for name, f in frames.items()} == dict.fromkeys(frames, True)


def test_vectors_of_another_kind_are_an_error(spark, tmp_path):
    table = vectors.VectorTable(spark, f"file://{tmp_path}/v")
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert table.write(frame([]), "m") == 0 and table.metadata() == {} and table.nearest(spark.createDataFrame([(1, [1.0])], "qid int, query array<float>"), 3).collect() == []
    assert table.write(frame([(1, [1.0, 2.0]), (1, [0.0, 0.0]), (None, [1.0, 1.0]), (2, None)]), "m") == 1
    with pytest.raises(vectors.Mismatch, match="2-dimensional vectors of m, not 3-dimensional"):
        table.write(frame([(3, [1.0, 2.0, 3.0])]), "m")
    with pytest.raises(vectors.Mismatch, match="of another"):
        table.write(frame([(3, [1.0, 2.0])]), "another")
    with pytest.raises(vectors.Mismatch, match="1 to 2"):
        table.write(frame([(3, [1.0, 2.0]), (4, [1.0])]), "m")
    assert table.metadata() == {"dimensions": 2, "model": "m", "rows": 1}
    got = table.nearest(spark.createDataFrame([("a", [1.0, 0.0])], "qid string, query array<float>"), 3).collect()
    assert [(r.qid, r.vec_id, r.value, r["rank"]) for r in got] == [("a", 1, 2.0, 1)]


# -- cosine join --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [17, 2048])
def test_cosine_join_finds_every_pair(spark, block):
    rng = np.random.default_rng(3)
    base = np.where(rng.random((60, 32)) < 0.25, rng.random((60, 32)), 0)
    v = np.repeat(base, 4, 0) + np.where(rng.random((240, 32)) < 0.06, rng.random((240, 32)) * 0.6, 0)
    v[::17] = -v[::17]
    v[5] = 0
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, norm, where=norm > 0, out=np.zeros_like(v))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(999, None)], "id long, vector array<double>")
    for threshold in (0.86, 0.3):
        got = sorted((r.a, r.b) for r in similar.cosine_join(rows.where("id % 2 = 0 OR id = 999"), rows, threshold, block).collect())
        assert got == [(a, b) for a in range(0, 240, 2) for b in range(240) if round(float(v[a] @ v[b]), 9) >= threshold]
    assert similar.cosine_join(rows.where("false"), rows.where("false"), 0.5).collect() == []


def test_concepts_meet_all_known_ones(spark):
    known = spark.createDataFrame([(f"k{k}", f"concept number {k}", "thing", 5000 - k) for k in range(300)], "concept_id string, label string, type string, occurrences long")
    refs = spark.createDataFrame([("concept numbr 299", "thing"), ("entirely else", "thing")], "label string, type string")
    got = {r.label: (r.method, r.concept_id) for r in resolve.canonicalise(refs, known, pool=None).collect()}
    pooled = {r.label: r.method for r in resolve.canonicalise(refs, known, pool=5).collect()}
    surface = lambda s: T.trigram_counts(s, 64, {})
    ours, theirs = surface("thing: concept numbr 299"), np.array([surface(f"thing: concept number {k}") for k in range(300)])
    best = int(np.round(theirs @ ours, 9).argmax())
    assert got["concept numbr 299"] == ("embedding", f"k{best}") and best > 5 and got["entirely else"][0] == "new" and pooled["entirely else"] == "new"


# -- quotes -------------------------------------------------------------------------------------------------------------------


def test_tolerant_quotes_in_many_texts(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta", "straße", "ÉTÉ", "x", "ﬁn", "🎉"]
    texts = [(k, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t ", " "]) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(100, None), (101, ""), (102, "  ")]
    wanted = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for k in range(40)]
    wanted += [(50 + k, q.upper()) for k, q in wanted[:15]] + [(80 + k, q.replace(" ", " \n ")) for k, q in wanted[:15]] + [(200, ""), (201, None), (202, " \t"), (203, " beta "), (204, "never there"), (205, "STRASSE"), (205, "STRASSE")]
    docs, ask = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(wanted, "item_id long, quote string")

    def plain(text, quote):
        q = (quote or "").strip()
        if not q:
            return None
        if (k := (text or "").find(q)) >= 0:
            return k, k + len(q), "exact"
        for how, flag in (("space", False), ("case", True)):
            fold = (lambda s: s.casefold()) if flag else (lambda s: s)
            target = fold(" ".join(q.split()))
            for start in range(len(text or "")):
                if text[start].isspace():
                    continue
                for end in range(start + 1, min(len(text), start + 60) + 1):
                    if fold(" ".join(text[start:end].split())) == target and not text[end - 1].isspace():
                        return start, end, how
        return None

    want = sorted((d, i, *found) for d, t in texts for i, q in wanted if (found := plain(t, q)))
    for block in (7, 4096):
        got = sorted(tuple(r) for r in quotes.quotes_in(docs, ask, block=block).collect())
        assert got == want
    assert {w[4] for w in want} == {"exact", "space", "case"}


def test_expected_claims(spark):
    rng = random.Random(2)
    names = ["Zoé Martin", "zoe", "the Book", "book of hours", "(read)", "was reading", ""]
    facts = [tuple(rng.choice(names[:-1]) for _ in range(3)) for _ in range(25)]
    expected = [(k, *(rng.choice([*names, None, "never"]) for _ in range(3))) for k in range(200)]
    normal = lambda s: spark.createDataFrame([(s,)], "s string").select(T.normalize_label(F.col("s"))).first()[0]
    known = {s: normal(s) for s in [*names, "never"]} | {None: ""}
    want = sorted(k for k, *parts in expected if any(all(known[p] in known[g] for p, g in zip(parts, f, strict=True)) for f in facts))
    claims, rows = spark.createDataFrame(expected, "item_id long, subject string, predicate string, object string"), spark.createDataFrame(facts, "subject string, predicate string, object string").repartition(3)
    for block in (30, 4096):
        assert sorted(r.item_id for r in quotes.claims_met(claims, rows, block=block).collect()) == want
    assert 0 < len(want) < 200
    assert quotes.claims_met(claims, rows.where("false")).collect() == []


# -- vault format -------------------------------------------------------------------------------------------------------------


def test_vault_format(spark, tmp_path):
    files = {f"n{k}.md": f"note {k}".encode() for k in range(5)} | {f"a/b{k}/c/d{j}.markdown": f"deep {k} {j}".encode() for k in range(4) for j in range(3)}
    files |= {"bom.md": b"\xef\xbb\xbf# Hi", "_draft.md": b"x", ".hidden/h.md": b"y", "empty.md": b""}
    for name, data in (files | {".git/no.md": b"x", "a/.trash/no.md": b"x", "c.txt": b"x"}).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = {n: (d.decode("utf-8-sig"), hashlib.sha256(d).hexdigest(), len(d)) for n, d in files.items()}
    for parts in ("1", "3", "100"):
        got = vault_format.notes(spark, f"file://{tmp_path}", partitions=parts).collect()
        assert {r.relative_path: (r.text, r.content_hash, r.byte_size) for r in got} == want and len(got) == len(want)
    assert vault_format.notes(spark, f"file://{tmp_path}", excluded="a").where("relative_path LIKE 'a/%'").count() == 0
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="bad.md isn't UTF-8"):
        vault_format.notes(spark, f"file://{tmp_path}").collect()
    with pytest.raises(Exception, match="there is no folder"):
        vault_format.notes(spark, f"file://{tmp_path}/none").collect()


def test_a_second_trigger_takes_changed_notes_only(spark, tmp_path):
    vault, out, state = tmp_path / "vault", tmp_path / "out", tmp_path / "state"
    (vault / "a").mkdir(parents=True)
    for k in range(4):
        (vault / f"a/{k}.md").write_text(f"first {k}")
        os.utime(vault / f"a/{k}.md", (1000 + k, 1000 + k))

    def trigger():
        stream = vault_format.notes(spark, f"file://{vault}", stream=True)
        stream.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{state}").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.relative_path, r.text) for r in spark.read.parquet(f"file://{out}").collect())

    first = [(f"a/{k}.md", f"first {k}") for k in range(4)]
    assert trigger() == first and trigger() == first
    (vault / "a/1.md").write_text("second 1")
    (vault / "new.md").write_text("new")
    assert trigger() == sorted([*first, ("a/1.md", "second 1"), ("new.md", "new")])


# -- keyed versions -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [2, 5])
def test_versions_close_each_other_whatever_the_batches(spark, tmp_path, batches):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(f"d{d}", f"d{d}v{k}", start + timedelta(hours=rng.randint(0, 200))) for d in range(12) for k in range(rng.randint(1, 9))]
    rows += rows[:5]
    rng.shuffle(rows)
    schema = "doc string, version string, at timestamp"
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = {(r.document, r.version): r.closed_by for r in keyed.closed_versions(stream, "version", "doc", "at").collect()}
    by = {}
    for d, v, at in set(rows):
        by.setdefault(d, []).append((at, v))
    assert got == {(d, v): (order[k + 1][1] if k + 1 < len(order) else None) for d, each in by.items() for order in [sorted(each)] for k, (_, v) in enumerate(order)}


# -- provider and journal -----------------------------------------------------------------------------------------------------


class Scripted:
    """Notes each call in a folder; answers with what `reply` makes of a prompt; fails on prompts that hold `broken`."""

    def __init__(self, folder, reply=str.upper, broken=None):
        self.model, self.folder, self.reply, self.broken = "scripted", str(folder), reply, broken
        os.makedirs(folder, exist_ok=True)

    def complete(self, prompts):
        with open(f"{self.folder}/{os.getpid()}", "a") as f:
            f.write(json.dumps(prompts) + "\n")
        if self.broken and any(self.broken in p for p in prompts):
            raise RuntimeError("no answer")
        return [self.reply(p) for p in prompts]

    def calls(self):
        return [json.loads(line) for name in os.listdir(self.folder) for line in open(f"{self.folder}/{name}")]


def test_provider_is_asked_once_a_prompt(spark, tmp_path):
    answers, model = provider.Answers(spark, f"file://{tmp_path}/answers"), Scripted(tmp_path / "calls", broken="bad")
    prompts = spark.createDataFrame([(p,) for p in ["a", "b", "a", None, "c", "bad 1", "d"] * 3], "prompt string")
    failed = answers.ask(prompts, model, "r1", batch=2, tries=2)
    assert [r.error for r in failed.collect()] == ["RuntimeError: no answer"]
    assert sorted(r.response for r in answers.read().collect()) == ["A", "B", "C", "D"]
    asked = [p for c in model.calls() for p in c]
    assert all(len(c) <= 2 for c in model.calls()) and asked.count("bad 1") in (2, 3)
    before = len(model.calls())
    assert answers.ask(prompts.where("prompt NOT LIKE 'bad%'"), model, "r2").count() == 0 and len(model.calls()) == before
    model.broken = None
    answers.ask(prompts, model, "r3")
    assert [c for c in model.calls() if c == ["bad 1"]] and sorted(r.response for r in answers.read().collect()) == ["A", "B", "BAD 1", "C", "D"]


def claims(prompt):
    """Each sentence `X reads Y.` is a claim; `X never Y.` is one whose quote isn't there; without either the response is no JSON if it has `garbage`."""
    if "garbage" in prompt:
        return "{no json"
    fact = lambda s, o, q: {"subject": {"label": s, "type": "person"}, "predicate": "reads", "object": {"label": o, "type": "book"}, "quote": q}
    return json.dumps({"facts": [fact(s, o, f"{s} {v} {o}" if v == "reads" else "not said") for s, v, o in re.findall(r"(\w+) (reads|never) (\w+)", prompt)]})


NOTES = {"2024-01-02-a.md": "Zoe reads Emma.\n\nMarc reads Ulysses.", "b.md": "---\ndate: 2024-03-04\n---\nAnn never Emma.", "c.md": "garbage", "d.md": ""}
LATER = NOTES | {"2024-01-02-a.md": "Zoe reads Emma.\n\nMarc reads Persuasion.", "e.md": "Ann reads emma."}


def state(journal):
    """What the tables hold, without runs' names and moments."""
    known = {r.concept_id: r.label for r in journal.concepts().collect()}
    nodes, edges = journal.graph()
    return {
        "versions": sorted((r.relative_path, r.content_hash, str(r.event_time)[:10]) for r in journal.versions().collect()),
        "chunks": sorted((r.relative_path, r.text) for r in journal.chunks().collect()),
        "facts": sorted((r.subject, r.object, r.quote, known[r.subject_concept], known[r.object_concept], r.superseded_by is None) for r in journal.facts().collect()),
        "rejections": sorted((r.reason, r.detail) for r in journal.rejections().collect()),
        "concepts": sorted((r.label, r.type, r.occurrences) for r in journal.concepts().collect()),
        "edges": sorted((known[r.src], known[r.dst]) for r in edges.collect()), "nodes": sorted(r.label for r in nodes.collect()),
        "vectors": journal.index.vectors().count() if journal.index.metadata() else 0,
    }


def written(spark, folder, notes):
    folder.mkdir(exist_ok=True)
    for name, text in notes.items():
        if not (folder / name).exists() or (folder / name).read_text() != text:
            (folder / name).write_text(text)
    return vault_format.notes(spark, f"file://{folder}")


def moment(day):
    return F.to_timestamp(F.lit(f"2024-06-{day:02}"))


def test_journal_goes_on_from_its_data(spark, tmp_path, monkeypatch):
    model = Scripted(tmp_path / "calls", claims)
    journal = Journal(spark, f"file://{tmp_path}/j")
    assert journal.ingest(written(spark, tmp_path / "vault", NOTES), moment(1), "i1") == {"versions": 4, "chunks": 3, "superseded": 0}
    assert journal.process(model, moment(2), "p1") == {"facts": 2, "rejections": 2, "concepts": 4, "aliases": 0, "processed": 3}
    assert journal.embed() == 3 and journal.embed() == 0
    calls = len(model.calls())
    # nothing changed: nothing is done, and no model is asked
    assert journal.ingest(written(spark, tmp_path / "vault", NOTES), moment(3)) == {"versions": 0, "chunks": 0, "superseded": 0}
    assert journal.process(model, moment(3))["processed"] == 0 and len(model.calls()) == calls
    # an edit supersedes the old version's facts and keeps them
    assert journal.ingest(written(spark, tmp_path / "vault", LATER), moment(4), "i2") == {"versions": 2, "chunks": 2, "superseded": 1}
    facts = journal.facts().collect()
    assert len(facts) == 2 and {r.superseded_by for r in facts} == {"i2"} and journal.graph()[1].count() == 0
    # the run breaks off after its model was asked
    commit = journal.table.commit
    monkeypatch.setattr(journal.table, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        journal.process(model, moment(5), "p2")
    monkeypatch.setattr(journal.table, "commit", commit)
    calls = len(model.calls())
    assert journal.process(model, moment(6), "p3") == {"facts": 3, "rejections": 0, "concepts": 2, "aliases": 4, "processed": 2} and len(model.calls()) == calls
    assert journal.embed() == 2
    runs = {r.run_id: (r.stage, r.status, r.error) for r in journal.runs().collect()}
    assert runs == {"i1": ("ingest", "completed", None), "p1": ("process", "completed", None), "i2": ("ingest", "completed", None), "p2": ("process", "failed", "ZeroDivisionError: division by zero"), "p3": ("process", "completed", None)}
    # the same as a run that never broke off
    clean = Journal(spark, f"file://{tmp_path}/clean")
    clean.ingest(written(spark, tmp_path / "other", NOTES), moment(1))
    clean.process(model, moment(2))
    clean.ingest(written(spark, tmp_path / "other", LATER), moment(4))
    clean.process(model, moment(6))
    clean.embed()
    assert state(journal) == state(clean)
    assert [f for f in state(journal)["facts"] if f[-1]] == [("Ann", "emma", "Ann reads emma", "Ann", "Emma", True), ("Marc", "Persuasion", "Marc reads Persuasion", "Marc", "Persuasion", True), ("Zoe", "Emma", "Zoe reads Emma", "Zoe", "Emma", True)]
    told = journal.retrieve(spark.createDataFrame([(1, "who reads Persuasion")], "qid int, question string")).first()
    assert "Marc --reads--> Persuasion" in told.facts


def test_a_limited_run_leaves_the_rest(spark, tmp_path):
    journal, model = Journal(spark, f"file://{tmp_path}/j"), Scripted(tmp_path / "calls", claims)
    journal.ingest(written(spark, tmp_path / "vault", NOTES), moment(1))
    assert journal.process(model, moment(2), limit=1)["processed"] == 1 and journal.pending().count() == 2
    assert journal.process(model, moment(3))["processed"] == 2 and journal.pending().count() == 0


def test_the_run_over_conversations_is_a_plain_run(spark, tmp_path):
    from corpusloom.operators import segment
    from corpusloom.plans import registry

    rng = random.Random(6)
    turns = {c: [("user" if t % 2 == 0 else "assistant", " ".join(rng.choice(["alpha", "beta.", "gamma", "Delta!"]) for _ in range(rng.randint(3, 260)))) for t in range(n)] for c, n in enumerate((1, 2, 3, 5))}
    rows = [(c, t, role, text) for c, each in turns.items() for t, (role, text) in enumerate(each)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    want = []
    for c, each in turns.items():
        notes = ["".join(f"## {role}\n\n{text}\n\n" for role, text in each[:upto]) for upto in (2, None)]
        for day, note in enumerate(dict.fromkeys(notes), 1):
            for k, (a, b, _) in enumerate(segment.chunk(note)):
                part = note[a:b]
                quote = part[:20].strip()
                start = a + part.index(quote)
                want.append((f"notes/2024-01-02-{c}.md", k, part.split()[0], start, start + len(quote), quote, f"process{day}", "ingest2" if day == 1 and notes[0] != notes[1] else None))
    got = [tuple(r) for r in registry.QUERIES["run_notes"](spark, f"file://{tmp_path}").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({w[6] for w in want}) == 2


def test_streams_of_tables_that_are_folders(spark, tmp_path):
    from corpusloom.streaming import incremental

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/many/documents.parquet")
    docs.where("false").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    rows = {d: sorted(tuple(r) for r in incremental.ingested_stream(spark, f"file://{tmp_path}/{d}").collect()) for d in ("many", "none")}
    assert [r[0] for r in rows["many"]] == list(range(20)) and rows["none"] == []


def test_work_queue_over_a_folder(spark, tmp_path):
    from corpusloom.plans import registry

    spark.range(20).withColumnRenamed("id", "doc_id").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted(r[0] for r in registry.QUERIES["str_work_queue"](spark, f"file://{tmp_path}").collect()) == [k for k in range(20) if k % 3]


def test_vault_of_one_large_folder(tmp_path):
    """A folder's files are dealt out over tasks, each file to one of them."""
    (tmp_path / "notes" / "old").mkdir(parents=True)
    names = {f"notes/{k}.md" for k in range(1000)} | {f"notes/old/{k}.md" for k in range(30)} | {"top.md"}
    for name in names:
        (tmp_path / name).write_text(name)
    listing = vault_format.Listing({"path": f"file://{tmp_path}", "partitions": "6"})
    read = [[name for (_, name, _), _ in listing.notes(part)] for part in listing.dealt()]
    assert sorted(name for part in read for name in part) == sorted(names)
    assert len(read) == 6 and max(map(len, read)) < 2 * len(names) / 6


def test_streams_of_repeated_and_null_ids(spark, tmp_path):
    """As in their SQL, a row that shares its id with others, or has none, is a row of its own, and a second run adds nothing."""
    from corpusloom.plans import registry

    ids = [1, 1, 2, 3, 3, None, None, -1, -2, 4, 4, 4]
    spark.createDataFrame([(k, f"text {i}") for i, k in enumerate(ids)], "doc_id long, text string").repartition(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    run = lambda name: sorted((r[0] for r in registry.QUERIES[name](spark, f"file://{tmp_path}").collect()), key=str)
    assert run("str_work_queue") == sorted((k for k in ids if k is not None and k % 3), key=str)
    assert run("str_incremental_ingest") == sorted(ids, key=str)


def test_responses_to_short_texts(spark, tmp_path):
    """A text that is too short to be quoted: its response's quote is blank, which stands nowhere."""
    from corpusloom.plans import registry

    texts = ["", "ab", "abc", "  \t\n ", "a text that is long enough", "ab", "ab", "ab"]
    spark.createDataFrame([(k * 4 if k < 5 else k, t, "en", "src1") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.chunk_id: r.reason for r in registry.QUERIES["fn_json_validate"](spark, f"file://{tmp_path}").collect()}
    assert got == {"0": "quote_not_found", "4": "quote_not_found", "12": "quote_not_found", "5": "quote_not_found", "6": "unparseable_response", "7": "schema_violation"}


def test_index_counts_within_tasks(spark, tmp_path, monkeypatch):
    """Tasks hand on blocks of a term, not a row a posting, and hold a bounded number of tokens."""
    docs, made, stored_ = corpus(3, 300), {}, lexical.stored
    monkeypatch.setattr(lexical, "stored", lambda df, name: made.setdefault(name, stored_(df, name)))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/index", block=64)
    index.add(frame)
    want = sorted((t, k, n) for k, text in docs.items() for t, n in Counter((text or "").split()).items())
    assert sorted((r.term, r.doc_id, r.tf) for r in index.postings().collect()) == want
    assert made["lexical-counted"].count() < len(want) / 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([["a"] * 5, [], None, ["b"] * 3])], ["key", "tokens"])
    monkeypatch.setattr(lexical, "SORTED", 5)
    assert [len(p) for p in lexical._pieces(iter([batch]), 1)] == [3, 1]


def test_table_is_searched_without_building_an_index(spark, tmp_path, monkeypatch):
    docs = {k: t for k, t in corpus(2, 300).items() if t is not None}
    table = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(table)
    questions = [(1, "w1 w2 w7"), (2, "w1 w1 w399 w3 w50"), (3, "nothing"), (4, "")]
    ask, rows = spark.createDataFrame(questions, "qid int, question string"), spark.read.parquet(table)
    find = lambda: sorted((r.qid, r["rank"], r.doc_id) for r in lexical.search_table(spark, table, rows, ask, 9).collect())
    with monkeypatch.context() as m:
        m.setattr(lexical.LexicalIndex, "add", lambda *_: pytest.fail("an index is built"))
        scanned = find()
        m.setattr(search, "ASKED", 2)
        assert find() == scanned
    lexical.of_table(spark, table, rows)
    assert find() == scanned == [(q, r, k) for q, k, r, _ in ranked(docs, questions, 9)]


def test_claims_of_many_equal_facts(spark):
    """Equal facts are looked at once, and claims that were met are not looked for again; all that are met are told."""
    facts = spark.createDataFrame([(f"user {k % 5}", "view", f"item {k % 7}") for k in range(500)], "subject string, predicate string, object string")
    wanted = [(k, f"USER {k % 6}", "" if k % 2 else "View", f"(item {k % 8})") for k in range(48)] + [(99, "nobody", "", "")]
    met = quotes.claims_met(spark.createDataFrame(wanted, "item_id int, subject string, predicate string, object string"), facts, block=5)
    assert sorted(r[0] for r in met.collect()) == [k for k in range(48) if k % 6 < 5 and k % 8 < 7]
