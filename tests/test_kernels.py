"""Text kernels, segmentation, extraction, the fact log, resolution, sources and streams on small frames."""

import gzip
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import extract, facts, graph, quotes, resolve, search, segment
from corpusloom.plans import compose
from corpusloom.sources import vault
from corpusloom.streaming import incremental

SOURCE = "L'été dernier, Zoé a fini\nla traduction du poème.\nElle en est fière."


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("quote", "found"),
    [("Zoé a fini", "Zoé a fini"), ("a fini la traduction", "a fini\nla traduction"), ("  du   poème. ", "du poème."), ("elle EN est", "Elle en est"), ("jamais écrit", None), ("  ", None), ("(a|b", None)],
)
def test_quotes_are_located(spark, quote, found):
    span = one(spark, T.locate_quote(F.col("t"), F.col("q")), t="🎉 " + SOURCE, q=quote)
    assert (span and ("🎉 " + SOURCE)[span.start : span.end]) == found


@pytest.mark.parametrize(("raw", "label"), [("  «Écrire» ", "«ecrire»"), ("The Great   Gatsby!", "the great gatsby"), ("STRAẞE", "strasse"), ("...", ""), ("Marc", "marc"), ("Marco", "marco"), ("C#", "c#"), ("C++", "c++"), ("(C/C++)", "c/c++"), ("ﬁn", "fin"), ("a/b", "a/b"), ("*x*", "*x*")])
def test_labels(spark, raw, label):
    assert one(spark, T.normalize_label(F.col("x")), x=raw) == label


def test_digests(spark):
    import hashlib

    assert one(spark, T.digest(F.lit("fact"), F.lit("a"), F.lit(1))) == hashlib.sha256(b"fact\0a\0001").hexdigest()[:32]
    assert one(spark, T.digest(F.lit("ab"), F.lit("c"))) != one(spark, T.digest(F.lit("a"), F.lit("bc")))
    assert one(spark, T.strip_accents_any(F.col("x")), x="ﬁn é Ω") == "fin e Ω"


def test_signals(spark):
    text = "On 2024-05-06 at 9h30, #tag and (#other) @bob see https://x.example/a?b=1 mail a@b.example [[Page|shown]] in /var/log/x #tag"
    assert one(spark, T.hashtags(F.col("t")), t=text) == ["tag", "other)"] and one(spark, T.times(F.col("t")), t=text) == ["9:30"]
    assert one(spark, T.wikilinks(F.col("t")), t=text) == ["Page"] and one(spark, T.mentions(F.col("t")), t=text) == ["bob"]
    assert one(spark, T.urls(F.col("t")), t=text) == ["https://x.example/a?b=1"] and one(spark, T.paths(F.col("t")), t=text) == ["//x.example/a", "/var/log/x"]
    assert one(spark, T.iso_dates(F.col("t")), t=text) == ["2024-05-06"] and one(spark, T.emails(F.col("t")), t=text) == ["a@b.example"]
    assert one(spark, T.detect_language(F.col("t")), t="je suis dans la maison avec les enfants") == "fr"
    assert one(spark, T.detect_language(F.col("t")), t="the cat is on the mat") == "en" and one(spark, T.detect_language(F.col("t")), t="the") == "und"
    assert one(spark, T.citations(F.col("t")), t="a [2] b [1][2] [x]") == [1, 2]
    assert one(spark, T.match_query(F.col("t")), t='a OR "b" NEAR(c*') == '"a" OR "OR" OR "b" OR "NEAR" OR "c"'
    assert one(spark, T.slug(F.col("t")), t="Été à la Plage: l'arrivée!") == "ete-a-la-plage-l-arrivee"
    assert one(spark, T.normalise_path(F.col("t")), t="/a\\b/c.md/") == "a/b/c.md"


SIGNALS = [
    "mail Ünal.b+c@host-1.example.org, x@y.z. and a@b",
    "#a #ab #tag-2! (#été) x#no ##twice #" + "l" * 60,
    "@a @ab @bob.smith, x@no @@no (@zoé)",
    "2024-05-06 x2024-05-07 2024-05-08x 12024-05-09 2024-05-10, 2024-05-11",
    "9h30 99:30 23:59 24:00 7:05, 12:345 1h5 at 08h00.",
    "C:\\dir\\f.txt ~/notes/a.md ./b /etc /x d:\\é/ü http://a.example/p",
    "see https://x.example/a?b=1) <http://y.example/z> 'https://q.example/1'",
    "[[Page]] [[ Other |shown]] [[Page|again]] [[]] [[a\nb]]",
    "un café\xa0très bon, 3½ fois\u2003#après\u2003@midi",
]


def test_signals_are_those_of_the_fixed_patterns(spark):
    """The JVM's matches against Python's own of the same patterns."""
    import re

    once = lambda found: list(dict.fromkeys(f.strip() for f in found if f.strip()))
    want = {"urls": T.URL, "emails": T.EMAIL, "hashtags": T.HASHTAG, "mentions": T.MENTION, "wikilinks": T.WIKILINK, "iso_dates": T.ISO_DATE, "paths": T.FS_PATH}
    rows = spark.createDataFrame(list(enumerate(SIGNALS)), "i int, t string").select("i", *[getattr(T, n)(F.col("t")).alias(n) for n in [*want, "times"]]).collect()
    for r in rows:
        for name, pattern in want.items():
            assert r[name] == once(re.findall(pattern, SIGNALS[r.i])), (name, SIGNALS[r.i])
        assert r.times == once(f"{h}:{m}" for h, m in re.findall(T.CLOCK_TIME, SIGNALS[r.i]))
    assert rows[4].times == ["9:30", "23:59", "7:05", "08:00"] and rows[1].hashtags == ["ab", "tag-2", "été)", "l" * 50]
    assert rows[3].iso_dates == ["2024-05-06", "2024-05-10", "2024-05-11"]


def test_languages(spark):
    for text, want in [("quoi car ces tes fait bien", "fr"), ("what then today yesterday tomorrow", "en"), ("ne ou se y za", "und"), ("il est la the and is", "und"), ("je tu il elle", "und"), ("être très été", "und"), ("aujourd hui hier demain alors 12 34", "fr")]:
        assert one(spark, T.detect_language(F.col("t")), t=text) == want, text


def test_event_times(spark):
    def at(front, path="a.md"):
        m = F.create_map(*[F.lit(x) for kv in front.items() for x in kv]) if front else F.create_map().cast("map<string,string>")
        return str(one(spark, T.event_time(m, F.lit(path), F.to_timestamp(F.lit("2000-01-01")))))[:16]

    assert at({"date": "2024-01-02"}) == "2024-01-02 00:00" and at({"created": "2024-01-02T10:30:00"}) == "2024-01-02 10:30"
    assert at({"date": "on 2024-03-04, I think"}, "2023-01-01.md") == "2024-03-04 00:00"
    assert at({"date": "no idea", "created": "2022-02-02"}) == "2022-02-02 00:00" and at({}, "x/2023-05-06-note.md") == "2023-05-06 00:00"
    assert at({}, "2023-02-31.md") == at({}) == "2000-01-01 00:00"


def test_uncited(spark):
    for text, passages, want in [("I know", [1], True), ("I know [1]", [1], False), ("nothing", [], False)]:
        assert one(spark, T.is_uncited(F.lit(text), F.array(*map(F.lit, passages)).cast("array<int>"))) == want


def brute_locate(text, quote):
    """By every pair of ends: the first slice that is the quote, then but for white space, then but for case too."""
    import re

    words = quote.split()
    if not words:
        return None
    at = text.find(quote.strip())
    if at >= 0:
        return at, at + len(quote.strip())
    for flags in (0, re.I):
        if found := re.search(r"\s+".join(map(re.escape, words)), text, flags):
            return found.span()
    return None


def test_located_quotes_of_documents(spark):
    from corpusloom.plans import registry

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = registry.QUERIES["fn_locate_quote"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_locate(texts[r.doc_id] or "", r.quote or "")
        assert ((r.start, r.stop) if r.start is not None else None) == want, (r, texts[r.doc_id][:80])
    found = {k: sum(r.start is not None for r in rows if r.doc_id % 4 == k) for k in range(4)}
    assert min(found[0], found[1], found[2]) > 20 and found[3] == 0


def test_embeddings_are_unit_vectors(spark):
    v = one(spark, T.trigram_embedding(F.col("x"), 32), x="Some name")
    assert len(v) == 32 and abs(sum(e * e for e in v) - 1) < 1e-9
    assert one(spark, T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


NOTE = "---\ndate: 2024-01-02\ntitle: x\n---\n# One\n\nFirst block.\nStill it.\n\n## Two\n\nSecond block.\n\n# Three\n\n- item\n"


def test_blocks_are_slices():
    found = [(NOTE[a:b], path) for a, b, path in segment.blocks(NOTE, segment.body_offset(NOTE))]
    assert found == [("First block.\nStill it.", ("One",)), ("Second block.", ("One", "Two")), ("- item", ("Three",))]


def test_blocks_of_odd_notes():
    texts = lambda note: [(note[a:b], path) for a, b, path in segment.blocks(note, segment.body_offset(note))]
    assert texts("# Title ##\n\ntext") == [("text", ("Title",))]
    assert texts("  # indented is text\n#no space\n") == [("  # indented is text\n#no space", ())]
    assert texts("---\r\ndate: x\r\n---\r\nbody\r\n\r\n## Sub\r\nmore  \r\n") == [("body", ()), ("more", ("Sub",))]
    assert texts("## Two\n### Three\n## Four\na\n# One\nb") == [("a", ("Two", "Four")), ("b", ("One",))]
    assert texts("") == texts("# only a heading") == texts("\n \n\t\n") == []
    assert texts("--- no\nfront\n---\n") == [("--- no\nfront\n---", ())]


def test_long_blocks_are_cut_at_single_line_ends():
    text = "a" * 60 + "\n\n\n" + "b" * 60
    assert list(segment.pieces(text, 0, len(text), 100)) == [(0, 62), (62, 123)]
    assert list(segment.pieces("x" * 250, 0, 250, 100)) == [(0, 100), (100, 200), (200, 250)]
    assert list(segment.pieces("One is here. Two is here. Three", 0, 31, 30)) == [(0, 25), (25, 31)]


@pytest.mark.parametrize(("target", "overlap"), [(30, 0), (60, 20), (400, 40), (8, 0)])
def test_chunks_cover_the_text(spark, target, overlap):
    text = NOTE + "".join(f"Sentence number {k} is here. " for k in range(60))
    found = segment.chunk(text, target, overlap)
    covered = {k for a, b, _ in found for k in range(a, b)}
    # all but white space and headings
    headings = {k for m in re.finditer(r"(?m)^#.*$", text) for k in range(*m.span())}
    assert all(k in covered or text[k].isspace() or k in headings for k in range(segment.body_offset(text), len(text)))
    assert all(b - a <= target for a, b, _ in found) and [a for a, _, _ in found] == sorted({a for a, _, _ in found})
    rows = segment.explode_spans(spark.createDataFrame([(1, NOTE), (2, ""), (3, None)], "id int, body string"), segment.chunks_of(F.col("body"))).collect()
    assert {r.id for r in rows} == {1} and all(NOTE[r.start : r.end] == r.text for r in rows)


def response(**change):
    fact = {"subject": {"label": "Zoé", "type": "person"}, "predicate": "finished", "object": {"label": "translation", "type": "work"}, "quote": "a fini la traduction"}
    return json.dumps({"facts": [fact | change]})


def test_extraction(spark):
    rows = [(1, response()), (2, response(quote="never said")), (3, "{not json"), (4, response(confidence=3.0)), (5, response(extra=1)), (6, json.dumps({"facts": json.loads(response())["facts"] * 2})), (7, response(confidence="0.5")), (8, None), (9, '{"facts": []}')]
    chunks = spark.createDataFrame([(str(i), SOURCE, 100, r) for i, r in rows], "chunk_id string, text string, char_start int, response string")
    found, lost = extract.extract(chunks)
    facts_ = {r.chunk_id: r for r in found.collect()}
    assert set(facts_) == {"1", "6"} and found.count() == 2 and facts_["1"].confidence == 0.7
    assert SOURCE[facts_["1"].char_start - 100 : facts_["1"].char_end - 100] == facts_["1"].quote == "a fini\nla traduction"
    assert {r.chunk_id: r.reason for r in lost.collect()} == {"2": "quote_not_found", "3": "unparseable_response", "4": "schema_violation", "5": "schema_violation", "7": "schema_violation", "8": "unparseable_response"}


def test_fact_log(spark):
    old = spark.createDataFrame([("f1", "c1", None, "2024-01-01"), ("f2", "c2", "r1", "2024-01-01")], "fact_id string, chunk_id string, superseded_by string, knowledge_time string")
    new = spark.createDataFrame([("f1", "c1"), ("f3", "c3"), ("f3", "c3")], "fact_id string, chunk_id string")
    assert [r.fact_id for r in facts.insert_ignore(old, new, ["fact_id"]).collect()] == ["f3"]
    chunks = spark.createDataFrame([("c1", "v1"), ("c2", "v1"), ("c9", "v2")], "chunk_id string, version_id string")
    done = facts.supersede(old, chunks, spark.createDataFrame([("v1", "r2")], "version_id string, run_id string"))
    assert {r.fact_id: r.superseded_by for r in done.collect()} == {"f1": "r2", "f2": "r1"}
    assert facts.current(done).count() == 0 and done.count() == 2
    again = facts.supersede(done, chunks, spark.createDataFrame([("v1", "r3")], "version_id string, run_id string"))
    assert {r.superseded_by for r in again.collect()} == {"r1", "r2"}
    runs = spark.createDataFrame([("r1", "2024-01-05"), ("r2", "2024-02-01")], "run_id string, started_at string")
    known = lambda day: sorted(r.fact_id for r in facts.as_of(done, runs, F.lit(day)).collect())
    assert known("2023-12-31") == [] and known("2024-01-03") == ["f1", "f2"] and known("2024-01-10") == ["f1"] and known("2024-03-01") == []
    assert [r.chunk_id for r in facts.queue(chunks, old).collect()] == ["c9"]


def test_resolution(spark):
    known = spark.createDataFrame([("k1", "Marc", "person", 5), ("k2", "The Great Gatsby", "book", 3)], "concept_id string, label string, type string, occurrences long")
    refs = spark.createDataFrame([("Marc", "person"), ("marc!", "Person"), ("Marco", "person"), ("The Great Gatsbyy", "book"), ("other", "thing")], "label string, type string")
    got = {r.label: (r.concept_id, r.method) for r in resolve.canonicalise(refs, known).collect()}
    assert got["Marc"] == ("k1", "exact") and got["marc!"] == ("k1", "normalized") and got["The Great Gatsbyy"] == ("k2", "embedding") and got["other"][1] == "new" and got["Marco"][0] != "k1"
    strict = {r.label: r.method for r in resolve.canonicalise(refs, known, threshold=0.999).collect()}
    assert strict["The Great Gatsbyy"] == "new"
    aliases = spark.createDataFrame([("Gatsby", "k2")], "raw_label string, concept_id string")
    assert {r.name: r.concept_id for r in resolve.find_concept(spark.createDataFrame([("MARC",), ("gatsby",), ("none",)], "name string"), known, aliases).collect()} == {"MARC": "k1", "gatsby": "k2"}


def test_search(spark):
    docs = spark.createDataFrame([(1, "Élan vital"), (2, "elan elan"), (3, "autre chose"), (4, ""), (5, None)], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "ÉLAN"), (2, '"; DROP TABLE x'), (3, "")], "qid int, question string")
    got = [(r.qid, r.doc_id, r["rank"]) for r in search.bm25(search.index(docs), ask).orderBy("qid", "rank").collect()]
    assert got == [(1, 2, 1), (1, 1, 2)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    near = search.knn(vectors, spark.createDataFrame([(1, [1.0, 0.1])], "qid int, query array<float>"), 1).collect()
    assert [(r.vec_id, r["rank"]) for r in near] == [(1, 1)]
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "qid int, id string, rank int")
    fused = [(r.id, r.by_both, round(r.score, 6)) for r in search.rrf(a, b).orderBy("rank").collect()]
    assert fused == [("y", True, round(1 / 62 + 1 / 61, 6)), ("x", False, round(1 / 61, 6)), ("z", False, round(1 / 62, 6))]


def test_nearest_in_blocks_are_those_of_all_pairs(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(300, 8))
    v[7] = v[8] = v[9]
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    queries = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").cast("int").alias("qid"), F.col("embedding").alias("query"))
    for kind, values in (("l2", lambda q: np.round(np.sqrt(((v - v[q]) ** 2).sum(1)), 6)), ("dot", lambda q: -np.round(v @ v[q], 9))):
        for block in (7, 1000):
            got = {(r.qid, r["rank"]): r.vec_id for r in search.nearest(vectors, queries, 5, kind, block=block).collect()}
            assert got == {(q, k + 1): i for q in range(0, 300, 10) for k, i in enumerate(np.lexsort((np.arange(300), values(q)))[:5].tolist())}


def test_quotes_in_texts(spark):
    docs = spark.createDataFrame([(1, "🎉 abcabc xyz"), (2, "bc"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "abc"), (2, "bc"), (3, "abc"), (4, ""), (5, None), (6, "zz")], "item_id long, quote string")
    for block in (1, 100):
        assert sorted((r.doc_id, r.item_id, r.start) for r in quotes.quotes_in(docs, asked, block=block).collect()) == [(1, 1, 2), (1, 2, 3), (1, 3, 2), (2, 2, 0)]


def test_run_and_retrieval(spark):
    now = F.to_timestamp(F.lit("2024-03-01"))
    note = "---\ndate: 2024-01-02\n---\n# Reading\n\nZoé finished the translation.\n\nMarc was late."
    files = spark.createDataFrame([("notes/a.md", note), ("/notes/b.md/", "Nothing is claimed here."), ("c.md", "")], "relative_path string, text string")
    known = spark.createDataFrame([("k1", "Zoé", "person", 5)], "concept_id string, label string, type string, occurrences long")
    chunks = compose.segmented(compose.versioned(files, now))
    assert {(r.relative_path, r.text, str(r.event_time)[:10]) for r in chunks.collect()} == {("notes/a.md", note[note.index("Zoé"):], "2024-01-02"), ("notes/b.md", "Nothing is claimed here.", "2024-03-01")}
    claims = [{"subject": {"label": "zoe!", "type": "Person"}, "predicate": "finished", "object": {"label": "translation", "type": "work"}, "quote": "finished   the TRANSLATION"}, {"subject": {"label": "Marc", "type": "person"}, "predicate": "was", "object": {"label": "early", "type": "state"}, "quote": "Marc was early"}]
    answers = chunks.where("relative_path = 'notes/a.md'").select(compose.prompt_key(F.col("text")).alias("prompt_key"), F.lit(json.dumps({"facts": claims})).alias("response"))
    done = compose.run(files, answers, known, now)
    fact = done["facts"].collect()
    assert len(fact) == 1 and fact[0].subject_concept == "k1" and note[fact[0].char_start : fact[0].char_end] == fact[0].quote == "finished the translation"
    assert [r.reason for r in done["rejections"].collect()] == ["quote_not_found"] and done["versions"].count() == 3 and done["chunks"].count() == 2
    assert [(r.src, r.predicate) for r in done["edges"].collect()] == [("k1", "finished")] and {r.label for r in done["vertices"].collect()} == {"Zoé", "translation"}
    assert compose.run(files, answers, known, now, earlier=done["versions"])["versions"].count() == 0
    found = compose.retrieve(spark.createDataFrame([(1, "who finished the translation"), (2, "qqq")], "qid int, question string"), done["chunks"].withColumn("event_time", F.col("event_time").cast("string")).withColumnRenamed("relative_path", "source_path"), done["facts"])
    rows = {r.qid: r for r in found.collect()}
    assert rows[1].context.startswith("[1] (2024-01-02, notes/a.md)\nZoé finished") and rows[1].facts == "- zoe! --finished--> translation [1]" and not rows[1].semantic
    assert rows[2].context == "(no matching entries)" and rows[2].facts == "(none)" and rows[2].passages == []


def test_versions_of_a_stream_close_each_other(spark, tmp_path):
    schema = "v string, d int, at int"
    spark.createDataFrame([("a1", 1, 1), ("a3", 1, 3), ("b1", 2, 1)], schema).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("a2", 1, 2), ("a3", 1, 3)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    got = incremental.superseded_stream(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "v", "d", "at")
    assert {r.v: r.closed_by for r in got.collect()} == {"a1": "a2", "a2": "a3", "a3": None, "b1": None}


def test_graph(spark):
    nodes = graph.vertices(spark.createDataFrame([("a", "A", "t"), ("b", "B", "t"), ("a", "A", "t")], "id string, label string, type string"))
    found = graph.edges(spark.createDataFrame([("a", "b", "f1", "knows", 0.9), ("a", "b", "f1", "knows", 0.9), ("a", "zz", "f2", "knows", 0.9)], "src string, dst string, fact_id string, predicate string, confidence double"), nodes)
    assert nodes.count() == 2 and found.count() == 1
    assert [(r.seed, r.id) for r in graph.neighbours(found, nodes, spark.createDataFrame([("b",)], "seed string")).collect()] == [("b", "a")]


def test_vault(spark, tmp_path):
    for name, data in {"b.md": b"\xef\xbb\xbf# Hi", "sub/a.markdown": NOTE.encode(), "_draft.md": b"x", ".git/no.md": b"x", "c.txt": b"x", ".hidden/h.md": b"y"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {r.relative_path: r.text for r in vault.decoded(vault.scan_vault(spark, f"file://{tmp_path}")).collect()}
    assert found == {"b.md": "# Hi", "sub/a.markdown": NOTE, "_draft.md": "x", ".hidden/h.md": "y"}
    front = spark.createDataFrame([(NOTE,), ("no front",), ("---\n- a\n---\n",)], "t string").select(vault.front_matter("t").alias("m")).collect()
    assert [r.m for r in front] == [{"date": "2024-01-02", "title": "x"}, {}, {}]
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8"):
        vault.decoded(vault.scan_vault(spark, f"file://{tmp_path}")).collect()


def test_logs_and_fixtures(spark, tmp_path):
    (tmp_path / "log").mkdir()
    with gzip.open(tmp_path / "log/a.jsonl.gz", "wt") as f:
        f.write('{"prompt": "p"}\n\n{"prompt": "q"}\n')
    assert vault.run_log(spark, f"file://{tmp_path}/log").count() == 2
    vault.append_run_log(spark.createDataFrame([("r",)], "prompt string"), f"file://{tmp_path}/log2")
    assert vault.run_log(spark, f"file://{tmp_path}/log2").count() == 1
    (tmp_path / "x.json").write_text(json.dumps([{"subject": "a", "predicate": "", "object": "b", "note": ""}] * 2))
    assert vault.expectations(spark, f"file://{tmp_path}/x.json").count() == 2


def test_ingest_again_changes_nothing(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema).write.parquet(f"{tmp_path}/in")
    target = f"file://{tmp_path}/out"
    for k in range(2):
        incremental.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), target, "doc_id", f"file://{tmp_path}/state{k}")
    assert spark.read.parquet(target).count() == 2


def test_signals_are_found_in_one_look_at_a_run():
    """The patterns give what the plain ones give, and a text that is one long word costs no more than its length."""
    rng = random.Random(9)
    plain = {"EMAIL": r"[\w.+-]+@[\w-]+\.[\w.-]+", "HASHTAG": r"(?<![\w#])#([^\s#,.;:!?]{2,50})", "MENTION": r"(?<![\w@])@([\w.-]{2,50})", "ISO_DATE": r"\b(\d{4}-\d{2}-\d{2})\b", "CLOCK_TIME": r"\b([01]?\d|2[0-3])[h:]([0-5]\d)\b"}
    parts = ["a", "é", "+", "@", ".", "-", "#", " ", "_", "\n", "a@b.c", "a@b.c+d@e.f", "2024-05-11", "9h30", "23:59", "1", "²", "h", ":"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        for name, pattern in plain.items():
            assert [m.span() for m in re.finditer(getattr(T, name), text)] == [m.span() for m in re.finditer(pattern, text)], (name, text)
    began = time.process_time()
    for name in plain:
        assert re.findall(getattr(T, name), "a" * 100_000) == []
    assert time.process_time() - began < 2
