"""Small rules against plain Python: responses, prompt blocks, templates, table functions."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.functions import text as T
from corpusloom.operators import extract, segment


def plain(response):
    """The reason, or the claims, by the rules of a strict schema."""
    try:
        value = json.loads(response or "")
    except ValueError:
        return "unparseable_response", None
    text = lambda x, most=200: isinstance(x, str) and 0 < len(x) <= most
    concept = lambda x: isinstance(x, dict) and not set(x) - {"label", "type"} and text(x.get("label")) and text(x.get("type"))

    def holds(f):
        sure = f.get("confidence", 0.7) if isinstance(f, dict) else None
        return isinstance(f, dict) and not set(f) - {"subject", "predicate", "object", "object_is_literal", "confidence", "quote"} and concept(f.get("subject")) and concept(f.get("object")) and text(f.get("predicate")) and text(f.get("quote"), 600) and isinstance(f.get("object_is_literal", False), bool) and not isinstance(sure, bool) and isinstance(sure, int | float) and 0 <= sure <= 1

    if not isinstance(value, dict) or set(value) - {"facts"} or not isinstance(value.get("facts", []), list) or not all(map(holds, value.get("facts", []))):
        return "schema_violation", None
    return None, [(f["subject"]["label"], f["subject"]["type"], f["predicate"], f["object"]["label"], f["object"]["type"], f["quote"], f.get("object_is_literal", False), float(f.get("confidence", 0.7))) for f in value.get("facts", [])]


GOOD = {"subject": {"label": "Zoé 🎉", "type": "person"}, "predicate": "reads", "object": {"label": "Emma", "type": "book"}, "quote": "q"}
CHANGES = [
    {}, {"confidence": 1}, {"confidence": 0}, {"confidence": 0.25}, {"confidence": 1e-9}, {"confidence": 1.5}, {"confidence": -0.1}, {"confidence": True}, {"confidence": "0.5"}, {"confidence": None}, {"confidence": [0.5]},
    {"object_is_literal": True}, {"object_is_literal": "true"}, {"object_is_literal": 1}, {"object_is_literal": None}, {"predicate": ""}, {"predicate": "p" * 200}, {"predicate": "p" * 201}, {"predicate": 7}, {"predicate": None},
    {"quote": "é" * 600}, {"quote": "é" * 601}, {"quote": ""}, {"quote": {"a": 1}}, {"subject": "Zoé"}, {"subject": {"label": "x"}}, {"subject": {"label": "x", "type": ""}}, {"subject": {"label": "x", "type": "t", "id": 1}}, {"subject": {"label": 5, "type": "t"}},
    {"object": []}, {"object": None}, {"extra": 1}, {"quote": " a \"b\" \\ \n"},
]


def test_responses_are_validated_in_the_jvm(spark):
    facts = [json.dumps({"facts": [GOOD | c]}, ensure_ascii=k % 2 == 0) for k, c in enumerate(CHANGES)]
    others = [None, "", "  ", "{", "null", "[]", "7", '"x"', "{}", '{"facts": []}', '{"facts": null}', '{"facts": {}}', '{"facts": [null]}', '{"facts": [[]]}', '{"facts": [], "more": 1}', "{no json", '{"facts": []} x', '{"facts": []}] x [', '{"facts": []}, {}', '{"facts": []}, "q": {}', '{"facts": []}} x {', json.dumps({"facts": [GOOD, GOOD | {"confidence": 3}]}), json.dumps({"facts": [GOOD, GOOD | {"predicate": "knows"}]})]
    others += [json.dumps({"facts": [{k: v for k, v in GOOD.items() if k != left}]}) for left in GOOD]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(facts + others)], "k int, r string").select("k", "r", extract.parsed(F.col("r")).alias("p"))
    for r in rows.collect():
        assert (r.p.reason, None if r.p.claims is None else [tuple(c) for c in r.p.claims]) == plain(r.r), r.r
    found = extract.extract(rows.select(F.col("k").alias("chunk_id"), F.lit("q").alias("text"), F.lit(0).alias("char_start"), F.col("r").alias("response")))
    assert all("Python" not in df._jdf.queryExecution().toString() for df in found)


def test_prompt_blocks(spark):
    texts = [("nothing here",), ("the a an of and #one #two #one see https://x.example/a and me@b.example at 9h30 on 2024-01-02",), ("",)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(T.format_signals(F.col("t"))).collect()]
    assert got[0] == got[2] == "language: und\n(no other signals detected)"
    assert got[1] == "language: en\nurls: https://x.example/a\nemails: me@b.example\nhashtags: one, two\ndates: 2024-01-02\ntimes: 9:30\npaths: //x.example/a"
    words = spark.createDataFrame([(["a", "b"], ["p"]), (["a"], []), ([], ["p", "q"]), ([], [])], "t array<string>, p array<string>")
    assert [r[0] for r in words.select(T.render_vocabulary(F.col("t"), F.col("p"), 1)).collect()] == ["types: a\npredicates: p", "types: a\npredicates: (none yet)", "types: (none yet)\npredicates: p", "(empty -- this is the first pass over this vault)"]


def test_templates(spark):
    df = spark.createDataFrame([("x$b", None)], "a string, b string")
    assert df.select(T.render_template("$a ${a}s $$ {$b}", a=F.col("a"), b=F.col("b"))).first()[0] == "x$b x$bs $ {}"
    assert df.select(T.render_template("no names")).first()[0] == "no names"
    with pytest.raises(KeyError, match="missing"):
        T.render_template("$a $missing", a=F.col("a"))
    with pytest.raises(ValueError, match="lone"):
        T.render_template("5 $ $a", a=F.col("a"))


def test_table_functions_in_sql(spark):
    tables.register(spark)
    note = "---\ntitle: x\n---\n# A\n\nFirst line.\nSecond.\n\n## B\n\n" + "A sentence that goes on. " * 80 + "\n\nlast"
    docs = spark.createDataFrame([(1, note), (2, None), (3, "")], "id int, text string")
    for function, plain_spans in (("split_blocks(text)", list(segment.blocks(note, segment.body_offset(note)))), ("chunk_text(text, 300, 100)", segment.chunk(note, 300, 100))):
        got = spark.sql(f"SELECT id, ordinal, start, `end`, part, path FROM {{docs}}, LATERAL {function} AS t(ordinal, start, `end`, part, path)", docs=docs)
        assert sorted(tuple(r) for r in got.collect()) == [(1, k, a, b, note[a:b], list(p)) for k, (a, b, p) in enumerate(plain_spans)]
    got = spark.sql("SELECT id, start, `end` FROM {docs}, LATERAL split_oversized(text, 500)", docs=docs)
    assert sorted(tuple(r) for r in got.collect()) == [(1, a, b) for a, b in segment.pieces(note, 0, len(note), 500)]


@pytest.mark.parametrize("partitions", ["3", "16"])
def test_ranks_of_a_hot_group(spark, partitions):
    from corpusloom.operators.ranks import ranked

    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [("hot", k * 7919 % 1000) for k in range(1000)] + [(None, 5), (None, 3), ("one", 1), ("two", None), ("two", 2)]
        got = sorted((str(r.g), -1 if r.v is None else r.v, r["rank"]) for r in ranked(spark.createDataFrame(rows, "g string, v int").repartition(4), ["g"], ["v"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = {}
    for g, v in rows:
        by.setdefault(str(g), []).append(-1 if v is None else v)
    assert got == sorted((g, v, k) for g, each in by.items() for k, v in enumerate(sorted(each), 1))


def test_user_dates_and_slugs(spark):
    now = F.to_timestamp(F.lit("2001-02-03"))
    day = lambda *texts: [str(r[0])[:10] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.parse_user_date(F.col("t"), now)).collect()]
    assert day("", None, "  ", "2024-05-06", " 2024-05-06 07:08 ") == ["2001-02-03"] * 3 + ["2024-05-06"] * 2
    with pytest.raises(Exception, match="not a date: tomorrow"):
        day("tomorrow")
    slugs = spark.createDataFrame([("Été ﬁn",), ("Žižek №5",), ("日本",), ("Crème brûlée!",)], "t string").select(T.slug(F.col("t")))
    assert [r[0] for r in slugs.collect()] == ["ete-fin", "zizek-no5", "", "creme-brulee"]


def test_accents_go_in_the_jvm(spark):
    """Each character, and sequences of them, as Python decomposes them; no worker is handed texts."""
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    texts = [chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")] + ["Été ﬁn", "각나 ＡＢ ½", "ạ́b", "plain", "", "x𝒳é"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.strip_accents_any(F.col("t")).alias("v"))
    assert [r.t for r in df.collect() if r.v != (None if r.t is None else plain(r.t))] == []
    assert "Python" not in df._jdf.queryExecution().toString()
