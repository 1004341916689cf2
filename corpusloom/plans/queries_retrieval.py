"""Retrieval, resolution and graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, lexical, quotes, resolve, search, vectors
from ..streaming import incremental
from . import relations as R
from .registry import query

_TERMS = f"""{R.QUESTIONS_SQL},
toks AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM documents),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(lower(strip_accents(question)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM questions) GROUP BY ALL),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM toks),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT qid, doc_id, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term), tot GROUP BY qid, doc_id),
lex AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 40)"""
#: The query vectors are those whose id is divisible by 100, the first of them for the first question and so on.
_KNN = """qv AS (SELECT CAST(vec_id // 100 + 1 AS INT) AS qid, embedding AS query FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT qid, vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, query), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))), 6) AS distance FROM embeddings, qv),
sem AS (SELECT qid, vec_id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM near QUALIFY rank <= 40)"""


def _index(spark, d):
    """The stored index of documents; it is built once for the same files."""
    return lexical.of_table(spark, f"{d}/documents.parquet", R.read(spark, d, "documents"))


def _lexical(spark, d):
    return lexical.search_table(spark, f"{d}/documents.parquet", R.read(spark, d, "documents"), R.questions(spark))


def _semantic(spark, d):
    v = R.read(spark, d, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.expr("CAST(vec_id DIV 100 + 1 AS INT)").alias("qid"), F.col("embedding").alias("query"))
    return vectors.of_table(spark, f"{d}/embeddings.parquet", v).nearest(queries).withColumnRenamed("value", "distance")


@query("top_bm25", f"WITH {_TERMS} SELECT qid, doc_id, score, rank, substr(trim(text), 1, 400) AS preview FROM lex JOIN documents USING (doc_id)")
def top_bm25(spark, d):
    hits = search.held(_lexical(spark, d), "bm25-hits")
    return R.read(spark, d, "documents").join(hits, "doc_id").select("qid", "doc_id", "score", "rank", F.substring(F.trim("text"), 1, 400).alias("preview"))


@query("join_knn", f"WITH {_KNN} SELECT * FROM sem")
def join_knn(spark, d):
    return _semantic(spark, d)


_RRF = """fused AS (SELECT coalesce(l.qid, s.qid) AS qid, coalesce(l.doc_id, s.vec_id) AS id, coalesce(l.rank, 0) AS lexical_rank, coalesce(s.rank, 0) AS semantic_rank,
  round(coalesce(1 / (60 + l.rank), 0) + coalesce(1 / (60 + s.rank), 0), 8) AS score, l.rank IS NOT NULL AND s.rank IS NOT NULL AS by_both
  FROM lex l FULL JOIN sem s ON l.qid = s.qid AND l.doc_id = s.vec_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 10)"""


def _hits(spark, d):
    return search.rrf(_lexical(spark, d).withColumnRenamed("doc_id", "id"), _semantic(spark, d).withColumnRenamed("vec_id", "id"))


@query("top_rrf", f"WITH {_TERMS}, {_KNN}, {_RRF} SELECT qid, id, score, lexical_rank, semantic_rank, by_both, rank FROM hits")
def top_rrf(spark, d):
    return _hits(spark, d)


query("join_rrf_full_outer", f"WITH {_TERMS}, {_KNN}, {_RRF} SELECT qid, id, lexical_rank, semantic_rank FROM fused")(
    lambda spark, d: search.rrf(_lexical(spark, d).withColumnRenamed("doc_id", "id"), _semantic(spark, d).withColumnRenamed("vec_id", "id"), limit=1 << 30).select("qid", "id", "lexical_rank", "semantic_rank")
)


@query("set_found_by_both", f"WITH {_TERMS}, {_KNN}, {_RRF} SELECT qid, id FROM fused WHERE by_both")
def found_by_both(spark, d):
    lexical_hits = search.held(_lexical(spark, d).select("qid", F.col("doc_id").alias("id")), "found-lexical")  # the few questions' hits are sent out, not those of all query vectors
    return _semantic(spark, d).select("qid", F.col("vec_id").alias("id")).join(lexical_hits, ["qid", "id"], "left_semi").distinct()


query("set_union_ranks", f"WITH {_TERMS}, {_KNN} SELECT qid, id, round(sum(1 / (60 + rank)), 8) AS score FROM (SELECT qid, doc_id AS id, rank FROM lex UNION ALL SELECT qid, vec_id, rank FROM sem) GROUP BY ALL")(
    lambda spark, d: _lexical(spark, d).select("qid", F.col("doc_id").alias("id"), "rank").unionByName(_semantic(spark, d).select("qid", F.col("vec_id").alias("id"), "rank")).groupBy("qid", "id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 8).alias("score"))
)
query("win_rank_list", f"WITH {_TERMS} SELECT qid, doc_id, rank FROM lex")(lambda spark, d: _lexical(spark, d).select("qid", "doc_id", "rank"))
query("sink_fts", "SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL")(
    lambda spark, d: _index(spark, d).postings()
)


@query(
    "join_passage_facts",
    f"""WITH {_TERMS}, {_KNN}, {_RRF}, {R.FACTS},
f AS (SELECT qid, h.rank AS passage, fact_id, '- ' || subject || ' --' || predicate || '--> ' || object || ' [' || h.rank || ']' AS line FROM hits h JOIN facts ON facts.fact_id % (SELECT count(*) FROM documents) = h.id AND superseded_by IS NULL WHERE h.rank <= 8)
SELECT qid, passage, fact_id, line FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY passage, fact_id) <= 20""",
)
def join_passage_facts(spark, d):
    f = R.facts(spark, d).where("superseded_by IS NULL").withColumn("id", F.col("fact_id") % R.read(spark, d, "documents").count())
    hits = _hits(spark, d).where("rank <= 8").select("qid", "id", F.col("rank").alias("passage"))
    line = F.concat(F.lit("- "), "subject", F.lit(" --"), "predicate", F.lit("--> "), "object", F.lit(" ["), "passage", F.lit("]"))
    rn = F.row_number().over(Window.partitionBy("qid").orderBy("passage", "fact_id"))
    return f.join(search.held(hits, "passages"), "id").withColumn("line", line).withColumn("rn", rn).where("rn <= 20").select("qid", "passage", "fact_id", "line")


query(
    "prj_render_passages",
    f"WITH {_TERMS} SELECT qid, string_agg('[' || rank || '] (' || source || ', ' || doc_id || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM lex JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY qid",
)(
    lambda spark, d: R.read(spark, d, "documents").join(search.held(_lexical(spark, d).where("rank <= 8"), "passages"), "doc_id")
    .groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "rank", F.lit("] ("), "source", F.lit(", "), "doc_id", F.lit(")\n"), F.col("text")).alias("p")))), lambda s: s["p"]), "\n\n").alias("context"))
)
@query(
    "join_quote_in_text",
    r"""WITH b AS (SELECT item_id, CASE item_id % 4 WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN upper(replace(text, 'ß', 'ss')) WHEN 3 THEN text || ' never said' ELSE ' ' || text END AS quote FROM benchmark),
q AS (SELECT item_id, trim(quote) AS q, regexp_replace(trim(quote), '\s+', ' ', 'g') AS s FROM b), d AS (SELECT doc_id, text, regexp_replace(text, '\s+', ' ', 'g') AS s FROM documents),
m AS (SELECT doc_id, item_id, CASE WHEN contains(d.text, q) THEN 'exact' WHEN contains(d.s, q.s) THEN 'space' ELSE 'case' END AS pass, strpos(d.text, q) - 1 AS start
  FROM d JOIN q ON contains(replace(lower(d.s), 'ß', 'ss'), replace(lower(q.s), 'ß', 'ss')))
SELECT doc_id, item_id, pass, CASE pass WHEN 'exact' THEN start ELSE -1 END AS start FROM m""",
)
def quote_in_text(spark, d):
    """Passages as they stand, with other white space, in capitals, or with more behind; where the last passes found one is tested against brute force."""
    k = F.col("item_id") % 4
    said = F.when(k == 1, F.replace("text", F.lit(" "), F.lit("  "))).when(k == 2, F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))).when(k == 3, F.concat("text", F.lit(" never said"))).otherwise(F.concat(F.lit(" "), "text"))
    met = quotes.quotes_in(R.read(spark, d, "documents"), R.read(spark, d, "benchmark").select("item_id", said.alias("quote")))
    return met.select("doc_id", "item_id", "pass", F.when(F.col("pass") == "exact", F.col("start")).otherwise(-1).alias("start"))


# resolution: refs are part names as written, in capitals, and with a letter lost
_REFS = "refs AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '(' || upper(p_name) || ')' WHEN 2 THEN substr(p_name, 2) ELSE 'zz' || p_partkey END AS label, p_brand AS type FROM part)"


def _refs(spark, d):
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("("), F.upper("p_name"), F.lit(")"))).when(k == 2, F.expr("substring(p_name, 2)")).otherwise(F.concat(F.lit("zz"), "p_partkey"))
    return R.read(spark, d, "part").select(label.alias("label"), F.col("p_brand").alias("type")).distinct()


_NORM = "trim(regexp_replace(lower(regexp_replace({0}, '^[\\s\"''`(\\[{{.,;:!?-]+|[\\s\"''`)\\]}}.,;:!?-]+$', '', 'g')), '\\s+', ' ', 'g'))"
_EXACT = "ex AS (SELECT r.label, r.type, min(concept_id) AS concept_id FROM refs r JOIN concepts c ON r.label = c.label AND r.type = c.type GROUP BY ALL)"
_NORMAL = f"""nk AS (SELECT {_NORM.format('label')} AS nl, {_NORM.format('type')} AS nt, max_by(concept_id, (occurrences, label, concept_id)) AS concept_id FROM concepts GROUP BY 1, 2),
rest AS (SELECT * FROM refs ANTI JOIN ex USING (label, type)),
nm AS (SELECT label, type, concept_id FROM rest JOIN nk ON {_NORM.format('label')} = nl AND {_NORM.format('type')} = nt)"""
query("join_exact_label", f"WITH {_REFS}, {R.CONCEPTS}, {_EXACT} SELECT * FROM ex")(lambda spark, d: resolve.canonicalise(_refs(spark, d), R.concepts(spark, d), embed=False).where("method = 'exact'").select("label", "type", "concept_id"))
query("join_normalised_label", f"WITH {_REFS}, {R.CONCEPTS}, {_EXACT}, {_NORMAL} SELECT * FROM nm")(lambda spark, d: resolve.canonicalise(_refs(spark, d), R.concepts(spark, d), embed=False).where("method = 'normalized'").select("label", "type", "concept_id"))
_SURFACE = """v_{0} AS (SELECT {1}, list_transform(range(0, 64), lambda b: coalesce(element_at(m, b)[1], 0) / norm) AS v FROM (
  SELECT {1}, map_from_entries(list((bucket, n))) AS m, sqrt(sum(n * n)) AS norm FROM (
    SELECT {1}, ('0x' || substr(sha256(substr(padded, i, 3)), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM (
      SELECT {1}, padded, unnest(range(1, length(padded) - 1)) AS i FROM (SELECT {1}, '  ' || lower(type || ': ' || label) || '  ' AS padded FROM {0})) GROUP BY ALL) GROUP BY {1}))"""


@query(
    "tvf_canonicalise",
    f"""WITH {_REFS}, {R.CONCEPTS}, {_EXACT}, {_NORMAL}, open_refs AS (SELECT * FROM rest ANTI JOIN nm USING (label, type)), {_SURFACE.format('open_refs', 'label, type')}, {_SURFACE.format('concepts', 'concept_id, label, type, occurrences')},
met AS (SELECT o.label, o.type, c.concept_id, round(list_dot_product(o.v, c.v), 9) AS s, c.occurrences, c.label AS theirs FROM v_open_refs o, v_concepts c),
best AS (SELECT label, type, concept_id, s FROM met WHERE s >= {resolve.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY label, type ORDER BY s DESC, occurrences DESC, theirs, concept_id) = 1)
SELECT label, type, concept_id, 'exact' AS method, 1.0::DOUBLE AS score FROM ex UNION ALL SELECT label, type, concept_id, 'normalized', 1.0 FROM nm UNION ALL SELECT label, type, concept_id, 'embedding', round(s, 4) FROM best
UNION ALL SELECT label, type, substring(sha256('concept' || chr(0) || {_NORM.format('type')} || chr(0) || {_NORM.format('label')}), 1, 32), 'new', 0.0 FROM open_refs ANTI JOIN best USING (label, type)""",
)
def tvf_canonicalise(spark, d):
    """All names against all concepts, without a pool."""
    return resolve.canonicalise(_refs(spark, d), R.concepts(spark, d), pool=None)


@query(
    "join_embedding_nn",
    f"""WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), m AS (SELECT q.vec_id, v.vec_id AS other, list_sum(list_transform(list_zip(embedding, e), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS s FROM embeddings v JOIN q ON v.vec_id <> q.vec_id)
SELECT vec_id, other, round(s, 4) AS score, round(s, 9) >= {resolve.THRESHOLD} AS accepted FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, other) = 1""",
)
def join_embedding_nn(spark, d):
    """The nearest other vector, among all, of each vector whose id is divisible by 100, and whether it is near enough to be the same concept."""
    v = R.read(spark, d, "embeddings")
    table = vectors.of_table(spark, f"{d}/embeddings.parquet", v)
    met = table.nearest(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 2, "dot").where("qid <> vec_id")
    first = F.row_number().over(Window.partitionBy("qid").orderBy("rank")) == 1
    return met.withColumn("first", first).where("first").select(F.col("qid").alias("vec_id"), F.col("vec_id").alias("other"), F.round("value", 4).alias("score"), (F.col("value") >= resolve.THRESHOLD).alias("accepted"))


query(
    "join_find_concept",
    "WITH names AS (SELECT DISTINCT upper(n_name) AS name FROM nation), every AS (SELECT lower(n_name) AS k, n_nationkey AS concept_id, 0 AS prio FROM nation UNION ALL SELECT lower(r_name), 100 + r_regionkey, 1 FROM region) SELECT name, arg_min(concept_id, (prio, concept_id)) AS concept_id FROM names JOIN every ON lower(name) = k GROUP BY name",
)(
    lambda spark, d: resolve.find_concept(
        R.read(spark, d, "nation").select(F.upper("n_name").alias("name")).distinct(),
        R.read(spark, d, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("concept_id")),
        R.read(spark, d, "region").select(F.col("r_name").alias("raw_label"), (F.col("r_regionkey") + 100).alias("concept_id")),
    )
)
@query(
    "set_union_all_lookup",
    "WITH every AS (SELECT n_name AS name, n_nationkey AS concept_id, 0 AS prio FROM nation UNION ALL SELECT r_name, 100 + r_regionkey, 1 FROM region UNION ALL SELECT lower(substr(n_name, 1, 3)), n_nationkey, 1 FROM nation) SELECT lower(name) AS name, count(*) AS found, arg_min(concept_id, (prio, concept_id)) AS concept_id FROM every GROUP BY lower(name)",
)
def union_all_lookup(spark, d):
    """Labels and aliases under one name: how many there are, and the one that is taken, labels before aliases."""
    n, r = R.read(spark, d, "nation"), R.read(spark, d, "region")
    labels = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("concept_id"), F.lit(0).alias("prio"))
    aliases = r.select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).alias("concept_id"), F.lit(1).alias("prio")).unionAll(n.select(F.lower(F.substring("n_name", 1, 3)), "n_nationkey", F.lit(1)))
    return labels.unionAll(aliases).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("found"), F.min_by("concept_id", F.struct("prio", "concept_id")).alias("concept_id"))





@query(
    "sink_vectors",
    "SELECT vec_id, round((CASE WHEN vec_id % 4 = 0 THEN -embedding[1] ELSE embedding[1] END)::DOUBLE, 6) AS first, len(embedding) AS dimensions, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END AS written FROM embeddings",
)
def sink_vectors(spark, d):
    """All vectors written, then every fourth again, turned around: what the table holds of each, and in which write it was."""
    v, table = R.read(spark, d, "embeddings"), vectors.VectorTable(spark, incremental.place(spark, "vectors"))
    table.write(v, "given")
    table.write(v.where("vec_id % 4 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), "given")
    second = table.table.read("keys", "key long", [table.table.committed()[-1].generation]).select(F.col("key").alias("vec_id"), F.lit(2).alias("written"))
    return table.vectors().join(second, "vec_id", "left").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("dimensions"), F.coalesce("written", F.lit(1)).alias("written"))


@query(
    "sink_vector_ddl",
    """SELECT min(len(embedding)) AS dimensions, 'given' AS model, count(*) AS n, 'this table holds ' || min(len(embedding)) || '-dimensional vectors of given, not ' || (min(len(embedding)) - 1) || '-dimensional ones of given' AS other_dimension,
 'this table holds ' || min(len(embedding)) || '-dimensional vectors of given, not ' || min(len(embedding)) || '-dimensional ones of another' AS other_model FROM embeddings""",
)
def sink_vector_ddl(spark, d):
    """What the stored metadata says, and the errors of writing vectors of another dimension or model."""
    v, told = R.read(spark, d, "embeddings"), []
    table = vectors.of_table(spark, f"{d}/embeddings.parquet", v)
    for rows, model in ((v.withColumn("embedding", F.slice("embedding", 2, F.size("embedding"))), "given"), (v, "another")):
        try:
            table.write(rows, model)
        except vectors.Mismatch as e:
            told.append(str(e).split(":")[0])
    meta = table.metadata()
    return table.vectors().agg(F.lit(meta["dimensions"]).cast("long").alias("dimensions"), F.lit(meta["model"]).alias("model"), F.count("*").alias("n"), *[F.lit(t).alias(c) for t, c in zip(told, ("other_dimension", "other_model"), strict=True)])


@query(
    "join_contains_eval",
    f"""WITH {R.FACTS}, e AS (SELECT event_id AS item_id, CASE event_id % 4 WHEN 3 THEN 'nobody' ELSE '"USER ' || user_id || '" ' END AS subject, CASE WHEN event_id % 3 = 0 THEN '' ELSE upper(event_type) END AS predicate,
  CASE WHEN event_id % 2 = 0 THEN '(Item)' ELSE 'item ' || (props::JSON->>'k') || '!' END AS object FROM events WHERE event_id % 100 = 0 OR event_id % 100 = 7),
w AS (SELECT item_id, {_NORM.format('subject')} AS s, {_NORM.format('predicate')} AS p, {_NORM.format('object')} AS o FROM e),
f AS (SELECT DISTINCT {_NORM.format('subject')} AS s, {_NORM.format('predicate')} AS p, {_NORM.format('object')} AS o FROM facts)
SELECT item_id FROM w WHERE EXISTS (SELECT 1 FROM f WHERE contains(f.s, w.s) AND contains(f.p, w.p) AND contains(f.o, w.o))""",
)
def contains_eval(spark, d):
    """Expected claims, written otherwise and with parts left open, that some fact meets; the expected ones are a stated set, the facts are all."""
    e = R.read(spark, d, "events").where("event_id % 100 IN (0, 7)")
    k, item = F.col("event_id"), F.get_json_object("props", "$.k")
    subject = F.when(k % 4 == 3, F.lit("nobody")).otherwise(F.concat(F.lit('"USER '), "user_id", F.lit('" ')))
    object_ = F.when(k % 2 == 0, F.lit("(Item)")).otherwise(F.concat(F.lit("item "), item, F.lit("!")))
    expected = e.select(k.alias("item_id"), subject.alias("subject"), F.when(k % 3 == 0, F.lit("")).otherwise(F.upper("event_type")).alias("predicate"), object_.alias("object"))
    return quotes.claims_met(expected, R.facts(spark, d))


# graph: users and items are vertices, current facts are edges
_GRAPH = f"""{R.FACTS}, e AS (SELECT subject AS src, object AS dst, fact_id, predicate, confidence FROM facts WHERE superseded_by IS NULL),
v AS (SELECT DISTINCT src AS id FROM e UNION SELECT DISTINCT dst FROM e), u AS (SELECT * FROM e UNION ALL SELECT dst, src, fact_id, predicate, confidence FROM e)"""


def _edges(spark, d):
    return R.facts(spark, d).where("superseded_by IS NULL").select(F.col("subject").alias("src"), F.col("object").alias("dst"), "fact_id", "predicate", "confidence")


def _vertices(spark, d):
    e = _edges(spark, d)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.vertices(ids.select("id", F.col("id").alias("label"), F.split("id", " ")[0].alias("type")))


query("sink_graph_nodes", f"WITH {_GRAPH} SELECT id, id AS label, split_part(id, ' ', 1) AS type FROM v")(_vertices)
query("sink_graph_edges", f"WITH {_GRAPH} SELECT src, dst, fact_id, predicate, confidence FROM e")(lambda spark, d: graph.edges(_edges(spark, d), _vertices(spark, d)).select("src", "dst", "fact_id", "predicate", "confidence"))
query("join_edge_endpoints", f"WITH {_GRAPH} SELECT src, dst, fact_id FROM e WHERE src <> 'user 1' AND dst <> 'item 2'")(
    lambda spark, d: graph.edges(_edges(spark, d), _vertices(spark, d).where("id NOT IN ('user 1', 'item 2')")).select("src", "dst", "fact_id")
)
query("agg_graph_counts", f"WITH {_GRAPH} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges")(
    lambda spark, d: _vertices(spark, d).agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(_edges(spark, d).agg(F.count("*").alias("edges"))))  # one row each
)
_HOP = f"WITH {_GRAPH} SELECT src AS seed, dst AS id, dst AS label, predicate, confidence, fact_id, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, fact_id, dst) AS rank FROM u WHERE src IN ('user 1', 'item 2', 'user 3') QUALIFY rank <= 50"


def _hop(spark, d):
    return graph.neighbours(_edges(spark, d), _vertices(spark, d), spark.createDataFrame([("user 1",), ("item 2",), ("user 3",)], "seed string"))


query("join_graph_one_hop", _HOP)(_hop)
query("top_neighbours", _HOP)(_hop)
query("set_undirected", f"WITH {_GRAPH} SELECT src, dst, fact_id FROM u")(lambda spark, d: graph.undirected(_edges(spark, d)).select("src", "dst", "fact_id"))
query("set_endpoints", f"WITH {_GRAPH} SELECT id FROM v")(lambda spark, d: _edges(spark, d).select(F.col("src").alias("id")).union(_edges(spark, d).select("dst")).distinct())
query("agg_projection_stats", f"WITH {_GRAPH} SELECT (SELECT count(*) FROM v) AS concepts, (SELECT count(DISTINCT (src, fact_id, dst)) FROM e) AS edges")(
    lambda spark, d: _edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id"), F.struct("src", "fact_id", "dst").alias("e")).agg(F.countDistinct("id").alias("concepts"), F.countDistinct("e").alias("edges"))
)
_PROJ = "SELECT l_orderkey, l_linenumber, c.n_name AS customer_nation, s.n_name AS supplier_nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey"


@query(
    "join_projection",
    f"""WITH {R.FACTS}, c AS (SELECT label, substring(sha256('concept' || chr(0) || label), 1, 32) AS id FROM (SELECT subject AS label FROM facts UNION SELECT object FROM facts))
SELECT fact_id, s.id AS src, s.label AS src_label, o.id AS dst, o.label AS dst_label, predicate, confidence, event_time, chunk_id FROM facts JOIN c s ON subject = s.label JOIN c o ON object = o.label WHERE superseded_by IS NULL""",
)
def fact_projection(spark, d):
    """Current facts with the concepts of both their ends."""
    f = R.facts(spark, d)
    c = f.select(F.explode(F.array("subject", "object")).alias("label")).distinct().withColumn("id", T.digest(F.lit("concept"), F.col("label")))
    c = search.stored(c, "projection-concepts")
    end = lambda side, name: c.select(F.col("label").alias(side), F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
    met = f.where("superseded_by IS NULL").join(end("subject", "src"), "subject").join(end("object", "dst"), "object")
    return met.select("fact_id", "src", "src_label", "dst", "dst_label", "predicate", "confidence", "event_time", "chunk_id")


@query("join_star", _PROJ)
def join_star(spark, d):
    n = R.read(spark, d, "nation").select("n_nationkey", "n_name")
    lines = R.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = R.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = R.read(spark, d, "customer").join(n, F.col("c_nationkey") == n.n_nationkey).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("customer_nation"))
    suppliers = R.read(spark, d, "supplier").join(n, F.col("s_nationkey") == n.n_nationkey).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("supplier_nation"))
    return lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey").select("l_orderkey", "l_linenumber", "customer_nation", "supplier_nation")


@query("qry_graph_k_hop", f"WITH RECURSIVE {_GRAPH}, r AS (SELECT 'user 1' AS id, 0 AS depth UNION SELECT u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.id WHERE r.depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def k_hop(spark, d, seed="user 1", hops=2):
    """Breadth first from a seed, a join a hop; who has been reached isn't expanded again."""
    both = graph.undirected(_edges(spark, d)).select("src", "dst").distinct()
    reached = spark.createDataFrame([(seed, 0)], "id string, depth int")
    front = reached
    for depth in range(1, hops + 1):
        front = both.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(reached.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        reached = reached.unionByName(front)
    return reached
