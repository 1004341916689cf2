"""Fact-log, window, aggregate and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import facts as L
from ..operators.ranks import ranked
from . import relations as R
from .registry import query

V, C, FA, RU = f"WITH {R.VERSIONS}", f"WITH {R.CHUNKS}", f"WITH {R.FACTS}", f"WITH {R.RUNS}"
CF = f"WITH {R.CHUNKS}, {R.FACTS}"
_LATEST = "latest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC, version_id DESC) = 1)"


def _latest(spark, d):
    return L.latest(R.versions(spark, d), ["document_id"], [F.desc("ingested_at"), F.desc("version_id")])


def _current(spark, d):
    return L.current(R.facts(spark, d))


# writes
query("dml_insert_ignore", f"{FA} SELECT DISTINCT subject, predicate FROM facts WHERE fact_id % 2 = 1 AND (subject, predicate) NOT IN (SELECT (subject, predicate) FROM facts WHERE fact_id % 20 = 0)")(
    lambda s, d: L.insert_ignore(R.facts(s, d).where("fact_id % 20 = 0"), R.facts(s, d).where("fact_id % 2 = 1"), ["subject", "predicate"]).select("subject", "predicate")
)
query("dml_upsert_replace", f"{FA} SELECT subject, predicate, object, fact_id FROM facts QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY fact_id DESC) = 1")(
    lambda s, d: L.upsert_last(R.facts(s, d).select("subject", "predicate", "object", "fact_id"), ["subject", "predicate"], "fact_id")
)
query("dml_upsert_accumulate", f"{FA} SELECT object, count(*) AS n, arg_min(predicate, fact_id) AS predicate FROM facts GROUP BY object")(
    lambda s, d: L.upsert_sum(R.facts(s, d).withColumn("n", F.lit(1)), "object", "n", "fact_id", ["predicate"])
)
_SUP = """rep AS (SELECT version_id, 'run9' AS run_id FROM versions ANTI JOIN latest USING (version_id)),
done AS (SELECT f.*, r.run_id AS by_run FROM facts f LEFT JOIN chunks c USING (chunk_id) LEFT JOIN rep r ON c.version_id = r.version_id)"""


def _superseded(s, d):
    old = R.versions(s, d).join(_latest(s, d).select("version_id"), "version_id", "left_anti").select("version_id", F.lit("run9").alias("run_id"))
    return L.supersede(R.facts(s, d), R.chunks(s, d), old)


query("dml_supersede", f"{CF}, {_LATEST}, {_SUP} SELECT fact_id, coalesce(superseded_by, by_run) AS superseded_by FROM done")(lambda s, d: _superseded(s, d).select("fact_id", "superseded_by"))
query("join_supersede_semi", f"{CF}, {_LATEST} SELECT fact_id FROM facts WHERE chunk_id IN (SELECT chunk_id FROM chunks JOIN latest USING (version_id))")(
    lambda s, d: R.facts(s, d).join(R.chunks(s, d).join(_latest(s, d).select("version_id"), "version_id", "left_semi"), "chunk_id", "left_semi").select("fact_id")
)
query("dml_set_concepts", f"WITH {R.FACTS}, c AS (SELECT DISTINCT subject AS label, sha256(subject) AS id FROM facts WHERE fact_id % 3 = 0 UNION SELECT DISTINCT object, sha256(object) FROM facts WHERE fact_id % 3 = 0) SELECT fact_id, a.id AS subject_concept, b.id AS object_concept FROM facts LEFT JOIN c a ON subject = a.label LEFT JOIN c b ON object = b.label")(
    lambda s, d: (lambda f, c: f.join(c.toDF("subject", "subject_concept"), "subject", "left").join(c.toDF("object", "object_concept"), "object", "left").select("fact_id", "subject_concept", "object_concept"))(
        R.facts(s, d), R.facts(s, d).where("fact_id % 3 = 0").select(F.explode(F.array("subject", "object")).alias("label")).distinct().select("label", F.sha2("label", 256))
    )
)


@query("dml_run_lifecycle", f"{FA}, ev AS (SELECT run_id, event_time AS moment, fact_id AS seq, CASE WHEN fact_id % 3 = 0 THEN 'running' WHEN fact_id % 5 = 0 THEN 'failed' ELSE 'done' END AS status, 'e' || fact_id AS error FROM facts) SELECT run_id, min(moment) AS started_at, max(CASE WHEN status <> 'running' THEN moment END) AS finished_at, arg_max(status, seq) AS status, arg_max(error, seq) AS error FROM ev GROUP BY run_id")
def run_lifecycle(s, d):
    i = F.col("fact_id")
    status = F.when(i % 3 == 0, "running").when(i % 5 == 0, "failed").otherwise("done")
    return L.run_states(R.facts(s, d).select("run_id", F.col("event_time").alias("at"), i.alias("seq"), status.alias("status"), F.concat(F.lit("e"), i).alias("error")))


_REASON = "CASE WHEN confidence < 0.2 THEN 'low_confidence' WHEN object = 'item 0' THEN 'quote_not_found' WHEN length(subject) > 8 THEN 'schema_violation' END"


def _judged(s, d):
    return R.facts(s, d).withColumn("reason", F.expr(_REASON))


query("dml_rejections", f"{FA} SELECT run_id, chunk_id, {_REASON} AS reason, 'fact ' || fact_id AS detail FROM facts WHERE {_REASON} IS NOT NULL")(
    lambda s, d: _judged(s, d).where("reason IS NOT NULL").select("run_id", "chunk_id", "reason", F.concat(F.lit("fact "), "fact_id").alias("detail"))
)
query("sink_eval_report", "SELECT source, '{\"found\":' || count(*) FILTER (quality = 1) || ',\"of\":' || count(*) || '}' AS report FROM labels JOIN documents USING (doc_id) GROUP BY source")(
    lambda s, d: R.read(s, d, "labels").join(R.read(s, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.to_json(F.struct(F.count(F.when(F.col("quality") == 1, 1)).alias("found"), F.count("*").alias("of"))).alias("report"))
)

# filters and projections
query("flt_current_facts", f"{FA} SELECT fact_id, subject, predicate, object FROM facts WHERE superseded_by IS NULL")(lambda s, d: _current(s, d).select("fact_id", "subject", "predicate", "object"))
query("flt_by_key", f"{FA} SELECT fact_id FROM facts WHERE run_id = 'run3' AND chunk_id = 'c5:2'")(lambda s, d: R.facts(s, d).where("run_id = 'run3' AND chunk_id = 'c5:2'").select("fact_id"))
query("flt_in_list", f"{C} SELECT chunk_id, text FROM chunks WHERE chunk_id IN ('c1:0', 'c2:1', 'c77:3')")(lambda s, d: R.chunks(s, d).where(F.col("chunk_id").isin("c1:0", "c2:1", "c77:3")).select("chunk_id", "text"))
query("flt_unchanged_version", f"{V}, {_LATEST}, n AS (SELECT document_id, CASE WHEN document_id % 2 = 0 THEN version_id ELSE version_id || 'x' END AS version_id FROM latest) SELECT document_id, version_id FROM n WHERE (document_id, version_id) NOT IN (SELECT (document_id, version_id) FROM latest)")(
    lambda s, d: _latest(s, d).select("document_id", F.when(F.col("document_id") % 2 == 0, F.col("version_id")).otherwise(F.concat("version_id", F.lit("x"))).alias("version_id")).join(_latest(s, d).select("document_id", "version_id"), ["document_id", "version_id"], "left_anti")
)
query("flt_status_derived", f"{FA} SELECT count(*) AS facts, count(*) FILTER (superseded_by IS NULL) AS current, count(superseded_by) AS superseded FROM facts")(
    lambda s, d: R.facts(s, d).agg(F.count("*").alias("facts"), F.count(F.when(F.col("superseded_by").isNull(), 1)).alias("current"), F.count("superseded_by").alias("superseded"))
)
query("src_table_scan", f"{C} SELECT chunk_id, ordinal, text FROM chunks WHERE version_id = '3:1'")(lambda s, d: R.chunks(s, d).where("version_id = '3:1'").orderBy("ordinal").select("chunk_id", "ordinal", "text"))
query("src_git_asof", f"{V} SELECT document_id, version_id, text FROM versions WHERE ingested_at <= 2 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC, version_id DESC) = 1")(
    lambda s, d: L.latest(R.versions(s, d).where("ingested_at <= 2"), ["document_id"], [F.desc("ingested_at"), F.desc("version_id")]).select("document_id", "version_id", "text")
)
query("prj_fact_line", f"{FA} SELECT fact_id, '- ' || subject || ' --' || predicate || '--> ' || object AS line FROM facts")(lambda s, d: R.facts(s, d).select("fact_id", F.format_string("- %s --%s--> %s", "subject", "predicate", "object").alias("line")))
query("prj_event_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")(lambda s, d: R.read(s, d, "events").select("event_id", F.coalesce(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), F.col("ts").cast("string")).alias("day")))

# joins
query("join_pending_chunks", f"{CF} SELECT chunk_id, event_time FROM chunks ANTI JOIN facts USING (chunk_id)")(lambda s, d: L.queue(R.chunks(s, d), R.facts(s, d)).orderBy("event_time", "version_id", "ordinal").select("chunk_id", "event_time"))
query("lim_process", f"{CF} SELECT chunk_id FROM chunks ANTI JOIN facts USING (chunk_id) ORDER BY event_time, version_id, ordinal LIMIT 10")(lambda s, d: L.queue(R.chunks(s, d), R.facts(s, d)).orderBy("event_time", "version_id", "ordinal").limit(10).select("chunk_id"))
query("set_except_queue", f"{CF} SELECT chunk_id FROM chunks EXCEPT SELECT chunk_id FROM facts")(lambda s, d: R.chunks(s, d).select("chunk_id").subtract(R.facts(s, d).select("chunk_id")))
query("join_unindexed_vectors", "SELECT doc_id FROM documents ANTI JOIN embeddings ON doc_id = vec_id")(lambda s, d: R.read(s, d, "documents").select("doc_id").join(R.read(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti"))
query("join_text_back", "SELECT vec_id, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id")(
    lambda s, d: R.read(s, d, "embeddings").select("vec_id").join(R.read(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left").select("vec_id", F.coalesce("text", F.lit("")).alias("text"))
)
query("join_chunk_sources", f"{C} SELECT chunk_id, 'conversations/' || document_id || '.md' AS path, c.event_time FROM chunks c JOIN versions USING (version_id)")(
    lambda s, d: R.chunks(s, d).select("chunk_id", "version_id", "event_time").join(R.versions(s, d).select("version_id", "document_id"), "version_id").select("chunk_id", F.concat(F.lit("conversations/"), "document_id", F.lit(".md")).alias("path"), "event_time")
)
query("join_prev_version", f"{V} SELECT a.version_id, b.version_id AS previous FROM versions a LEFT JOIN versions b ON a.document_id = b.document_id AND b.ingested_at = a.ingested_at - 1")(
    lambda s, d: R.versions(s, d).select("version_id", "document_id", "ingested_at").join(R.versions(s, d).select("document_id", (F.col("ingested_at") + 1).alias("ingested_at"), F.col("version_id").alias("previous")), ["document_id", "ingested_at"], "left").select("version_id", "previous")
)
query("asof_facts", f"{RU} SELECT fact_id FROM facts f LEFT JOIN runs r ON f.superseded_by = r.run_id, (SELECT max(first_day) AS m FROM runs) WHERE knowledge_time <= m AND (started_at IS NULL OR started_at > m)")(
    lambda s, d: (lambda m: L.as_of(R.facts(s, d).crossJoin(F.broadcast(m)), R.runs(s, d), F.col("m")))(R.runs(s, d).agg(F.max("first_day").alias("m"))).select("fact_id")  # m is one row
)

# aggregates
query("agg_counts", f"WITH {R.CHUNKS}, {R.FACTS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM embeddings) AS vectors")(
    lambda s, d: R.read(s, d, "documents").agg(F.count("*").alias("documents")).crossJoin(R.chunks(s, d).agg(F.count("*").alias("chunks"))).crossJoin(R.facts(s, d).agg(F.count("*").alias("facts"))).crossJoin(R.read(s, d, "embeddings").agg(F.count("*").alias("vectors")))  # one row each
)
query("agg_rejection_counts", f"{FA} SELECT run_id, {_REASON} AS reason, count(*) AS n FROM facts WHERE {_REASON} IS NOT NULL GROUP BY ALL")(lambda s, d: _judged(s, d).where("reason IS NOT NULL").groupBy("run_id", "reason").agg(F.count("*").alias("n")))
query("agg_rejection_rate", f"{FA} SELECT run_id, round(count({_REASON}) / count(*), 6) AS rate FROM facts GROUP BY run_id")(lambda s, d: _judged(s, d).groupBy("run_id").agg(F.round(F.coalesce(F.try_divide(F.count("reason"), F.count("*")), F.lit(0.0)), 6).alias("rate")))
query("agg_vocab_predicates", f"{FA} SELECT predicate AS term, count(*) AS n FROM facts WHERE superseded_by IS NULL GROUP BY 1 ORDER BY n DESC, term LIMIT 60")(lambda s, d: L.vocabulary(R.facts(s, d), "predicate"))
query("agg_vocab_types", f"WITH {R.CONCEPTS} SELECT type AS term, sum(occurrences)::BIGINT AS n FROM concepts GROUP BY type ORDER BY n DESC, term LIMIT 60")(
    lambda s, d: R.concepts(s, d).groupBy(F.col("type").alias("term")).agg(F.sum("occurrences").alias("n")).orderBy(F.desc("n"), "term").limit(60)
)
query("top_vocab", f"{FA} SELECT object AS term, count(*) AS n FROM facts WHERE superseded_by IS NULL GROUP BY 1 ORDER BY n DESC, term LIMIT 60")(lambda s, d: L.vocabulary(R.facts(s, d), "object"))
query("agg_concept_occurrences", f"{FA} SELECT id, count(*) AS n FROM (SELECT subject AS id FROM facts UNION ALL SELECT object FROM facts) GROUP BY id")(lambda s, d: R.facts(s, d).select(F.explode(F.array("subject", "object")).alias("id")).groupBy("id").agg(F.count("*").alias("n")))
query("tvf_explode_refs", f"{FA} SELECT fact_id, 0 AS place, subject AS label FROM facts UNION ALL SELECT fact_id, 1, object FROM facts")(lambda s, d: R.facts(s, d).select("fact_id", F.posexplode(F.array("subject", "object")).alias("place", "label")))
query("agg_dedupe_facts", f"{FA} SELECT fact_id FROM facts QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY fact_id) = 1")(lambda s, d: R.facts(s, d).groupBy("subject", "predicate", "object").agg(F.min("fact_id").alias("fact_id")).select("fact_id"))
query("agg_ingest_stats", f"{V} SELECT count(*) AS seen, count(DISTINCT document_id) AS documents, count(DISTINCT content_hash) AS contents, count(*) FILTER (ingested_at > 0) AS newer FROM versions")(
    lambda s, d: R.versions(s, d).agg(F.count("*").alias("seen"), F.countDistinct("document_id").alias("documents"), F.countDistinct("content_hash").alias("contents"), F.count(F.when(F.col("ingested_at") > 0, 1)).alias("newer"))
)
query("agg_process_stats", f"{FA} SELECT run_id, count(*) AS n, count({_REASON}) AS rejected, count(*) FILTER ({_REASON} = 'low_confidence') AS low_confidence FROM facts GROUP BY run_id")(
    lambda s, d: _judged(s, d).groupBy("run_id").agg(F.count("*").alias("n"), F.count("reason").alias("rejected"), F.count(F.when(F.col("reason") == "low_confidence", 1)).alias("low_confidence"))
)
query("agg_recall_micro", "SELECT source, count(*) FILTER (quality = 1) AS found, count(*) AS expected, round(count(*) FILTER (quality = 1) / count(*), 6) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)")(
    lambda s, d: R.read(s, d, "labels").join(R.read(s, d, "documents").select("doc_id", "source"), "doc_id").rollup("source").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("found"), F.count("*").alias("expected")).withColumn("recall", F.round(F.coalesce(F.try_divide("found", "expected"), F.lit(1.0)), 6))
)

# windows
query("win_latest_version", f"{V}, {_LATEST} SELECT document_id, version_id, content_hash FROM latest")(lambda s, d: _latest(s, d).select("document_id", "version_id", "content_hash"))
query("win_version_diff", f"{V} SELECT version_id, lag(version_id) OVER w AS previous, content_hash IS DISTINCT FROM lag(content_hash) OVER w AS changed FROM versions WINDOW w AS (PARTITION BY document_id ORDER BY ingested_at, version_id)")(
    lambda s, d: (lambda w: R.versions(s, d).select("version_id", F.lag("version_id").over(w).alias("previous"), (~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(w))).alias("changed")))(Window.partitionBy("document_id").orderBy("ingested_at", "version_id"))
)
query("win_chunk_ordinal", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations")(
    lambda s, d: R.read(s, d, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("ordinal"))
)
query("win_passage_index", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS idx FROM documents")(
    lambda s, d: ranked(R.read(s, d, "documents").select("doc_id", "source", (-F.col("n_chars")).alias("longest")), ["source"], ["longest", "doc_id"], "idx").select("doc_id", "idx")
)
query("win_argmax", f"{FA} SELECT subject, fact_id, confidence FROM facts QUALIFY row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, fact_id) = 1")(
    lambda s, d: R.facts(s, d).groupBy("subject").agg(F.min_by(F.struct("fact_id", "confidence"), F.struct(-F.col("confidence"), "fact_id")).alias("b")).select("subject", "b.*")
)

# sorts and limits
query("top_recent_runs", f"{RU} SELECT run_id, started_at, n FROM runs ORDER BY started_at DESC, run_id LIMIT 5")(lambda s, d: R.runs(s, d).orderBy(F.desc("started_at"), "run_id").limit(5).select("run_id", "started_at", "n"))
query("top_known_concepts", f"WITH {R.CONCEPTS} SELECT concept_id, label, occurrences FROM concepts ORDER BY occurrences DESC, label, concept_id LIMIT 2000")(lambda s, d: R.concepts(s, d).orderBy(F.desc("occurrences"), "label", "concept_id").limit(2000).select("concept_id", "label", "occurrences"))
query("lim_facts_cap", f"{FA} SELECT fact_id FROM facts WHERE superseded_by IS NULL ORDER BY chunk_id, fact_id LIMIT 20")(lambda s, d: _current(s, d).orderBy("chunk_id", "fact_id").limit(20).select("fact_id"))
query("sort_paths", "SELECT source || '/' || doc_id AS path FROM documents ORDER BY source, CAST(doc_id AS VARCHAR)")(
    lambda s, d: R.read(s, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path")).orderBy(F.split("path", "/"))
)
query("sort_reasons", f"{FA} SELECT {_REASON} AS reason, count(*) AS n FROM facts WHERE {_REASON} IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason")(lambda s, d: _judged(s, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason"))
query("agg_events_by_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(
    lambda s, d: R.read(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
)
