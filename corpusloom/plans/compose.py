"""The composed run: notes to versions, chunks, claims, concepts and a graph; and retrieval for a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, facts, graph, resolve, search, segment
from ..sources import vault


def versioned(files: DataFrame, now: Column) -> DataFrame:
    """document_id, version_id, relative_path, text, content_hash, event_time, ingested_at of files (relative_path, text; and the content_hash of their bytes, if it is there)."""
    path = T.normalise_path(F.col("relative_path"))
    of_bytes = F.col("content_hash") if "content_hash" in files.columns else F.sha2("text", 256)
    rows = files.withColumns({"relative_path": path, "content_hash": of_bytes, "front": vault.front_matter("text")})
    rows = rows.withColumn("document_id", T.digest(F.lit("document"), F.col("relative_path")))
    return rows.select("document_id", T.digest(F.lit("version"), F.col("document_id"), F.col("content_hash")).alias("version_id"), "relative_path", "text", "content_hash", T.event_time(F.col("front"), F.col("relative_path"), now).alias("event_time"), now.alias("ingested_at"))


def segmented(versions: DataFrame) -> DataFrame:
    """chunk_id, version_id, ordinal, char_start, char_end, text, heading_path, event_time, relative_path of each chunk of each version."""
    spans = versions.withColumnRenamed("text", "body").select("version_id", "event_time", "relative_path", F.posexplode(segment.chunks_of(F.col("body"))).alias("ordinal", "c"))
    key = T.digest(F.lit("chunk"), F.col("version_id"), F.col("c.start"), F.col("c.end"))
    return spans.select(key.alias("chunk_id"), "version_id", "ordinal", F.col("c.start").alias("char_start"), F.col("c.end").alias("char_end"), F.col("c.text").alias("text"), F.col("c.heading_path").alias("heading_path"), "event_time", "relative_path")


def prompt_key(text: Column) -> Column:
    """Under which a chunk's answer is recorded."""
    return T.digest(F.lit("prompt"), text)


def resolved(found: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims with subject_concept and object_concept, and the decisions (label, type, concept_id, method, score; stored) they rest on."""
    refs = found.select(F.explode(F.array(F.struct(F.col("subject").alias("label"), F.col("subject_type").alias("type")), F.struct(F.col("object").alias("label"), F.col("object_type").alias("type")))).alias("r")).select("r.*")
    decided = search.stored(resolve.canonicalise(refs, known), "run-aliases")
    named = lambda side: decided.select(F.col("label").alias(side), F.col("type").alias(f"{side}_type"), F.col("concept_id").alias(f"{side}_concept"))
    return found.join(named("subject"), ["subject", "subject_type"]).join(named("object"), ["object", "object_type"]), decided


def minted(decided: DataFrame) -> DataFrame:
    """concept_id, label, type of the new concepts among decisions."""
    return decided.where("method = 'new'").groupBy("concept_id").agg(F.min("label").alias("label"), F.min("type").alias("type"))


def run(files: DataFrame, answers: DataFrame, known: DataFrame, now: Column, earlier: DataFrame | None = None) -> dict[str, DataFrame]:
    """versions, chunks, facts, rejections, aliases, concepts, vertices, edges of a run over files.

    answers: prompt_key, response. known: concept_id, label, type, occurrences. earlier: the versions of earlier runs;
    files whose latest version has the same content give nothing anew.
    """
    versions = versioned(files, now)
    if earlier is not None:
        latest = facts.latest(earlier, ["document_id"], [F.desc("ingested_at"), F.desc("version_id")])
        versions = versions.join(latest.select("document_id", "version_id"), ["document_id", "version_id"], "left_anti")
    versions = search.stored(versions, "run-versions")
    chunks = search.stored(segmented(versions), "run-chunks")
    asked = chunks.withColumn("prompt_key", prompt_key(F.col("text"))).join(answers, "prompt_key")
    found, rejections = extract.extract(asked.select("chunk_id", "text", "char_start", "response"))
    found = search.stored(found, "run-claims")
    linked, decided = resolved(found, known)
    linked = linked.join(chunks.select("chunk_id", "event_time"), "chunk_id").withColumns({"knowledge_time": now, "superseded_by": F.lit(None).cast("string")})
    concepts = known.select("concept_id", "label", "type").unionByName(minted(decided))
    edges = linked.select(F.col("subject_concept").alias("src"), F.col("object_concept").alias("dst"), "fact_id", "predicate", "confidence")
    used = edges.select(F.explode(F.array("src", "dst")).alias("concept_id")).distinct()
    nodes = graph.vertices(concepts.join(used, "concept_id", "left_semi").withColumnRenamed("concept_id", "id"))
    return {"versions": versions, "chunks": chunks, "facts": linked, "rejections": rejections, "aliases": decided.where("method <> 'new'"), "concepts": concepts, "vertices": nodes, "edges": graph.edges(edges, nodes)}


def retrieve(questions: DataFrame, chunks: DataFrame, facts_: DataFrame, vectors: DataFrame | None = None, asked: DataFrame | None = None, limit: int = 8, fact_limit: int = 20) -> DataFrame:
    """qid, passages, context, facts, semantic of each question (qid, question).

    chunks: chunk_id, text, source_path, event_time. vectors (chunk_id, embedding) and asked (qid, query) may be absent: then
    passages are found by words alone. context and facts are the texts that a prompt takes.
    """
    lexical = search.bm25(search.index(chunks, "chunk_id"), questions, key="chunk_id").withColumnRenamed("chunk_id", "id")
    if vectors is not None and asked is not None:
        semantic = search.knn(vectors, asked.join(questions.select("qid"), "qid", "left_semi"), key="chunk_id").withColumnRenamed("chunk_id", "id")
    else:
        semantic = lexical.where("false")
    hits = search.stored(search.rrf(lexical, semantic, limit).select("qid", F.col("id").alias("chunk_id"), "score", "by_both", "rank"), "hits")
    passages = chunks.join(search.small(hits), "chunk_id")
    shown = F.concat(F.lit("["), "rank", F.lit("] ("), F.coalesce(F.substring("event_time", 1, 10), F.lit("")), F.lit(", "), "source_path", F.lit(")\n"), "text")
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "by_both", shown.alias("shown"))))
    context = passages.groupBy("qid").agg(listed.alias("p")).select("qid", F.transform("p", lambda x: x["chunk_id"]).alias("passages"), F.array_join(F.transform("p", lambda x: x["shown"]), "\n\n").alias("context"))
    line = F.concat(F.lit("- "), "subject", F.lit(" --"), "predicate", F.lit("--> "), "object", F.lit(" ["), "rank", F.lit("]"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "fact_id"))
    told = facts.current(facts_).join(search.small(hits.select("qid", "chunk_id", "rank")), "chunk_id").select("qid", "rank", "fact_id", line.alias("line")).withColumn("place", place).where(F.col("place") <= fact_limit)
    lines = told.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("facts"))
    out = questions.select("qid").join(context, "qid", "left").join(lines, "qid", "left")
    return out.select("qid", F.coalesce("passages", F.array().cast("array<string>")).alias("passages"), F.coalesce("context", F.lit("(no matching entries)")).alias("context"), F.coalesce("facts", F.lit("(none)")).alias("facts"), F.lit(vectors is not None and asked is not None).alias("semantic"))
