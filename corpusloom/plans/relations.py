"""How the driver's tables stand in for the library's relations; each function is one relation and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a document, each turn a version of it."""
    c = read(spark, d, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("version_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("ingested_at"), "text", F.sha2("text", 256).alias("content_hash"), "role")


VERSIONS = "versions AS (SELECT conv_id || ':' || turn AS version_id, conv_id AS document_id, turn AS ingested_at, text, sha256(text) AS content_hash, role FROM conversations)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select(F.concat(F.lit("c"), "version_id").alias("chunk_id"), "version_id", F.lit(0).alias("ordinal"), F.col("ingested_at").alias("event_time"), "text")


CHUNKS = VERSIONS + ", chunks AS (SELECT 'c' || version_id AS chunk_id, version_id, 0 AS ordinal, ingested_at AS event_time, text FROM versions)"


def facts(spark: SparkSession, d: str) -> DataFrame:
    """An event is a fact: its user did its type to its k, read from a turn's chunk; half are known a day late."""
    e = read(spark, d, "events")
    return e.select(
        F.col("event_id").alias("fact_id"),
        F.concat(F.lit("user "), F.col("user_id")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("item "), F.get_json_object("props", "$.k")).alias("object"),
        F.round(F.col("value") / (F.abs("value") + 1), 6).alias("confidence"),
        F.concat(F.lit("c"), F.col("event_id") % 97, F.lit(":"), F.col("user_id") % 6).alias("chunk_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("event_time"),
        F.date_format(F.date_add(F.to_date("ts"), (F.col("event_id") % 2).cast("int")), "yyyy-MM-dd").alias("knowledge_time"),
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("run"), F.col("event_id") % 7)).alias("superseded_by"),
        F.concat(F.lit("run"), F.col("event_id") % 7).alias("run_id"),
    )


FACTS = """facts AS (SELECT event_id AS fact_id, 'user ' || user_id AS subject, event_type AS predicate, 'item ' || (props::JSON->>'k') AS object,
 round(value / (abs(value) + 1), 6) AS confidence, 'c' || (event_id % 97) || ':' || (user_id % 6) AS chunk_id, strftime(ts, '%Y-%m-%d') AS event_time,
 strftime(ts::DATE + (event_id % 2)::INT, '%Y-%m-%d') AS knowledge_time, CASE WHEN event_id % 10 = 0 THEN 'run' || (event_id % 7) END AS superseded_by, 'run' || (event_id % 7) AS run_id FROM events)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A run starts on the day of its first event and a superseding one at the middle of its days."""
    return facts(spark, d).groupBy("run_id").agg(F.min("event_time").alias("first_day"), F.max("event_time").alias("started_at"), F.count("*").alias("n"))


RUNS = FACTS + ", runs AS (SELECT run_id, min(event_time) AS first_day, max(event_time) AS started_at, count(*) AS n FROM facts GROUP BY run_id)"


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """Brand and type of a part are its concepts."""
    p = read(spark, d, "part")
    names = p.select(F.col("p_name").alias("label"), F.col("p_brand").alias("type"))
    return names.groupBy("label", "type").agg(F.count("*").alias("occurrences")).withColumn("concept_id", F.substring(F.sha2(F.concat_ws("\0", F.lit("concept"), "type", "label"), 256), 1, 32))


CONCEPTS = "concepts AS (SELECT p_name AS label, p_brand AS type, count(*) AS occurrences, substring(sha256('concept' || chr(0) || p_brand || chr(0) || p_name), 1, 32) AS concept_id FROM part GROUP BY p_name, p_brand)"

#: Questions of the retrieval queries: words of the corpora's languages.
QUESTIONS = [(1, "the that with which from"), (2, "der die und nicht mit mit"), (3, "que los una del"), (4, "les des dans pour")]


def questions(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({q}, '{t}')" for q, t in QUESTIONS) + " AS t(qid, question)")


QUESTIONS_SQL = "questions(qid, question) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in QUESTIONS) + ")"
