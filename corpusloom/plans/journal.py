"""The composed run as an increment: a journal of notes under a folder that goes on from what its tables hold.

ingest() takes what changed in the notes, process() asks about chunks that weren't processed yet and resolves the claims' concepts, embed() writes
the vectors that are missing, graph() is what the current facts say. Each writes one generation of rows and commits it as a whole, so a stage that
broke off has left nothing that counts, and running it again does what is left: work is found from the data, not from a state of its own.

Every stage that has something to do is a run in the ledger: started, then completed or failed with its error. Facts are never
changed: a version that replaces another one says so in `superseded`, and a fact's superseded_by is that run.

Defined results: notes whose bytes equal their latest version's give nothing; a note that goes back to an earlier text has that
version again, with its chunks, but facts that were superseded stay so; chunks of versions that were replaced before they were processed aren't pending; a note that is gone keeps its facts; rows that are there aren't added again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, facts, graph, provider, search
from ..operators.tables import Generations
from ..operators.vectors import VectorTable
from . import compose

VERSION = "document_id string, version_id string, relative_path string, content_hash string, event_time timestamp, ingested_at timestamp, run_id string"
CHUNK = "chunk_id string, version_id string, ordinal int, char_start int, char_end int, text string, heading_path array<string>, event_time timestamp, relative_path string"
FACT = """fact_id string, chunk_id string, subject string, subject_type string, predicate string, object string, object_type string, object_is_literal boolean, confidence double,
  char_start int, char_end int, quote string, event_time timestamp, knowledge_time timestamp, run_id string, subject_concept string, object_concept string"""
REJECTION = "run_id string, chunk_id string, reason string, detail string"
ALIAS = "label string, type string, concept_id string, method string, score double"
CONCEPT = "concept_id string, label string, type string"
REPLACED = "version_id string, run_id string, at timestamp"
LEDGER = "run_id string, stage string, at timestamp, seq long, status string, error string"


class Journal:
    def __init__(self, spark: SparkSession, root: str, model: str = "trigrams-64"):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.table = Generations(spark, f"{self.root}/journal")
        self.answers = provider.Answers(spark, f"{self.root}/answers")
        self.index = VectorTable(spark, f"{self.root}/vectors", "chunk_id", "string")

    # -- what the tables hold

    def read(self, part: str, shape: str) -> DataFrame:
        return self.table.read(part, shape, [r.generation for r in self.table.committed() if part in r.what["parts"].split(",")]).drop("generation")

    def versions(self) -> DataFrame:
        return self.read("versions", VERSION)

    def latest(self) -> DataFrame:
        return facts.latest(self.versions(), ["document_id"], [F.desc("ingested_at"), F.desc("version_id")])

    def chunks(self) -> DataFrame:
        return self.read("chunks", CHUNK)

    def facts(self) -> DataFrame:
        """All facts, with superseded_by (null: current): the first run that replaced their version since they were known."""
        replaced = self.read("superseded", REPLACED).groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("at", "run_id"))).alias("by"))  # an entry an edit of a note
        of = self.chunks().select("chunk_id", "version_id").join(replaced, "version_id")
        first = F.get(F.filter("by", lambda r: r["at"] >= F.col("knowledge_time")), F.lit(0))["run_id"]
        return self.read("facts", FACT).join(of, "chunk_id", "left").withColumn("superseded_by", first).drop("version_id", "by")

    def rejections(self) -> DataFrame:
        return self.read("rejections", REJECTION)

    def concepts(self) -> DataFrame:
        """concept_id, label, type, occurrences: counted from the facts."""
        seen = self.read("facts", FACT).select(F.explode(F.array("subject_concept", "object_concept")).alias("concept_id")).groupBy("concept_id").agg(F.count("*").alias("occurrences"))
        return self.read("concepts", CONCEPT).dropDuplicates(["concept_id"]).join(seen, "concept_id", "left").select("concept_id", "label", "type", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))

    def aliases(self) -> DataFrame:
        return self.read("aliases", ALIAS)

    def pending(self) -> DataFrame:
        """Chunks that no committed run has processed, but not those of versions that were replaced since."""
        done = self.read("processed", "chunk_id string")
        gone = self.read("superseded", REPLACED).join(self.latest().select("version_id"), "version_id", "left_anti")
        return self.chunks().join(done, "chunk_id", "left_anti").join(gone.select("version_id"), "version_id", "left_anti")

    def runs(self) -> DataFrame:
        """run_id, stage, started_at, finished_at, status, error."""
        path = f"{self.root}/ledger"
        rows = self.spark.read.schema(LEDGER).parquet(path) if self.table.exists(path) else self.spark.createDataFrame([], LEDGER)
        return facts.run_states(rows).join(rows.groupBy("run_id").agg(F.min("stage").alias("stage")), "run_id")

    # -- stages

    def ingest(self, files: DataFrame, now: Column, run_id: str | None = None) -> dict[str, int]:
        """Take the notes (relative_path, text, and content_hash of their bytes if it is there) that aren't as they were; numbers of new versions, chunks and superseded versions."""
        versions = compose.versioned(files, now)
        latest = self.latest()
        new = search.stored(versions.join(latest.select("document_id", "version_id"), ["document_id", "version_id"], "left_anti"), "journal-versions")
        if new.isEmpty():
            return {"versions": 0, "chunks": 0, "superseded": 0}

        def stage(run: str) -> dict[str, DataFrame]:
            chunks = compose.segmented(new).join(self.chunks().select("chunk_id"), "chunk_id", "left_anti")
            replaced = latest.join(new.select("document_id"), "document_id", "left_semi").select("version_id", F.lit(run).alias("run_id"), now.alias("at"))
            return {"versions": new.select("document_id", "version_id", "relative_path", "content_hash", "event_time", "ingested_at", F.lit(run).alias("run_id")), "chunks": chunks, "superseded": replaced}

        return self._run("ingest", now, run_id, stage, {"versions": VERSION, "chunks": CHUNK, "superseded": REPLACED})

    def process(self, model: provider.Provider, now: Column, run_id: str | None = None, limit: int | None = None) -> dict[str, int]:
        """Ask about the pending chunks (the first `limit`, oldest first) and keep the claims; numbers of facts, rejections, new concepts, aliases, processed chunks."""
        pending = self.pending()
        pending = search.stored(pending if limit is None else pending.orderBy("event_time", "version_id", "ordinal").limit(limit), "journal-pending")
        if pending.isEmpty():
            return dict.fromkeys(("facts", "rejections", "concepts", "aliases", "processed"), 0)

        def stage(run: str) -> dict[str, DataFrame]:
            self.answers.ask(pending.select(F.col("text").alias("prompt")), model, run)
            asked = pending.withColumn("prompt_key", provider.prompt_key(F.col("text"), model.model)).join(self.answers.read().select("prompt_key", "response"), "prompt_key")
            # dealt out by rows: what they cost are their responses and quotes, not their bytes
            asked = search.stored(asked.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "journal-asked")
            found, rejected = extract.extract(asked.select("chunk_id", "text", "char_start", "response"))
            found = search.stored(found.join(self.read("facts", FACT).select("fact_id", "chunk_id"), ["fact_id", "chunk_id"], "left_anti"), "journal-claims")
            linked, decided = compose.resolved(found, self.concepts())
            linked = linked.join(asked.select("chunk_id", "event_time"), "chunk_id").withColumns({"knowledge_time": now, "run_id": F.lit(run)})
            minted = compose.minted(decided).join(self.read("concepts", CONCEPT).select("concept_id"), "concept_id", "left_anti")
            return {"facts": linked, "rejections": rejected.withColumn("run_id", F.lit(run)), "concepts": minted, "aliases": decided.where("method <> 'new'"), "processed": asked.select("chunk_id")}

        return self._run("process", now, run_id, stage, {"facts": FACT, "rejections": REJECTION, "concepts": CONCEPT, "aliases": ALIAS, "processed": "chunk_id string"})

    def embed(self) -> int:
        """Write the vectors of chunks that have none; how many."""
        todo = self.chunks().select("chunk_id", "text")
        if self.index.metadata():
            todo = todo.join(self.index.vectors().select("chunk_id"), "chunk_id", "left_anti")
        return self.index.write(todo.select("chunk_id", T.trigram_embedding(F.col("text")).alias("embedding")), self.model)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Vertices and edges of the current facts."""
        edges = facts.current(self.facts()).select(F.col("subject_concept").alias("src"), F.col("object_concept").alias("dst"), "fact_id", "predicate", "confidence")
        used = edges.select(F.explode(F.array("src", "dst")).alias("concept_id")).distinct()
        nodes = graph.vertices(self.concepts().join(used, "concept_id", "left_semi").withColumnRenamed("concept_id", "id"))
        return nodes, graph.edges(edges, nodes)

    def retrieve(self, questions: DataFrame, asked: DataFrame | None = None, **limits: int) -> DataFrame:
        """compose.retrieve() over the chunks and facts; asked: qid, query vectors."""
        chunks = self.chunks().withColumn("event_time", F.col("event_time").cast("string")).withColumnRenamed("relative_path", "source_path")
        return compose.retrieve(questions, chunks, self.facts(), self.index.vectors() if asked is not None else None, asked, **limits)

    def _run(self, name: str, now: Column, run_id: str | None, stage, shapes: dict[str, str]) -> dict[str, int]:
        run = run_id or uuid.uuid4().hex
        self._note(run, name, now, 0, "running")
        try:
            generation, numbers = self.table.fresh(), {}
            for part, rows in stage(run).items():
                path = self.table.path(generation, part)
                rows.select(*[c.split()[0] for c in _fields(shapes[part])]).write.parquet(path)
                numbers[part] = self.spark.read.schema(shapes[part]).parquet(path).count()
            self.table.commit(generation, {"run": run, "stage": name, "parts": ",".join(shapes)})
        except BaseException as e:
            self._note(run, name, now, 1, "failed", f"{type(e).__name__}: {e}"[:2000])
            raise
        self._note(run, name, now, 1, "completed")
        return numbers

    def _note(self, run: str, stage: str, now: Column, seq: int, status: str, error: str | None = None) -> None:
        row = self.spark.range(1).select(F.lit(run).alias("run_id"), F.lit(stage).alias("stage"), now.alias("at"), F.lit(seq).cast("long").alias("seq"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")


def _fields(shape: str) -> list[str]:
    """The fields of a schema string without commas inside types."""
    return [f.strip() for f in shape.split(",")]
