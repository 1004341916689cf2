"""Asking a model in batches: each prompt once, answers kept, only what has none yet is asked.

Prompts are named by a digest of the model and the text, so equal prompts of different chunks are asked once and a second run finds the answers of the first.
Tasks ask in batches of bounded size; where a batch fails its prompts are asked one by one, a few times each, and a prompt that
still fails gives a row with its error and no answer, so it is asked again next time and no other prompt waits for it. Answers are committed before
anything is made of them, so a run that breaks off later doesn't ask again.

Defined results: a null prompt is never asked; an answer of None is an error.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import Generations

BATCH, TRIES = 32, 3
SHAPE = "prompt_key string, response string, model string, asked_by string"


class Provider(Protocol):
    """What answers prompts; it is sent to the tasks, so it can be pickled."""

    model: str

    def complete(self, prompts: list[str]) -> list[str]: ...


def prompt_key(prompt: Column, model: str = "") -> Column:
    """Under which an answer is recorded."""
    return T.digest(F.lit("prompt"), prompt) if not model else T.digest(F.lit("prompt"), F.lit(model), prompt)


class Answers:
    """The recorded answers under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, Generations(spark, root)

    def read(self) -> DataFrame:
        """prompt_key, response, model, asked_by of every answer."""
        return self.table.read("answers", SHAPE).drop("generation")

    def ask(self, prompts: DataFrame, provider: Provider, run_id: str = "", batch: int = BATCH, tries: int = TRIES, wait: float = 0.0) -> DataFrame:
        """Ask what has no answer yet of prompts (prompt) and record it; the failures (prompt_key, error) of this call."""
        model = provider.model
        new = prompts.where("prompt IS NOT NULL").select(prompt_key(F.col("prompt"), model).alias("prompt_key"), "prompt").dropDuplicates(["prompt_key"])
        new = new.join(self.read().select("prompt_key"), "prompt_key", "left_anti")
        generation = self.table.fresh()
        said = new.mapInArrow(lambda b: asked(b, provider, batch, tries, wait), "prompt_key string, response string, error string")
        path = self.table.path(generation, "said")
        said.write.parquet(path)  # a prompt is asked by this write alone
        said = self.spark.read.schema("prompt_key string, response string, error string").parquet(path)
        good = said.where("error IS NULL").select("prompt_key", "response", F.lit(model).alias("model"), F.lit(run_id).alias("asked_by"))
        good.write.parquet(self.table.path(generation, "answers"))
        if not good.isEmpty():
            self.table.commit(generation, {"model": model, "run": run_id})
        return said.where("error IS NOT NULL").select("prompt_key", "error")


def asked(batches: Iterator[pa.RecordBatch], provider: Provider, batch: int, tries: int, wait: float) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for start in range(0, len(part), batch):
            keys, prompts = (c.to_pylist() for c in part.slice(start, batch).columns)
            try:
                answers = [(a, None) for a in _complete(provider, prompts)]
            except Exception:  # noqa: BLE001  whatever went wrong, each prompt gets its own tries
                answers = [_one(provider, p, tries, wait) for p in prompts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (keys, [a for a, _ in answers], [e for _, e in answers])], ["prompt_key", "response", "error"])


def _complete(provider: Provider, prompts: list[str]) -> list[str]:
    found = provider.complete(prompts)
    if len(found) != len(prompts) or any(a is None for a in found):
        raise ValueError(f"{len(found)} answers to {len(prompts)} prompts, or an answer of None")
    return found


def _one(provider: Provider, prompt: str, tries: int, wait: float) -> tuple[str | None, str | None]:
    for k in range(tries):
        try:
            return _complete(provider, [prompt])[0], None
        except Exception as e:  # noqa: BLE001  it is the row's error
            error = f"{type(e).__name__}: {e}"[:2000]
            time.sleep(wait * 2**k)
    return None, error
