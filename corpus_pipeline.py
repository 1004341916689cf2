"""A training corpus from `documents`: good documents, no repeated lines, one of each near-copy group, mixed to weights, encoded.

Each stage reads all that the one before kept; run() writes each stage's rows to the shared folder and reads them again.

Defined results: a null text is the empty one, a null doc_id comes last where the first of equals stays, null languages and sources are labels of their own;
repeated rows are one document that is returned as often as it is there; an empty table gives no rows; other columns go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, line_dedup, mixing, near_text, quality
from corpusloom.llm.common import materialise, table

#: The mixing stage keeps most tokens: its budget is 0.8 of them, over at most two epochs of a source.
MIXTURE = mixing.Mixture(share=0.8, epochs=2)

#: The encoder's memories beside what workers still hold of the stages before: smaller than where it runs alone.
WORDS, STATES = 60_000, 80_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, doesn't reject."""
    found = materialise(quality.featured(docs), "quality-features")
    return quality.keep_good(docs, quality.train(found, table(spark, sf_dir, "labels")))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere before, exactly or within two edits."""
    return line_dedup.deduped_rows(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_text.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its share of tokens, once for each epoch that takes them."""
    return mixing.mixed_rows(docs, MIXTURE)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of every document."""
    return bpe.encode_documents(docs, *bpe.production(), with_ids=True, words=WORDS, states=STATES)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("SimHash near-dedup", distinct_texts),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: SQL can't express the classifier's fit or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
