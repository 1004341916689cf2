"""Table functions for SQL: register(spark), then `SELECT ... FROM docs, LATERAL split_blocks(text)`.

They give the spans of operators.segment, a row a span: places are code points of the whole text. A null text is the empty one and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import segment

_SPAN = "ordinal int, start int, end int"


@F.udtf(returnType=f"{_SPAN}, text string, heading_path array<string>", useArrow=True)
class SplitBlocks:
    """split_blocks(text): runs of lines under their headings, behind the front matter."""

    def eval(self, text: str):
        text = text or ""
        for k, (a, b, path) in enumerate(segment.blocks(text, segment.body_offset(text))):
            yield k, a, b, text[a:b], list(path)


@F.udtf(returnType=f"{_SPAN}, text string, heading_path array<string>", useArrow=True)
class ChunkText:
    """chunk_text(text, target, overlap): blocks packed up to the target; the next chunk may begin with last blocks within the overlap."""

    def eval(self, text: str, target: int = segment.TARGET, overlap: int = segment.OVERLAP):
        for k, (a, b, path) in enumerate(segment.chunk(text or "", target, overlap)):
            yield k, a, b, text[a:b], list(path)


@F.udtf(returnType=_SPAN, useArrow=True)
class SplitOversized:
    """split_oversized(text, target): spans of at most target that cover a text, cut at sentences and lines where they can be."""

    def eval(self, text: str, target: int = segment.TARGET):
        text = text or ""
        for k, (a, b) in enumerate(segment.pieces(text, 0, len(text.rstrip()), target)):
            yield k, a, b


def register(spark: SparkSession) -> None:
    for name, function in (("split_blocks", SplitBlocks), ("chunk_text", ChunkText), ("split_oversized", SplitOversized)):
        spark.udtf.register(name, function)
