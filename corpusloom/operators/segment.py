"""Structure-aware segmentation: front matter, blocks, chunks with exact offsets. Offsets are code points of the whole text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

TARGET, OVERLAP = 1200, 120
# What a heading, the end of a sentence or line, and leading front matter look like.
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_BOUNDARY = re.compile(r"(?<=[.!?…])\s+|\n")
_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)


def body_offset(text: str) -> int:
    found = _FRONT.match(text)
    return found.end() if found else 0


def blocks(text: str, offset: int = 0) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """(start, end, heading path) of each run of lines; headings and blank lines part them and belong to none."""
    path: list[str] = []
    start, at = None, offset
    for line in text[offset:].splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        heading = _HEADING.match(bare)
        if heading or not bare.strip():
            if start is not None:
                yield start, start + len(text[start:at].rstrip()), tuple(path)
                start = None
            if heading:
                path[len(heading[1]) - 1 :] = [heading[2]]
        elif start is None:
            start = at
        at += len(line)
    if start is not None:
        yield start, start + len(text[start:].rstrip()), tuple(path)


def pieces(text: str, start: int, end: int, target: int = TARGET) -> Iterator[tuple[int, int]]:
    """Spans of at most target that cover a long block: cut behind the last sentence or line end past half, else hard."""
    while end - start > target:
        cuts = [m.start() for m in _BOUNDARY.finditer(text[start : start + target]) if target // 2 < m.start()]
        cut = start + (cuts[-1] if cuts else target)
        if text[start:cut].strip():
            yield start, cut
        start = cut
    if text[start:end].strip():
        yield start, end


def chunk(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, heading path): blocks packed while they fit; the next chunk may start again with last blocks within overlap."""
    found, out, k = list(blocks(text, body_offset(text))), [], 0
    while k < len(found):
        start, end, path = found[k]
        if end - start > target:
            out += [(a, b, path) for a, b in pieces(text, start, end, target)]
            k += 1
            continue
        last = k
        while last + 1 < len(found) and found[last + 1][1] - start <= target:
            last += 1
        out.append((start, found[last][1], path))
        again = last + 1
        while again - 1 > k and again < len(found) and found[last][1] - found[again - 1][0] <= overlap:
            again -= 1
        k = again
    return out


_SPAN = [K.StructField("start", K.IntegerType()), K.StructField("end", K.IntegerType())]
SPANS = K.ArrayType(K.StructType(_SPAN))
CHUNKS = K.ArrayType(K.StructType([*_SPAN, K.StructField("text", K.StringType()), K.StructField("heading_path", K.ArrayType(K.StringType()))]))


@F.pandas_udf(CHUNKS)
def chunks_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [(a, b, t[a:b], list(p)) for a, b, p in chunk(t or "")])


@F.pandas_udf(CHUNKS)
def blocks_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [(a, b, t[a:b], list(p)) for a, b, p in blocks(t or "", body_offset(t or ""))])


@F.pandas_udf(SPANS)
def pieces_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: list(pieces(t or "", 0, len((t or "").rstrip()))))


def explode_spans(df: DataFrame, column) -> DataFrame:
    """The row's columns, ordinal, and the span's fields."""
    return df.select("*", F.posexplode(column).alias("ordinal", "span_")).select(*df.columns, "ordinal", "span_.*")
