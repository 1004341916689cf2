"""Claims out of stored model responses: JSON checked strictly, quotes located, spans made absolute, duplicates dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import stored

_FIELDS = ["subject", "subject_type", "predicate", "object", "object_type", "quote"]
CLAIM = "struct<" + ",".join(f"{n}:string" for n in _FIELDS) + ",object_is_literal:boolean,confidence:double>"
MOST_LABEL, MOST_QUOTE, CONFIDENCE = 200, 600, 0.7


def _kind(v: Column, path: str | None = None) -> Column:
    """The type of a JSON value, or of what is at a path in it: OBJECT<...>, ARRAY<...>, STRING, BOOLEAN, VOID, or a number's; null if there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant") if path else v)


def _object(v: Column, fields: list[str], path: str | None = None) -> Column:
    """Whether it is an object that has no other fields."""
    inner = F.try_variant_get(v, path, "variant") if path else v
    return F.coalesce(_kind(v, path).startswith("OBJECT<") & F.forall(F.map_keys(inner.try_cast("map<string,variant>")), lambda k: k.isin(fields)), F.lit(False))


def _text(v: Column, path: str, most: int) -> Column:
    """Whether a text of 1 to `most` characters is there."""
    return F.coalesce((_kind(v, path) == "STRING") & F.length(F.try_variant_get(v, path, "string")).between(1, most), F.lit(False))


def _claim_holds(v: Column) -> Column:
    concept = lambda side: _object(v, ["label", "type"], f"$.{side}") & _text(v, f"$.{side}.label", MOST_LABEL) & _text(v, f"$.{side}.type", MOST_LABEL)
    literal, sure = _kind(v, "$.object_is_literal"), _kind(v, "$.confidence")
    number = (sure.isin("BIGINT", "DOUBLE", "FLOAT") | sure.startswith("DECIMAL")) & F.try_variant_get(v, "$.confidence", "double").between(0, 1)
    return (
        _object(v, ["subject", "predicate", "object", "object_is_literal", "confidence", "quote"]) & concept("subject") & concept("object")
        & _text(v, "$.predicate", MOST_LABEL) & _text(v, "$.quote", MOST_QUOTE)
        & (literal.isNull() | (literal == "BOOLEAN")) & (sure.isNull() | F.coalesce(number, F.lit(False)))
    )


def _claim(v: Column) -> Column:
    at = lambda path: F.try_variant_get(v, path, "string")
    names = {"subject": "$.subject.label", "subject_type": "$.subject.type", "predicate": "$.predicate", "object": "$.object.label", "object_type": "$.object.type", "quote": "$.quote"}
    return F.struct(
        *[at(path).alias(name) for name, path in names.items()],
        F.coalesce(F.try_variant_get(v, "$.object_is_literal", "boolean"), F.lit(False)).alias("object_is_literal"),
        F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(CONFIDENCE)).alias("confidence"),
    )


def _whole_json(x: Column) -> Column:
    """The JSON value that a text is, or null. The parser stops behind a value, so the text is put into a list and into an object: no rest fits both."""
    inside = F.try_parse_json(F.concat(F.lit('{"r":'), x, F.lit("}")))
    return F.when(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))).isNotNull(), F.try_variant_get(inside, "$.r", "variant"))


def parsed(response: Column) -> Column:
    """struct(reason, claims): why the response as a whole is rejected, or its claims; one bad claim rejects all. It stays in the JVM.

    A response is an object with `facts`, a list (or without it: no claims). Repeated keys, and what else the JSON parser of Spark doesn't take, are unparseable.
    """
    claims = lambda v: F.try_variant_get(v, "$.facts", "array<variant>")
    listed = lambda v: F.coalesce(_kind(v, "$.facts").startswith("ARRAY<"), _kind(v, "$.facts").isNull())
    good = lambda v: _object(v, ["facts"]) & listed(v) & F.coalesce(F.forall(claims(v), _claim_holds), F.lit(True))
    reason = lambda v: F.when(v.isNull(), "unparseable_response").when(~good(v), "schema_violation")
    found = lambda v: F.coalesce(F.transform(claims(v), _claim), F.array().cast(f"array<{CLAIM}>"))
    return T.let(_whole_json(F.coalesce(response, F.lit(""))), lambda v: T.let(reason(v), lambda r: F.struct(r.alias("reason"), F.when(r.isNull(), found(v)).alias("claims"))))


def _located(p: Column, text: Column) -> Column:
    """parsed(), each claim with where its quote stands in the text (at: start, end, said; null: nowhere)."""
    said = lambda s: F.when(s.isNotNull(), F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substr(text, s["start"] + 1, s["end"] - s["start"]).alias("said")))
    one = lambda c: F.struct(c.alias("claim"), T.let(T.locate_quote(text, c["quote"]), said).alias("at"))
    return T.let(p, lambda r: F.struct(r["reason"].alias("reason"), F.transform(r["claims"], one).alias("claims")))


def extract(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, rejections) of chunks (chunk_id, text, char_start, response).

    A fact's span is where its quote stands in the document and its quote is what stands there; a quote that isn't found
    rejects the claim. The first of equal fact ids of a chunk stays.
    """
    start, end = F.col("char_start") + F.col("at.start"), F.col("char_start") + F.col("at.end")
    read = chunks.select("chunk_id", "char_start", _located(parsed(F.col("response")), F.col("text")).alias("p"), F.substring("response", 1, 200).alias("head"))
    read = stored(read, "claims-read")  # both results are taken from it, so that a response is parsed, and a quote looked for, once
    whole = read.where("p.reason IS NOT NULL").select("chunk_id", F.col("p.reason").alias("reason"), F.col("head").alias("detail"))
    located = read.where("p.reason IS NULL").select("chunk_id", "char_start", F.posexplode("p.claims").alias("place", "c")).select("chunk_id", "char_start", "place", "c.claim.*", "c.at")
    lost = located.where("at IS NULL").select("chunk_id", F.lit("quote_not_found").alias("reason"), F.substring("quote", 1, 200).alias("detail"))
    facts = located.where("at IS NOT NULL").select(
        T.digest(F.lit("fact"), F.col("chunk_id"), F.col("subject"), F.col("predicate"), F.col("object"), start, end).alias("fact_id"), "chunk_id", "place", *_FIELDS[:-1], "object_is_literal", "confidence",
        start.alias("char_start"), end.alias("char_end"), F.col("at.said").alias("quote"),
    )
    first = F.row_number().over(Window.partitionBy("chunk_id", "fact_id").orderBy("place")) == 1
    return facts.withColumn("first", first).where("first").drop("first"), whole.unionByName(lost)
