"""Where many quotes stand in many texts, tolerantly, and which expected claims many facts meet.

The quotes lie in files of a bounded number in the shared folder. A task reads its texts once for each file and looks for all its quotes at once, with
an automaton over what all three passes agree on: white space collapsed and case folded, character by character. Whatever stands in
a text exactly, or but for white space, stands there in that form too, so only hits are looked at more closely, and their places are
mapped back to the text's characters. Nothing goes through the driver.

Defined results: a quote's white space at the ends doesn't count; a quote without other characters stands nowhere; a null text or quote is the empty
one; repeated names and texts give a row each; places are half-open, in code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from .search import each_file, in_files

#: Quotes, or expected claims, of a file; characters of text that a task holds while it goes through the files.
BLOCK, HELD = 4096, 8 << 20
#: Values of a side whose expected claims a task remembers for a file.
KNOWN = 1024


def folded(text: str) -> str:
    """White space collapsed, none at the ends, case folded."""
    return " ".join(text.split()).casefold()


def _offsets(text: str) -> tuple[str, str, list[int], list[int]]:
    """The text with white space collapsed, that folded, and the places in the text of the characters of both."""
    plain, at, low, low_at, blank = [], [], [], [], True
    for k, c in enumerate(text):
        if c.isspace():
            if blank:
                continue
            c, blank = " ", True
        else:
            blank = False
        plain.append(c)
        at.append(k)
        for f in c.casefold():
            low.append(f)
            low_at.append(k)
    return "".join(plain), "".join(low), at, low_at


def locate(text: str, quote: str, known: tuple | None = None) -> tuple[int, int, str] | None:
    """Start, end and pass (exact, space or case) of where a quote first stands; known: _offsets(text)."""
    wanted = quote.strip()
    if not wanted:
        return None
    if (k := text.find(wanted)) >= 0:
        return k, k + len(wanted), "exact"
    plain, low, at, low_at = known or _offsets(text)
    wanted = " ".join(wanted.split())
    for how, body, places, part in (("space", plain, at, wanted), ("case", low, low_at, wanted.casefold())):
        if (k := body.find(part)) >= 0:
            return places[k], places[k + len(part) - 1] + 1, how
    return None


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[1] or "") + 64
            if size >= HELD:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _automaton(words: dict[str, list]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, value in words.items():
        found.add_word(word, value)
    found.make_automaton()
    return found


def quotes_in(docs: DataFrame, quotes: DataFrame, key: str = "doc_id", name: str = "item_id", block: int = BLOCK) -> DataFrame:
    """key, name, start, end, pass: where each quote (name, quote) first stands in each text, exactly, else but for white space, else but for case too."""
    quotes = quotes.select(F.col(name).alias("name"), F.coalesce("quote", F.lit("")).alias("quote"))
    folder = in_files(quotes, "quotes", block)
    kinds = [docs.schema[key].dataType, quotes.schema["name"].dataType]
    schema = pa.schema([(key, to_arrow_type(kinds[0])), (name, to_arrow_type(kinds[1])), ("start", pa.int64()), ("end", pa.int64()), ("pass", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            for wanted in each_file(folder):
                named: dict[str, list] = {}
                for q in wanted:
                    if low := folded(q["quote"]):
                        named.setdefault(low, []).append(q)
                if not named:
                    continue
                automaton, out = _automaton(named), []
                for doc, text in held:
                    hits = {id(qs): qs for _, qs in automaton.iter(folded(text or ""))}
                    known = _offsets(text) if hits else None
                    for q in (q for qs in hits.values() for q in qs):
                        start, end, how = locate(text, q["quote"], known)
                        out.append((doc, q["name"], start, end, how))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return docs.select(key, "text").mapInArrow(rows, f"{key} {kinds[0].simpleString()}, {name} {kinds[1].simpleString()}, start long, end long, pass string")


SIDES = ("subject", "predicate", "object")


def claims_met(expected: DataFrame, facts: DataFrame, name: str = "item_id", block: int = BLOCK, normal: Callable = T.normalize_label) -> DataFrame:
    """The names of the expected claims (name, subject, predicate, object) that a fact (subject, predicate, object) meets: each
    of its parts, normalised, holds the wanted part or nothing is wanted there. A task looks no further for what it has met, and remembers what frequent values meet."""
    part = lambda c: normal(F.coalesce(F.col(c), F.lit(""))).alias(c)
    folder = in_files(expected.select(F.col(name).alias("name"), *map(part, SIDES)), "expected", block)
    kind = expected.schema[name].dataType
    arrow = to_arrow_type(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set = set()
        for held in _held(batches):
            for number, wanted in enumerate(each_file(folder)):
                left_open = [k for k in range(len(wanted)) if (number, k) not in done]
                if not left_open:
                    continue
                free = [{k for k in left_open if not wanted[k][s]} for s in SIDES]
                words = [{} for _ in SIDES]
                for k in left_open:
                    for s, side in enumerate(SIDES):
                        if wanted[k][side]:
                            words[s].setdefault(wanted[k][side], set()).add(k)
                automata, met = [_automaton(w) if w else None for w in words], set()
                known: list[dict[str, set]] = [{} for _ in SIDES]
                for row in held:
                    left = None
                    for s, value in enumerate(row):
                        if (here := known[s].get(value)) is None:
                            here = free[s].union(*(ks for _, ks in automata[s].iter(value))) if automata[s] else free[s]
                            if len(known[s]) < KNOWN:
                                known[s][value] = here
                        left = here if left is None else left & here
                        if not left:
                            break
                    met |= left
                new = [k for k in sorted(met) if (number, k) not in done]
                done.update((number, k) for k in new)
                yield pa.RecordBatch.from_arrays([pa.array([wanted[k]["name"] for k in new], arrow)], [name])

    return facts.select(*SIDES).distinct().select(*map(part, SIDES)).distinct().mapInArrow(rows, f"{name} {kind.simpleString()}").distinct()
