"""Text functions as Column expressions: digests, normalisation, quote location, signals, citations."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# The language detector's stop words, unaccented, by language, and the patterns of signals (in Python's syntax).
STOPWORDS = {
    "fr": """je tu il elle nous vous ils elles le la les un une des du de et est sont
        pas plus pour dans avec sur que qui quoi mais donc car ce cette ces mon ma
        mes ton ta tes son sa ses au aux fait faire ete etre avoir tres bien alors
        aujourd hui hier demain parce comme quand""".split(),
    "en": """i you he she we they the a an of and is are was were not for in with on
        that which what but so because this these those my your his her its at to
        from have has had been being very well then today yesterday tomorrow
        when like just about""".split(),
}
URL = r"https?://[^\s<>\"'\])]+"
# A match begins where a run of its characters does, or at a + behind another match: all other starts in a run end as that one, so a run is looked at once.
EMAIL = r"(?:(?<![\w.+-])|(?=\+))[\w.+-]++@[\w-]+\.[\w.-]+"
# What most places of a text fail by comes first.
HASHTAG = r"#(?<![\w#]#)([^\s#,.;:!?]{2,50})"
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
MENTION = r"@(?<![\w@]@)([\w.-]{2,50})"
ISO_DATE = r"(?=\d)(?<![\w])(\d{4}-\d{2}-\d{2})(?![\w])"
CLOCK_TIME = r"(?=\d)(?<![\w])([01]?\d|2[0-3])[h:]([0-5]\d)(?![\w])"
FS_PATH = r"(?:[A-Za-z]:\\|~/|\./|/)[\w./\\-]{2,200}"
# Punctuation that goes from a label's edges.
LABEL_EDGES = r"^[\s\"'`(\[{.,;:!?-]+|[\s\"'`)\]}.,;:!?-]+$"
#: Python's classes of str patterns, as members of a Java character class.
_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x85\p{Z}"


def java(pattern: str) -> str:
    """A pattern of Python's, whose \\w and \\s stand within brackets, in Java's syntax with the same Unicode classes."""
    border = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
    for python, own in ((r"\w", _WORD), (r"\s", _SPACE), (r"\d", r"\p{Nd}"), (r"\b", border)):
        pattern = pattern.replace(python, own)
    return pattern


#: Accented letters of the corpora's languages and what they fold to; strip_accents_any covers the rest.
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
DIGEST_CHARS = 32


def digest(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts, joined by NUL; a null part is the empty string."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, DIGEST_CHARS)


def collapse_ws(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def strip_accents(x: Column) -> Column:
    """Latin letters without their accents; stays in the JVM."""
    return F.translate(x, ACCENTED, PLAIN)


@lru_cache
def _marks() -> str:
    """Combining marks as a Java character class."""
    import unicodedata

    found = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    starts = [c for k, c in enumerate(found) if not k or found[k - 1] != c - 1]
    ends = [c for k, c in enumerate(found) if k + 1 == len(found) or found[k + 1] != c + 1]
    ranges = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))
    return rf"[\x{{{found[0]:x}}}-\x{{10ffff}}&&[{ranges}]]"  # most characters lie before all marks


def strip_accents_any(x: Column) -> Column:
    """Any text: compatibility decomposition without combining marks. Spark's own ICU decomposes it in the JVM, a text at a time, so no worker holds batches of texts."""
    apart = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(x, F.lit("")), F.lit(True))
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(apart, _marks(), "")).otherwise(x)


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def normalize_label(x):
    """Edge punctuation off, accents off, case folded, white space collapsed; labels that a reader keeps apart stay apart."""
    import unicodedata

    edges = re.compile(LABEL_EDGES)

    def one(label):
        plain = "".join(c for c in unicodedata.normalize("NFKD", edges.sub("", label)) if not unicodedata.combining(c))
        return " ".join(plain.casefold().split())

    return x.map(lambda label: None if label is None else one(label))


def escape_regex(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def locate_quote(text: Column, quote: Column) -> Column:
    """struct(start, end), half-open code points in text, or null: exact, then any white space, then any case."""
    span = lambda start, size: F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("end"))

    def by(flags: str, wanted: Column) -> Column:
        pattern = F.concat(F.lit(flags), F.regexp_replace(escape_regex(wanted), r"(?U)\s+", r"\\s+"))
        return let(pattern, lambda p: let(F.regexp_substr(text, p), lambda found: F.when(found.isNotNull(), span(F.length(F.split(text, p, 2)[0]), F.length(found)))))

    def place(wanted: Column) -> Column:
        exact = let(F.instr(text, wanted), lambda at: F.when(at > 0, span(at - 1, F.length(wanted))))
        return F.when(F.length(wanted) > 0, F.coalesce(exact, by("(?U)", wanted), by("(?Uiu)", wanted)))

    return let(F.regexp_replace(quote, r"(?U)^\s+|\s+$", ""), place)


def slug(x: Column, most: int = 48) -> Column:
    """Decomposed to ASCII, lower case, other runs as dashes; texts beyond Latin letters are decomposed in a Python worker only where there are any."""
    latin = strip_accents(x)
    ascii_ = F.when(latin.rlike(r"[^\x00-\x7F]"), strip_accents_any(x)).otherwise(latin)
    dashed = F.trim(F.regexp_replace(F.lower(F.regexp_replace(ascii_, r"[^\x00-\x7F]", "")), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.trim(F.substring(dashed, 1, most), F.lit("-"))


def first_line(x: Column) -> Column:
    """First line that isn't blank, without leading #."""
    lines = F.filter(F.split(x, "\n"), lambda line: F.length(F.trim(line)) > 0)
    return F.trim(F.regexp_replace(F.get(lines, F.lit(0)), r"^\s*#+", ""))


def fold_terms(x: Column) -> Column:
    """Search terms: runs of letters and digits, lower case, without accents; repeats stay."""
    return F.regexp_extract_all(F.lower(strip_accents(x)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def match_query(x: Column) -> Column:
    """Terms in quotes joined by OR, so nothing a user types is an operator."""
    terms = F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def _every(x: Column, pattern: str, group: int = 0) -> Column:
    """What the pattern's matches hold, without white space at the ends, each once in order of its first place."""
    bare = lambda v: F.regexp_replace(v, f"^[{_SPACE}]+|[{_SPACE}]+$", "")
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(x, F.lit(java(pattern)), F.lit(group)), bare), lambda v: F.length(v) > 0))


def urls(x: Column) -> Column:
    return _every(x, URL)


def emails(x: Column) -> Column:
    return _every(x, EMAIL)


def hashtags(x: Column) -> Column:
    return _every(x, HASHTAG, 1)


def mentions(x: Column) -> Column:
    return _every(x, MENTION, 1)


def wikilinks(x: Column) -> Column:
    return _every(x, WIKILINK, 1)


def iso_dates(x: Column) -> Column:
    return _every(x, ISO_DATE, 1)


def times(x: Column) -> Column:
    return F.array_distinct(F.transform(_every(x, CLOCK_TIME), lambda t: F.replace(t, F.lit("h"), F.lit(":"))))


def paths(x: Column) -> Column:
    return _every(x, FS_PATH)


def format_signals(x: Column) -> Column:
    """A text's language and signals as lines of a prompt; kinds without values are left out."""
    kinds = (("urls", urls), ("emails", emails), ("hashtags", hashtags), ("wikilinks", wikilinks), ("mentions", mentions), ("dates", iso_dates), ("times", times), ("paths", paths))
    line = lambda name: lambda v: F.when(F.size(v) > 0, F.concat(F.lit(f"{name}: "), F.array_join(v, ", ")))
    lines = F.array_compact(F.array(*[let(find(x), line(name)) for name, find in kinds]))
    told = let(lines, lambda v: F.when(F.size(v) > 0, F.array_join(v, "\n")).otherwise(F.lit("(no other signals detected)")))
    return F.concat(F.lit("language: "), detect_language(x), F.lit("\n"), told)


def render_vocabulary(types: Column, predicates: Column, limit: int = 60) -> Column:
    """The known types and predicates (arrays, most frequent first) as lines of a prompt."""
    listed = lambda a: let(F.slice(a, 1, limit), lambda v: F.when(F.size(v) > 0, F.array_join(v, ", ")).otherwise(F.lit("(none yet)")))
    both = F.concat(F.lit("types: "), listed(types), F.lit("\npredicates: "), listed(predicates))
    return F.when((F.size(types) == 0) & (F.size(predicates) == 0), F.lit("(empty -- this is the first pass over this vault)")).otherwise(both)


def render_template(template: str, **values: Column) -> Column:
    """The template with $name and ${name} replaced, $$ as a dollar sign; a name without a value, or a lone $, is an error. Values aren't searched for names; a null one is empty."""
    out, at = [], 0
    for found in re.finditer(r"\$(?:(\$)|(?P<bare>[_a-zA-Z][_a-zA-Z0-9]*)|\{(?P<braced>[_a-zA-Z][_a-zA-Z0-9]*)\}|)", template):
        name = found["bare"] or found["braced"]
        if not found[1] and not name:
            raise ValueError(f"a lone $ at place {found.start()} of the template")
        if name and name not in values:
            raise KeyError(name)
        out += [F.lit(template[at : found.start()]), F.lit("$") if found[1] else F.coalesce(values[name].cast("string"), F.lit(""))]
        at = found.end()
    return F.concat(*out, F.lit(template[at:]))


def letter_tokens(x: Column) -> Column:
    """Runs of letters and of digits that aren't decimal, case folded."""
    return F.regexp_extract_all(casefold(x), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))


def language_scores(x: Column) -> Column:
    """struct of fr, en, n: stop words of each language among the tokens, and the tokens; these are matched once."""
    return let(letter_tokens(x), lambda tokens: F.struct(*[F.size(F.filter(tokens, _one_of(words))).alias(lang) for lang, words in STOPWORDS.items()], F.size(tokens).alias("n")))


def _one_of(words: list[str]):
    return lambda token: token.isin(words)


def detect_language(x: Column) -> Column:
    """fr or en by at least one stop word more than the other among at least five tokens, else und."""
    return let(language_scores(x), lambda s: F.when((s["n"] < 5) | (s["fr"] == s["en"]), "und").when(s["fr"] > s["en"], "fr").otherwise("en"))


def citations(x: Column) -> Column:
    """The distinct numbers in [n], in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))))


def is_uncited(answer: Column, passages: Column) -> Column:
    """Whether an answer that was given passages (an array) points at none."""
    return (F.size(passages) > 0) & (F.size(citations(answer)) == 0)


def date_within(x: Column) -> Column:
    """The first YYYY-MM-DD in a string as a moment, or null; an impossible date is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(x, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")))


def parse_user_date(x: Column, now: Column) -> Column:
    """The moment that a user typed: blank means now, and what is no date is an error of the query."""
    bad = F.raise_error(F.concat(F.lit("not a date: "), x)).cast("timestamp")
    return F.when(F.length(F.trim(F.coalesce(x, F.lit("")))) == 0, now).otherwise(F.coalesce(F.try_to_timestamp(F.trim(x)), bad))


def event_time(front: Column, path: Column, fallback: Column) -> Column:
    """The first date key of a front matter map that holds a date, alone or within text, else the first real date in the path, else the fallback."""
    keys = [F.coalesce(F.try_to_timestamp(front[k]), date_within(front[k])) for k in ("date", "datetime", "created", "created_at", "timestamp")]
    return F.coalesce(*keys, date_within(path), fallback)


def normalise_path(x: Column) -> Column:
    return F.trim(F.translate(x, "\\", "/"), F.lit("/"))


def sanitise_extension(x: Column) -> Column:
    kept = F.regexp_replace(F.lower(x), r"[^a-z0-9]", "")
    return F.when(F.length(kept) > 0, kept).otherwise("bin")


def trigram_embedding(x: Column, dimensions: int = 64) -> Column:
    """Hashed character trigrams of the folded text, padded by two spaces, as a unit vector."""
    return _embedder(dimensions)(x)


def trigram_counts(text: str, dimensions: int, known: dict[str, int]) -> np.ndarray:
    """The unit vector of a text's trigrams by bucket; known: a memory of their buckets."""
    folded = text.casefold().join(("  ", "  "))
    grams = Counter(folded[k : k + 3] for k in range(len(folded) - 2))
    for gram in grams.keys() - known.keys():
        known[gram] = int(hashlib.sha256(gram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dimensions
    vector = np.bincount([known[g] for g in grams], list(grams.values()), dimensions)
    return vector / (np.linalg.norm(vector) or 1)


@lru_cache
def _embedder(dimensions: int):
    @F.pandas_udf(ArrayType(DoubleType()))
    def embedding(x: pd.Series) -> pd.Series:
        buckets: dict[str, int] = {}
        return x.map(lambda text: None if text is None else trigram_counts(text, dimensions, buckets))

    return embedding


def let(x: Column, body) -> Column:
    """body(x) with x evaluated once, however often body names it."""
    return F.transform(F.array(x), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def l2_normalise(a: Column) -> Column:
    """The unit vector; a zero vector stays."""
    return let(a, lambda v: let(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda e: F.when(norm > 0, e / norm).otherwise(F.lit(0.0)))))


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, v: acc + v))
