"""Text-function, segmentation, source and streaming queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as T
from ..operators import segment
from ..sources import vault
from ..streaming import incremental
from . import relations as R
from .registry import query

D = "documents"


def _doc(name, column, sql, frame=None):
    """A query of one computed column beside doc_id."""
    query(name, f"SELECT doc_id, {sql} AS value FROM documents")(lambda s, d: (frame or (lambda df: df))(R.read(s, d, D)).select("doc_id", column().alias("value")))


_X = lambda: F.col("text")
_doc("fn_sha256", lambda: F.sha2(_X(), 256), "sha256(text)")
_doc("fn_digest", lambda: T.digest(F.lit("document"), F.col("source"), F.col("doc_id")), "substring(sha256('document' || chr(0) || source || chr(0) || doc_id), 1, 32)")
_doc("fn_strip_accents", lambda: T.strip_accents_any(_X()), "strip_accents(text)")
_doc("fn_collapse_ws", lambda: T.collapse_ws(_X()), "trim(regexp_replace(text, '\\s+', ' ', 'g'))")
#: Written out here, not taken from the library: what normalisation must give.
_LABEL = "trim(regexp_replace(replace(lower(strip_accents(regexp_replace({0}, '^[\\s\"''`(\\[{{.,;:!?-]+|[\\s\"''`)\\]}}.,;:!?-]+$', '', 'g'))), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_doc("fn_normalize_label", lambda: T.normalize_label(_X()), _LABEL.format("text"))
_doc("fn_slug", lambda: T.slug(T.first_line(_X())), "trim(substr(trim(regexp_replace(regexp_replace(lower(strip_accents(trim(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)[1], '^\\s*#+', '')))), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-')")
_doc("fn_first_line", lambda: T.first_line(_X()), "trim(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)[1], '^\\s*#+', ''))")
_doc("fn_fts_query", lambda: T.match_query(_X()), "array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda t: '\"' || t || '\"'), ' OR ')")
_TOKENS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{Nl}\\p{No}]+')"
_doc("fn_tokens_lang", lambda: F.size(T.letter_tokens(_X())).cast("long"), f"len({_TOKENS})")
_EXTRA = " || ' #tag' || doc_id || ' @who' || (doc_id % 7) || ' see https://a.example/x?y=' || doc_id || ' mail me' || doc_id || '@b.example [[Note ' || (doc_id % 9) || '|alias]] on 2024-0' || (doc_id % 9 + 1) || '-11 at 9h3' || (doc_id % 10) || ' in /var/log/x' || doc_id"


def _signals(df):
    i = F.col("doc_id")
    more = F.concat(F.lit(" #tag"), i, F.lit(" @who"), i % 7, F.lit(" see https://a.example/x?y="), i, F.lit(" mail me"), i, F.lit("@b.example [[Note "), i % 9, F.lit("|alias]] on 2024-0"), i % 9 + 1, F.lit("-11 at 9h3"), i % 10, F.lit(" in /var/log/x"), i)
    return df.withColumn("text", F.concat("text", more))


_BODIES = {}


def _signal(name, fn, pattern, transform="x", group=1):
    _BODIES[name] = body = f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text{_EXTRA}, '{pattern}', {group}), lambda x: length(trim(x)) > 0), lambda x: {transform})))"
    query(name, f"SELECT doc_id, {body} AS value FROM documents")(lambda s, d: _signals(R.read(s, d, D)).select("doc_id", F.array_sort(fn(F.col("text"))).alias("value")))


_signal("fn_urls", T.urls, "(https?://[^\\s<>\"'')\\]]+)")
_signal("fn_emails", T.emails, "[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.-]+", group=0)
_signal("fn_hashtags", T.hashtags, "(?:^|[^\\p{L}\\p{N}_#])#([^\\s\\p{Z}#,.;:!?]{2,50})")
_signal("fn_mentions", T.mentions, "(?:^|[^\\p{L}\\p{N}_@])@([\\p{L}\\p{N}_.-]{2,50})")
_signal("fn_wikilinks", T.wikilinks, "\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]", "trim(x)")
_signal("fn_iso_dates", T.iso_dates, "\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b", group=0)
_signal("fn_times", T.times, "\\b(?:[01]?[0-9]|2[0-3])[h:][0-5][0-9]\\b", "replace(x, 'h', ':')", group=0)
_signal("fn_paths", T.paths, "(?:[A-Za-z]:\\\\|~/|\\./|/)[\\p{L}\\p{N}_./\\\\-]{2,200}", group=0)
#: Written out here, not taken from the library: the words that must count.
_WORDS = {
    "fr": "je tu il elle nous vous ils elles le la les un une des du de et est sont pas plus pour dans avec sur que qui quoi mais donc car ce cette ces mon ma mes ton ta tes son sa ses au aux fait faire ete etre avoir tres bien alors aujourd hui hier demain parce comme quand",
    "en": "i you he she we they the a an of and is are was were not for in with on that which what but so because this these those my your his her its at to from have has had been being very well then today yesterday tomorrow when like just about",
}
_COUNT = {lang: f"len(list_filter({_TOKENS}, lambda t: t IN (" + ", ".join(f"'{w}'" for w in words.split()) + ")))" for lang, words in _WORDS.items()}
query("agg_stopword_score", f"SELECT doc_id, {_COUNT['fr']} AS fr, {_COUNT['en']} AS en FROM documents")(
    lambda s, d: R.read(s, d, D).select("doc_id", T.language_scores(F.col("text")).alias("m")).select("doc_id", F.col("m.fr").cast("long").alias("fr"), F.col("m.en").cast("long").alias("en"))
)
_doc("fn_detect_language", lambda: T.detect_language(_X()), f"CASE WHEN len({_TOKENS}) < 5 OR {_COUNT['fr']} = {_COUNT['en']} THEN 'und' WHEN {_COUNT['fr']} > {_COUNT['en']} THEN 'fr' ELSE 'en' END")
_LANGUAGE = f"CASE WHEN len({_TOKENS}) < 5 OR {_COUNT['fr']} = {_COUNT['en']} THEN 'und' WHEN {_COUNT['fr']} > {_COUNT['en']} THEN 'fr' ELSE 'en' END"
_KINDS = {"urls": "fn_urls", "emails": "fn_emails", "hashtags": "fn_hashtags", "wikilinks": "fn_wikilinks", "mentions": "fn_mentions", "dates": "fn_iso_dates", "times": "fn_times", "paths": "fn_paths"}


@query(
    "fn_format_signals",
    "SELECT doc_id, language, " + ", ".join(f"list_sort(str_split({kind}, ', ')) AS {kind}" for kind in _KINDS)
    + f" FROM (SELECT doc_id, {_LANGUAGE.replace('text', f'(text{_EXTRA})') } AS language, " + ", ".join(f"array_to_string({_BODIES[name]}, ', ') AS {kind}" for kind, name in _KINDS.items()) + " FROM documents)",
)
def format_signals(s, d):
    """The prompt's block of signals, taken apart again, as SQL knows no first places."""
    told = _signals(R.read(s, d, D)).select("doc_id", T.format_signals(F.col("text")).alias("block"))
    lines = told.select("doc_id", F.split("block", "\n").alias("lines"))
    of = lambda kind: F.get(F.transform(F.filter("lines", lambda x: x.startswith(f"{kind}: ")), lambda x: F.substring_index(x, ": ", -1) if kind == "language" else x.substr(F.lit(len(kind) + 3), F.length(x))), F.lit(0))
    return lines.select("doc_id", of("language").alias("language"), *[F.array_sort(F.split(F.coalesce(of(kind), F.lit("")), ", ")).alias(kind) for kind in _KINDS])


# first-seen order; the oracle finds each word's first place
_doc("agg_distinct_ordered", lambda: F.array_join(F.array_distinct(F.filter(F.split("text", " "), lambda t: F.length(t) > 12)), "|"), "array_to_string(list_filter(list_transform(range(1, len(string_split(text, ' ')) + 1), lambda i: CASE WHEN length(string_split(text, ' ')[i]) > 12 AND list_position(string_split(text, ' '), string_split(text, ' ')[i]) = i THEN string_split(text, ' ')[i] END), lambda w: w IS NOT NULL), '|')")
_CITE = "text || ' [' || (doc_id % 5) || '] and [12] [' || (doc_id % 5) || ']'"
query("fn_citations", f"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all({_CITE}, '\\[([0-9]{{1,9}})\\]', 1), lambda x: x::INT))) AS value FROM documents")(
    lambda s, d: R.read(s, d, D).select("doc_id", T.citations(F.concat("text", F.lit(" ["), F.col("doc_id") % 5, F.lit("] and [12] ["), F.col("doc_id") % 5, F.lit("]"))).alias("value"))
)
_doc("fn_is_uncited", lambda: T.is_uncited(_X(), F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array("doc_id"))), "doc_id % 4 <> 0 AND len(regexp_extract_all(text, '\\[([0-9]{1,9})\\]', 1)) = 0")
query("join_cited_passages", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.item_id IN (d.doc_id % 40, 12)")(
    lambda s, d: (lambda c: c.join(R.read(s, d, "benchmark").select("item_id"), "item_id", "left_semi").select("doc_id", "item_id"))(
        R.read(s, d, D).select("doc_id", F.explode(F.transform(T.citations(F.concat(F.lit("["), F.col("doc_id") % 40, F.lit("] [12]"))), lambda n: n.cast("long"))).alias("item_id"))
    )
)
_doc("fn_surface", lambda: F.concat(F.col("lang"), F.lit(": "), F.col("source")), "lang || ': ' || source")
_doc("fn_template", lambda: T.render_template("In $lang from ${source} for $$5: {$lang}", lang=F.col("lang"), source=F.col("source")), "'In ' || coalesce(lang, '') || ' from ' || coalesce(source, '') || ' for $5: {' || coalesce(lang, '') || '}'")
_doc("fn_heading_path", lambda: F.coalesce(F.nullif(F.array_join(F.filter(F.array("lang", "source"), lambda x: ~x.startswith("src0")), " > "), F.lit("")), F.lit("(top level)")), "coalesce(nullif(array_to_string(list_filter([lang, source], lambda x: NOT starts_with(x, 'src0')), ' > '), ''), '(top level)')")
_doc("fn_date_in_name", lambda: F.regexp_extract(F.concat(F.lit("n/2024-05-1"), F.col("doc_id") % 10, F.lit("-x.md")), r"(\d{4}-\d{2}-\d{2})", 1), "regexp_extract('n/2024-05-1' || (doc_id % 10) || '-x.md', '(\\d{4}-\\d{2}-\\d{2})', 1)")
_doc("fn_sanitise_ext", lambda: T.sanitise_extension(F.concat(F.lit(".W-"), F.col("lang"))), "coalesce(nullif(regexp_replace(lower('.W-' || lang), '[^a-z0-9]', '', 'g'), ''), 'bin')")
_doc("prj_path_normalise", lambda: T.normalise_path(F.concat(F.lit("/"), "source", F.lit("\\"), "doc_id", F.lit(".md/"))), "trim(replace('/' || source || '\\' || doc_id || '.md/', '\\', '/'), '/')")
_doc("prj_truncate_preview", lambda: F.substring(F.trim("text"), 1, 400), "substr(trim(text), 1, 400)")
# a chunk from place 100 on, a claim's span in it, and the slice of the document that the span means
query("prj_span_to_absolute", "SELECT doc_id, 100 + 7 AS char_start, 100 + 27 AS char_end, substr(text, 108, 20) AS quote FROM documents")(
    lambda s, d: R.read(s, d, D).withColumns({"chunk": F.expr("substring(text, 101, 1200)"), "char_start": F.lit(100), "start": F.lit(7), "end": F.lit(27)})
    .select("doc_id", (F.col("char_start") + F.col("start")).alias("char_start"), (F.col("char_start") + F.col("end")).alias("char_end"), F.expr("substring(chunk, start + 1, end - start)").alias("quote"))
)
_doc("prj_chunk_fields", lambda: F.array_join(F.from_json(F.to_json(F.array("lang", "source")), "array<string>"), "/"), "lang || '/' || source")
_doc("flt_nonblank", lambda: F.length(F.trim("text")) > 0, "length(trim(text)) > 0")
query("flt_excluded_path", "SELECT doc_id FROM documents WHERE NOT list_has_any([lang, source], ['.git', 'node_modules', 'src3'])")(
    lambda s, d: R.read(s, d, D).where(~F.arrays_overlap(F.split(F.concat_ws("/", "lang", "source"), "/"), F.array(F.lit(".git"), F.lit("node_modules"), F.lit("src3")))).select("doc_id")
)
query("src_file_decode", "SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS byte_size FROM documents")(
    lambda s, d: vault.decoded(R.read(s, d, D).select("doc_id", F.concat(F.lit("notes/"), "doc_id").alias("relative_path"), F.col("text").cast("binary").alias("content"))).select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("byte_size"))
)


@query(
    "src_frontmatter",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang END AS title, CASE doc_id % 3 WHEN 0 THEN length('---' || chr(13) || chr(10) || 'title: ' || lang || chr(13) || chr(10) || '---' || chr(13) || chr(10))
 WHEN 1 THEN length('---' || chr(10) || '- a' || chr(10) || '---' || chr(10)) ELSE 0 END AS body_start FROM documents""",
)
def frontmatter(s, d):
    """A third of the notes with a mapping and Windows line ends, a third with a list, which is no mapping, a third without front matter."""
    k = F.col("doc_id") % 3
    head = F.when(k == 0, F.concat(F.lit("---\r\ntitle: "), "lang", F.lit("\r\n---\r\n"))).when(k == 1, "---\n- a\n---\n").otherwise("")
    notes = R.read(s, d, D).select("doc_id", F.concat(head, "text").alias("note"))
    return notes.select("doc_id", F.element_at(vault.front_matter("note"), "title").alias("title"), vault.body_start("note").cast("long").alias("body_start"))


query("sink_attachment", "SELECT event_id, strftime(ts, '%Y-%m-%d-%H%M%S') || '-' || substr(sha256(props), 1, 8) || '.json' AS name FROM events")(
    lambda s, d: R.read(s, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd-HHmmss"), F.lit("-"), F.substring(F.sha2("props", 256), 1, 8), F.lit(".json")).alias("name"))
)
query("sink_entry", "SELECT event_id, name || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS file FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') || '-' || event_type AS name, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), event_type ORDER BY event_id) AS n FROM events)")(
    lambda s, d: incremental.entry_names(R.read(s, d, "events").select("event_id", F.concat_ws("-", F.date_format("ts", "yyyy-MM-dd"), "event_type").alias("name")), "event_id")
)
query("fn_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc FROM events")(lambda s, d: R.read(s, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("utc")))
query("fn_parse_user_date", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2000-01-01' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")(
    lambda s, d: R.read(s, d, "events").select("event_id", F.date_format(T.parse_user_date(F.when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.date_format("ts", " yyyy-MM-dd ")), F.to_timestamp(F.lit("2000-01-01"))), "yyyy-MM-dd").alias("day"))
)


@query(
    "fn_event_time",
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN '2000-01-01' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events",
)
def event_times(s, d):
    """An event's date as one in front matter, in the path, within other text of front matter, and one that isn't possible."""
    k, day = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd")
    front = F.when(k == 0, F.create_map(F.lit("created"), day)).when(k == 2, F.create_map(F.lit("date"), F.concat(F.lit("Friday, "), day, F.lit(", late"))))
    path = F.when(k == 1, F.concat(F.lit("a/"), day, F.lit("-x.md"))).otherwise("a/2023-02-31.md")
    return R.read(s, d, "events").select("event_id", F.date_format(T.event_time(front, path, F.to_timestamp(F.lit("2000-01-01"))), "yyyy-MM-dd").alias("day"))


query("fn_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = 0")(
    lambda s, d: (lambda v: v.crossJoin(F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("e")))).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("e")), 6).alias("score")))(R.read(s, d, "embeddings"))  # one row
)
query("fn_l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm FROM embeddings")(
    lambda s, d: R.read(s, d, "embeddings").select("vec_id", T.l2_normalise(F.col("embedding")).alias("u")).select("vec_id", F.round(T.dot(F.col("u"), F.col("u")), 6).alias("norm"))
)
def _trigram_sql(key, text, table):
    return f"""WITH p AS (SELECT {key}, '  ' || replace(lower({text}), 'ß', 'ss') || '  ' AS padded FROM {table}), g AS (SELECT {key}, padded, unnest(range(1, length(padded) - 1)) AS i FROM p),
c AS (SELECT {key}, ('0x' || substr(sha256(substr(padded, i, 3)), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM g GROUP BY ALL)
SELECT {key}, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY {key})), 6) AS weight FROM c"""


def _trigrams(df, key, text):
    weights = df.select(key, F.posexplode(T.trigram_embedding(F.col(text))).alias("bucket", "weight"))
    return weights.where("weight > 0").select(key, F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


query("agg_trigram_hash", _trigram_sql("p_partkey", "p_name", "part"))(lambda s, d: _trigrams(R.read(s, d, "part"), "p_partkey", "p_name"))


@query("fn_locate_quote")
def locate_quote(s, d):
    """A quote from each text: as it stands, with other white space, with other case, or never said; no SQL, tested against brute force."""
    docs = R.read(s, d, D).select("doc_id", "text", F.expr("substring(text, 5, 40)").alias("said"))
    k = F.col("doc_id") % 4
    quote = F.when(k == 0, F.concat(F.lit(" "), "said", F.lit("\n"))).when(k == 1, F.regexp_replace("said", "\\s+", " \n ")).when(k == 2, F.upper(F.regexp_replace("said", "\\s+", "  "))).otherwise(F.concat("said", F.lit(" 0never0said0")))
    return docs.withColumn("quote", quote).withColumn("q", T.locate_quote(F.col("text"), F.col("quote"))).select("doc_id", "quote", F.col("q.start").alias("start"), F.col("q.end").alias("stop"))


# segmentation by table functions; what SQL can't express is tested against slices and examples
@query(
    "tvf_split_oversized",
    r"""WITH RECURSIVE t AS (SELECT doc_id, text, length(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS stop FROM documents),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS start, stop FROM t UNION ALL
  SELECT doc_id, start + CASE WHEN greatest(a, b) > 600 THEN greatest(a, b) ELSE 1200 END, stop FROM (
    SELECT doc_id, start, stop, length(regexp_extract(part, '(?s)^(.*[.!?…])\s', 1)) AS a, length(regexp_extract(part, '(?s)^(.*[^\s.!?…]\s*)\n', 1)) AS b
    FROM (SELECT r.doc_id, r.start, r.stop, substr(text, r.start + 1, 1200) AS part FROM r JOIN t USING (doc_id) WHERE r.stop - r.start > 1200))),
s AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), stop) AS stop FROM r),
k AS (SELECT doc_id, s.start, s.stop FROM s JOIN t USING (doc_id) WHERE regexp_matches(substr(text, s.start + 1, s.stop - s.start), '\S'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS ordinal, start, stop AS "end" FROM k""",
)
def split_oversized(s, d):
    tables.register(s)
    return s.sql("SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(start AS BIGINT) AS start, CAST(`end` AS BIGINT) AS `end` FROM {docs}, LATERAL split_oversized(text)", docs=R.read(s, d, D).select("doc_id", "text"))


def _notes(s, d):
    """Conversations as Markdown: a heading a turn."""
    turn = F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n\n"), "text", F.lit("\n\n")).alias("md"))
    return R.read(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["md"]), "").alias("text"))


query("src_blocks")(lambda s, d: segment.explode_spans(_notes(s, d), segment.blocks_of(F.col("text"))).select("conv_id", "ordinal", "start", "end", F.array_join("heading_path", " > ").alias("path")))


def _lateral(s, d, columns, function):
    tables.register(s)
    return s.sql(f"SELECT conv_id, ordinal, start, `end`, {columns} FROM {{notes}}, LATERAL {function}", notes=_notes(s, d).withColumnRenamed("text", "body"))


query("tvf_split_blocks")(lambda s, d: _lateral(s, d, "array_join(heading_path, ' > ') AS path, text", "split_blocks(body)"))
query("tvf_chunk_pack")(lambda s, d: _lateral(s, d, "text", "chunk_text(body)"))


@query("tvf_chunk_overlap")
def chunk_overlap(s, d):
    """Each chunk with the characters that it shares with the one before it."""
    return _lateral(s, d, "greatest(0, lag(`end`, 1, 0) OVER (PARTITION BY conv_id ORDER BY ordinal) - start) AS shared", "chunk_text(body, 600, 200)")


query("udf_embed", _trigram_sql("doc_id", "text", "documents"))(lambda s, d: _trigrams(R.read(s, d, D), "doc_id", "text"))

# streams, run to their end over the files that are there
query("str_stateful_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")(incremental.counted_stream)
query("str_dedupe", "SELECT DISTINCT user_id, event_type FROM events")(incremental.deduped_stream)
query("str_late_data", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY 1")(incremental.windowed_stream)
query("str_incremental_ingest", "SELECT doc_id, sha256(text) AS content_hash FROM documents")(incremental.ingested_stream)
