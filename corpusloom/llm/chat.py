r"""Chat formatting by prefix-target expansion, DataFrame functions only.

A conversation is written as its turns one after the other, each `<|turn|>role`, a line feed, the text, `<|end|>` and a line feed. Every
assistant turn becomes an example of its own: all turns before it are its context, it is the last turn, and only
its text is under the loss mask (loss_start and loss_length, in characters of the example). Turns after the last reply,
which no reply's example holds, make one more example without a trainable part, so the output holds every turn.

Control strings inside roles and texts (the template's own and those of common other templates) are escaped reversibly: each
backslash is doubled, and `\!` is put behind the first character of each control string; in roles a line feed is `\n` as well.

An example's text is a prefix of the conversation's, cut after the conversation was exploded, so a task holds one example at a time.
A conversation is one row of its turns: it has to fit into a task's memory, like each of its examples.

Defined results: turns go by turn (nulls last), then role, then text; repeated rows are turns of their own; a null text or role is the
empty one; rows with a null conv_id are one conversation; a conversation without replies gives one example with an empty mask; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table


@dataclass(frozen=True)
class Template:
    """The strings around a turn, the role that is trained on, and other strings to escape. Each begins with < or [ and holds neither after that (<< may begin one)."""

    begin: str = "<|turn|>"
    end: str = "<|end|>"
    target: str = "assistant"
    escaped: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    @property
    def controls(self) -> str:
        """A pattern of the control strings: the first character and the rest as two groups."""
        found = sorted({s.lstrip("<") if s.startswith("<<") else s[1:] for s in (self.begin, self.end, *self.escaped)}, key=lambda s: (-len(s), s))
        return r"([<\[])(" + "|".join(re.escape(s) for s in found) + ")"


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), template.controls, r"$1\\!$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:!|(\\))", "$1")


def escape_role(role: Column, template: Template) -> Column:
    return F.replace(escape(role, template), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a doubled backslash before n is no line feed: line feeds are put back piece by piece between doubled ones
    return F.array_join(F.transform(F.split(role, r"\\\\"), lambda s: F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\!"), F.lit(""))), "\\")


def examples(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, example (from 0), n_turns, text, loss_start, loss_length, whole (it holds all turns) of turns (conv_id, turn, role, text)."""
    template = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = F.struct(F.isnull("turn").alias("late"), "turn", role.alias("role"), text.alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(body)).alias("turns"))
    head = lambda t: F.concat(F.lit(template.begin), escape_role(t["role"], template), F.lit("\n"))
    tail = template.end + "\n"
    rows = rows.select("conv_id", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"], template).alias("body"), (t["role"] == template.target).alias("reply"))).alias("turns"))
    # for each turn the characters up to the end of its text and of the turn
    sized = F.transform("turns", lambda t, i: F.struct((F.length(t["head"]) + F.length(t["body"]) + len(tail)).cast("long").alias("n"), F.length(t["body"]).cast("long").alias("body"), t["reply"].alias("reply"), (i + 1).alias("upto")))
    rows = rows.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("whole_"), F.size("turns").alias("size_"), sized.alias("sized"))
    # replies, and the last turn if it is none, each with the characters that its example takes
    fields = "sum BIGINT, list ARRAY<STRUCT<upto: INT, length: BIGINT, loss_start: BIGINT, loss_length: BIGINT>>"
    step = f"""aggregate(sized, CAST(named_struct('sum', 0L, 'list', array()) AS STRUCT<{fields}>), (a, t) -> CAST(named_struct('sum', a.sum + t.n, 'list',
        CASE WHEN t.reply OR t.upto = size_ THEN concat(a.list, array(named_struct('upto', t.upto, 'length', a.sum + t.n,
          'loss_start', a.sum + t.n - {len(tail)} - IF(t.reply, t.body, 0L), 'loss_length', IF(t.reply, t.body, 0L)))) ELSE a.list END) AS STRUCT<{fields}>), a -> a.list)"""
    cut = rows.select("conv_id", "whole_", "size_", F.posexplode(F.expr(step)).alias("example", "e"))
    return cut.select(
        "conv_id", "example", F.col("e.upto").alias("n_turns"), F.col("whole_").substr(F.lit(1), F.col("e.length").cast("int")).alias("text"),
        "e.loss_start", "e.loss_length", (F.col("e.upto") == F.col("size_")).alias("whole"),
    )


def parsed(text: Column, template: Template) -> Column:
    """role and text of each turn of an example's text."""
    turns = F.split(text, re.escape(template.end + "\n"))
    bare = F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: t.substr(F.lit(len(template.begin) + 1), F.length(t)))
    return F.transform(bare, lambda t: F.struct(unescape_role(F.substring_index(t, "\n", 1)).alias("role"), unescape(t.substr(F.instr(t, F.lit("\n")) + 1, F.length(t))).alias("text")))


def loss_text(template: Template | None = None) -> Column:
    """The text under an example's mask, as it was before it was escaped."""
    return unescape(F.col("text").substr((F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))


def digests(found: DataFrame, template: Template | None = None) -> DataFrame:
    """The contract's columns out of examples() alone: a row a conversation."""
    template = template or Template()
    turns = parsed(F.col("text"), template)
    read = found.select("conv_id", "example", F.length("text").cast("long").alias("chars"), loss_text(template).alias("loss"), F.when(F.col("whole"), turns).alias("turns"))
    told = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    read = read.select("conv_id", "example", "chars", "loss", F.size("turns").alias("n"), F.when(F.col("turns").isNotNull(), told).alias("sha"))
    rows = read.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The contract's own conversation, beside those of the table.
OWN = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(OWN, "conv_id long, turn long, role string, text string"))
    return digests(materialise(examples(turns), "chat-examples"))


_ESC = r"regexp_replace(replace({0}, '\', '\\'), '" + Template().controls.replace("{", "{{").replace("}", "}}") + r"', '\1\\!\2', 'g')"
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES {", ".join(f"({c}, {n}, '{r}', '{x}')" for c, n, r, x in OWN)})),
f AS (SELECT *, {len("<|turn|>") + 1 + len("<|end|>") + 1} + length(replace({_ESC.format("role")}, chr(10), '\\n')) + length({_ESC.format("text")}) AS chars,
  row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM f)
SELECT conv_id, any_value(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""
