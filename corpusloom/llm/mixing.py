"""Mixing sources to target weights by hierarchical budgeting, DataFrame functions only.

A token budget is handed down a tree, domain, language, source. At each node the budget goes to
the children by weight, but no child gets more than the tokens below it times the epochs allowed:
what a child can't use is shared among its siblings by weight (water-filling), and since a
node's own cap is the sum of its children's, a shortage reaches the ancestors' level only when
the siblings are full. Each leaf then takes whole epochs and, in one more epoch, the longest
prefix of its documents, in that epoch's seeded order, whose tokens fit.

The order of a hot leaf is never sorted in one task: tokens are summed by leaf and the leading
digits of the order's hash; the range in which the budget ends is cut into ranges by the next digits, and so on; only
the last such range is ordered by row, one in 16 to the power digits * steps of the leaf. What
is joined to the documents is a row a leaf, with the hash at which its prefix ends.

The tree's top level is the caller's: `domains` names the domain of each source. `documents` has no such column,
so the query takes a stand-in, by a hash of the source's name.

Tokens are counted as a quarter of the UTF-8 bytes, rounded up. Defined results: a null text has no
tokens; null languages and sources are the label ''; rows that share a doc_id stand or fall
together; a leaf without tokens, or of weight zero, gets no quota; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

LEVELS = ("domain", "language", "source")
#: Leaves up to this number go to every task; more are joined by shuffles, with hot leaves salted.
BROADCAST_LEAVES, SALTS = 20_000, 32


@dataclass(frozen=True)
class Mixture:
    """share: of all tokens; weights: by level and label, 1 where unnamed; domains: of each source (others are in ''), or None
    for the stand-in; digits: of the hash by which a range is cut in each of so many steps."""

    share: float = 0.5
    epochs: int = 2
    seed: int = 17
    digits: int = 2
    steps: int = 3
    domains: dict[str, str] | None = None
    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {"domain": {"web": 5, "books": 3, "reference": 2}, "language": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {}}
    )


def domain_of(source: Column, domains: dict[str, str] | None) -> Column:
    """The domain that the mapping names; the stand-in goes by the first hex digit of the source's MD5."""
    if domains is not None:
        out = F.lit("")
        for name, domain in domains.items():
            out = F.when(source == name, domain).otherwise(out)
        return out
    digit = F.substring(F.md5(source.cast("binary")), 1, 1)
    return F.when(digit < "6", "web").when(digit < "b", "books").otherwise("reference")


def labelled(docs: DataFrame, plan: Mixture) -> DataFrame:
    """docs as one struct `row_`, with the tree's labels and the tokens."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row_"),
        domain_of(source, plan.domains).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("language"),
        source.alias("source"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_"),
        F.ceil(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) / 4).alias("tokens"),
    )


def weight(plan: Mixture, level: str) -> Column:
    out = F.lit(1)
    for label, value in plan.weights.get(level, {}).items():
        out = F.when(F.col(level) == label, value).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """quota of each child: nodes has the parents' `budget`, the child's `cap` and `weight`."""
    within = Window.partitionBy(*parents)
    order = within.orderBy("fullness", name)
    return (
        nodes.where("weight > 0 AND cap > 0")
        .withColumn("fullness", F.col("cap") / F.col("weight"))
        .withColumn("taken", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("taken")) / F.col("left"))
        .withColumn("rank", F.when(F.col("fullness") > F.col("level"), F.row_number().over(order)))
        .withColumn("line", F.first("level").over(within.orderBy(F.col("rank").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("quota", F.when(F.col("rank").isNull(), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("line")))
        .drop("fullness", "taken", "left", "level", "rank", "line")
    )


def quotas(rows: DataFrame, plan: Mixture) -> DataFrame:
    """A row a leaf: its labels, supply, quota, full epochs and the tokens of the last, partial one."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")).withColumn("cap", F.col("supply") * plan.epochs)
    above = leaves.agg(F.floor(F.sum("supply") * plan.share).cast("double").alias("budget"))
    for k, level in enumerate(LEVELS):
        parents = list(LEVELS[:k])
        nodes = leaves.groupBy(*LEVELS[: k + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", weight(plan, level))
        nodes = nodes.join(above, parents) if parents else nodes.crossJoin(above)  # above is one row there
        filled = fill(nodes, parents, level)
        above = filled.select(*LEVELS[: k + 1], F.col("quota").alias("budget"))
    return (
        leaves.join(above, list(LEVELS))
        .withColumn("quota", F.floor(F.col("budget") + 1e-6).cast("long"))
        .withColumn("full", F.expr("quota DIV supply"))
        .withColumn("rest", F.expr("quota - full * supply"))
        .select(*LEVELS, "supply", "quota", "full", "rest")
    )


def order_hash(plan: Mixture, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{plan.seed}:"), epoch.cast("string"), F.lit(":"), F.col("id_")).cast("binary"))


def with_leaves(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows, each beside its leaf's row; leaves is a stored table."""
    if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(leaves), list(LEVELS))
    salted = leaves.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id_" if "id_" in rows.columns else "hash", "tokens"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt_", salt).join(salted, [*LEVELS, "salt_"]).drop("salt_")


def cutoffs(rows: DataFrame, plan: Mixture) -> DataFrame:
    """quotas() and, for each leaf, the order hash at which its prefix in the partial epoch ends (null: it takes none)."""
    rows = materialise(rows.select(*LEVELS, "id_", "tokens"), "mixing-tokens")
    found = materialise(quotas(rows, plan), "quotas")
    keyed = with_leaves(rows, found.select(*LEVELS, "full")).withColumn("hash", order_hash(plan, F.col("full"))).drop("full", "id_")
    # of each leaf the one range in which the budget ends, and the tokens before it
    border = found.select(*LEVELS, "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    ends = None
    for step in range(plan.steps + 1):
        inside = with_border(keyed, border)
        if step < plan.steps:  # cut into finer ranges
            inside = inside.withColumn("range", F.substring("hash", 1, plan.digits * (step + 1))).groupBy(*LEVELS, "rest", "before", "range").agg(F.sum("tokens").alias("tokens"), F.max("hash").alias("last"))
            order = Window.partitionBy(*LEVELS).orderBy("range")
        else:
            inside = inside.withColumn("last", F.col("hash"))
            order = Window.partitionBy(*LEVELS).orderBy("hash").rangeBetween(Window.unboundedPreceding, 0)
        ranges = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(order))
        if step < plan.steps:
            ranges = materialise(ranges, "mixing-ranges")
            border = ranges.where("upto > rest AND upto - tokens <= rest").select(*LEVELS, "rest", F.col("range").alias("prefix"), (F.col("upto") - F.col("tokens")).alias("before"))
        whole = ranges.where("upto <= rest").groupBy(*LEVELS).agg(F.max("last").alias("cutoff"))
        ends = whole if ends is None else ends.unionByName(whole)
    return found.join(ends.groupBy(*LEVELS).agg(F.max("cutoff").alias("cutoff")), list(LEVELS), "left")


def with_border(keyed: DataFrame, border: DataFrame) -> DataFrame:
    """The rows in the range of their leaf that border names."""
    return with_leaves(keyed, border).where(F.col("hash").startswith(F.col("prefix"))).drop("prefix")


def mix(docs: DataFrame, plan: Mixture | None = None) -> DataFrame:
    """Each chosen row as struct `row_`, its labels, tokens, and in how many epochs it is taken (copies)."""
    plan = plan or Mixture()
    rows = labelled(docs, plan)
    taken = F.col("hash") <= F.col("cutoff")
    return (
        with_leaves(rows, materialise(cutoffs(rows, plan).drop("supply", "rest"), "cutoffs"))
        .withColumn("hash", order_hash(plan, F.col("full")))
        .withColumn("copies", F.col("full") + F.when(taken, 1).otherwise(0))
        .where("copies > 0")
        .select("row_", *LEVELS, "tokens", "quota", "copies")
    )


def mixed_rows(docs: DataFrame, plan: Mixture | None = None) -> DataFrame:
    """The chosen rows with the columns of docs, once for each epoch that takes them."""
    return mix(docs, plan).select("row_", F.explode(F.expr("sequence(1, CAST(copies AS INT))")).alias("epoch_")).select("row_.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("row_.doc_id").alias("doc_id"), *LEVELS, "tokens", "quota", "copies")


def _fill_sql(out: str, nodes: str, parents: str, name: str) -> str:
    part = f"PARTITION BY {parents}" if parents else ""
    keys = f"{parents}, {name}" if parents else name
    return f"""
{out}a AS (SELECT *, cap / weight AS fullness FROM ({nodes}) WHERE weight > 0 AND cap > 0),
{out}b AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining, row_number() OVER w AS rk
  FROM {out}a WINDOW w AS ({part} ORDER BY fullness, {name})),
{out}c AS (SELECT *, (budget - CAST(taken AS DOUBLE)) / CAST(remaining AS DOUBLE) AS lvl FROM {out}b),
{out}d AS (SELECT *, min(CASE WHEN fullness > lvl THEN rk END) OVER ({part}) AS first_open FROM {out}c),
{out}e AS (SELECT *, max(CASE WHEN rk = first_open THEN lvl END) OVER ({part}) AS line FROM {out}d),
{out} AS (SELECT {keys}, CASE WHEN fullness > lvl THEN weight * line ELSE CAST(cap AS DOUBLE) END AS budget FROM {out}e)"""


def _weight_sql(plan: Mixture, level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in plan.weights.get(level, {}).items())
    return f"(CASE {level} {cases} ELSE 1 END)" if cases else "1"


def oracle(plan: Mixture | None = None) -> str:
    plan = plan or Mixture()
    d, ln, s = (_weight_sql(plan, level) for level in LEVELS)
    return f"""
WITH r AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '6' THEN 'web' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'b' THEN 'books' ELSE 'reference' END AS domain,
  coalesce(lang, '') AS language, coalesce(source, '') AS source, CAST((strlen(coalesce(text, '')) + 3) // 4 AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, language, source, CAST(sum(tokens) AS BIGINT) AS supply, CAST(sum(tokens) * {plan.epochs} AS BIGINT) AS cap FROM r GROUP BY ALL),
root AS (SELECT floor(sum(supply) * {plan.share}) AS budget FROM leaf),
{_fill_sql("f1", f"SELECT domain, sum(cap) AS cap, {d} AS weight, any_value(budget) AS budget FROM leaf, root GROUP BY domain", "", "domain")},
{_fill_sql("f2", f"SELECT domain, language, sum(cap) AS cap, {ln} AS weight, any_value(budget) AS budget FROM leaf JOIN f1 USING (domain) GROUP BY domain, language", "domain", "language")},
{_fill_sql("f3", f"SELECT domain, language, source, cap, {s} AS weight, budget FROM leaf JOIN f2 USING (domain, language)", "domain, language", "source")},
q AS (SELECT domain, language, source, supply, CAST(floor(budget + 1e-6) AS BIGINT) AS quota FROM leaf JOIN f3 USING (domain, language, source)),
o AS (SELECT r.*, quota, quota // supply AS full_epochs, quota % supply AS rest, md5('{plan.seed}:' || (quota // supply) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM r JOIN q USING (domain, language, source)),
c AS (SELECT *, full_epochs + CASE WHEN sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY h RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, domain, language, source, tokens, quota, CAST(copies AS BIGINT) AS copies FROM c WHERE copies > 0"""
