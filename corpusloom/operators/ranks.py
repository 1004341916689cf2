"""Row numbers within groups of any size: rows are dealt out by ranges of (group, order), so a hot group spreads over tasks.

Each task numbers its own rows of a group; the numbers go on from the sum of the group's rows in earlier ranges, a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import held, stored


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with its rows' numbers from 1 in each group; order has to tell all rows of a group apart, nulls come first."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *by, *order).withColumn("range_", F.spark_partition_id())
    dealt = stored(dealt, "ranges")  # the ranges stay as they are, whatever is computed again
    own = F.row_number().over(Window.partitionBy("range_", *by).orderBy(*order))
    counts = dealt.groupBy("range_", *by).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held(counts.withColumn("before_", before).drop("n_"), "range-offsets").withColumnsRenamed({c: f"{c}_of" for c in ["range_", *by]})
    same = F.lit(True)
    for c in ["range_", *by]:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    return dealt.withColumn(name, own).join(offsets, same).withColumn(name, (F.col(name) + F.col("before_")).cast("long")).select(*df.columns, name)
