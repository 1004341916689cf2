"""Versions as keyed state: each new version of a document closes the one before it, late ones take their place between.

The state of a document is its versions that can still be closed anew. When versions come, those around them are told again which
version closes them: rows are numbered by document, and the last row of a version counts. A timer drops versions that lie behind the
watermark by `horizon`, but for the last of them, which the next version closes; so state is bounded by the horizon and not by the
stream. A version that comes later than that is dropped by the watermark.

Defined results: versions go by time, then by key; a repeated version changes nothing; null documents are one document;
moments up to 1970 are behind any watermark, so such versions are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .incremental import place

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "document string, version string, closed_by string, seq long"


class CloseVersions(StatefulProcessor):
    """Of rows (document, version, at, micros): which version closes which, again whenever that changes."""

    def __init__(self, horizon: timedelta):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "version string", "micros long")
        self.seq = handle.getValueState("seq", "seq long")

    def expiry(self, micros: int) -> int:
        """When a version lies behind the watermark by the horizon, in milliseconds."""
        return (micros + self.horizon // timedelta(microseconds=1)) // 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.open.iterator()}
        new = {}
        for row in rows:
            if row.version not in held:
                new[row.version] = held[row.version] = row.micros
        if not new:
            return
        order = sorted(held, key=lambda v: (held[v], v))
        seq = self.seq.get()[0] if self.seq.exists() else 0
        for k, version in enumerate(order):
            following = order[k + 1] if k + 1 < len(order) else None
            if version in new:
                self.open.updateValue((version,), (held[version],))
                self.handle.registerTimer(self.expiry(held[version]))
            if version in new or following in new:
                seq += 1
                yield Row(document=key[0], version=version, closed_by=following, seq=seq)
        self.seq.update((seq,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Of the versions that are behind, all but the last go."""
        upto = expiredTimerInfo.getExpiryTimeInMs()
        behind = sorted((v[0], k[0]) for k, v in self.open.iterator() if self.expiry(v[0]) <= upto)
        for _, version in behind[:-1]:
            self.open.removeKey((version,))
        return iter(())

    def close(self) -> None:
        pass


def closed_versions(stream: DataFrame, version: str, document: str, at: str, horizon: timedelta = timedelta(days=30), shape: str = "update") -> DataFrame:
    """document, version, closed_by of every version of a stream that runs until all is read; at: a timestamp."""
    spark: SparkSession = stream.sparkSession
    rows = stream.select(F.col(document).cast("string").alias("document"), F.col(version).cast("string").alias("version"), F.col(at).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", f"{int(horizon.total_seconds())} seconds")
    rows = rows.withColumn("micros", F.unix_micros("at"))
    told = rows.groupBy("document").transformWithState(CloseVersions(horizon), CLOSED, shape, "EventTime")
    out, state = place(spark, "closed-versions"), place(spark, "closed-versions-state")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        # a batch that is tried again writes the same folder
        told.writeStream.outputMode(shape).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.schema(CLOSED).parquet(out)
    return found.groupBy("document", "version").agg(F.max_by("closed_by", "seq").alias("closed_by"))
