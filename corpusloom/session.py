"""Session defaults for tests, the bench and notebooks; a cluster's own settings win."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession


def session(name: str = "corpusloom", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of this machine only where that is unset and Spark runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store's scheme, so that pyarrow in a task means what Spark means."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toUri()
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()


@lru_cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
