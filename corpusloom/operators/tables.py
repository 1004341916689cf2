"""Tables of generations: folders of Parquet that are appended to as wholes and count once a manifest row names them.

A generation that was broken off has no manifest row, so no read sees it, and writing it again is harmless. Merging writes one
generation that replaces others; their files stay for readers that have begun, until vacuum().
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


#: Manifests as last read, by root: file names are unique, so the same files hold the same rows. The oldest goes when there are more than KEPT.
_SEEN: dict[str, tuple[tuple, list]] = {}
KEPT = 64


class Generations:
    """The manifest under root/manifest: generation, what (its numbers, by name), replaces, at (its place in the order of commits)."""

    SHAPE = "generation string, at long, replaces array<string>, what map<string,string>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def exists(self, path: str) -> bool:
        found = self._path(path)
        return found.getFileSystem(self._conf).exists(found)

    def committed(self) -> list:
        """The rows of generations that count, in order; merged ones are few, so the list is short."""
        rows = self._manifest()
        gone = {g for r in rows for g in r.replaces}
        return [r for r in rows if r.generation not in gone]

    def _manifest(self) -> list:
        """All rows in order; they are read again when there are other files."""
        path = self._path(f"{self.root}/manifest")
        store = path.getFileSystem(self._conf)
        files = tuple(sorted(s.getPath().getName() for s in store.listStatus(path))) if store.exists(path) else ()
        if files and _SEEN.get(self.root, ((),))[0] != files:
            _SEEN[self.root] = files, self.spark.read.schema(self.SHAPE).parquet(f"{self.root}/manifest").orderBy("at").collect()
            while len(_SEEN) > KEPT:
                _SEEN.pop(next(iter(_SEEN)))
        return _SEEN[self.root][1] if files else []

    def fresh(self) -> str:
        return f"g{uuid.uuid4().hex}"

    def commit(self, generation: str, what: dict, replaces: list[str] = ()) -> None:
        at = 1 + max((r.at for r in self._manifest()), default=-1)
        row = [(generation, at, list(replaces), {k: str(v) for k, v in what.items()})]
        self.spark.createDataFrame(row, self.SHAPE).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def path(self, generation: str, part: str) -> str:
        return f"{self.root}/{part}/generation={generation}"

    def read(self, part: str, schema: str, generations: list[str] | None = None) -> DataFrame:
        """The rows of a part of all generations that count, with their generation; schema: of its files."""
        names, schema = [r.generation for r in self.committed()] if generations is None else generations, f"{schema}, generation string"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{part}").parquet(*[self.path(g, part) for g in names])

    def vacuum(self) -> None:
        """Delete the files of generations that don't count."""
        keep = {g for r in self.committed() for g in (r.generation, r.what.get("pivots"))}  # pivots lie where they were chosen
        root = self._path(self.root)
        store = root.getFileSystem(self._conf)
        for part in store.listStatus(root) if store.exists(root) else []:
            for status in store.listStatus(part.getPath()) if part.isDirectory() else []:
                name = status.getPath().getName()
                if name.startswith("generation=") and name.removeprefix("generation=") not in keep:
                    store.delete(status.getPath(), True)


def kept_root(spark: SparkSession, table: str, name: str) -> str:
    """A folder in the shared one for what is derived from a table's files, another one once these change."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = store.getContentSummary(path)
    seen = f"{table}:{summary.getLength()}:{summary.getFileCount()}:{store.getFileStatus(path).getModificationTime()}"
    return f"{shared_dir(spark)}/{name}-{hashlib.sha256(seen.encode()).hexdigest()[:24]}"
