"""Versions of the tables of a repository, each committed at once, and an index that follows changes.

A version is a manifest: a small file that names the folders of its tables.  Tables are written
first, each into a new folder, and the manifest is moved into its numbered place last; readers
take the greatest number.  A writer that stops before leaves folders that nobody reads, and the
former version stays whole.  Two writers after the same version cannot both commit.

Tables of an index grow by segments: a version writes rows of changed files only, and its table
``files`` (path, sha256, segment) tells which rows of which segment live.  Beyond ``MOST_SEGMENTS``
the live rows are written together anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import remove

MOST_SEGMENTS = 16


class Conflict(RuntimeError):
    """Another writer committed first."""


class Snapshots:
    """Versioned tables below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), max(1, keep)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _place(self, name: str, text: str) -> bool:
        """Write a small file that was not there, by one rename; whether it is ours."""
        at, new = self._path(name), self._path(f"{self.folder}/_new/{uuid.uuid4().hex}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(new, False)
        out.write(bytearray(text.encode()))
        out.close()
        placed = not self._fs.exists(at) and self._fs.rename(new, at)
        if not placed:
            self._fs.delete(new, False)
        return placed

    def home(self, repository: str) -> str:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.folder}/{escape(repository)}"

    def repository_id(self, repository: str) -> int:
        """The number of a repository: 1, 2, ... in the order in which they came, the same at every scan."""
        while True:
            names = self._names(f"{self.folder}/_ids")
            for name in names:
                if self._read(f"{self.folder}/_ids/{name}") == repository:
                    return int(name)
            n = int(names[-1]) + 1 if names else 1
            if self._place(f"{self.folder}/_ids/{n:012}", repository):
                return n

    def manifest(self, repository: str) -> dict | None:
        """The current version: its number and the folders of its tables; None before the first."""
        names = self._names(f"{self.home(repository)}/versions")
        return json.loads(self._read(f"{self.home(repository)}/versions/{names[-1]}")) if names else None

    def stage(self, repository: str, name: str, table: DataFrame) -> str:
        """Write a table that no version names yet."""
        at = f"{self.home(repository)}/data/{uuid.uuid4().hex}-{name}"
        table.write.parquet(at)
        return at

    def commit(self, repository: str, tables: dict[str, list[str]], after: dict | None) -> int:
        """Make staged folders the version after ``after``; folders that no kept version names are removed."""
        n = after["version"] + 1 if after else 1
        if not self._place(f"{self.home(repository)}/versions/{n:012}", json.dumps({"version": n, "tables": tables})):
            raise Conflict(f"version {n} of {repository} is there already")
        versions = self._names(f"{self.home(repository)}/versions")
        used = {f for v in versions[-self.keep:] for folders in json.loads(self._read(f"{self.home(repository)}/versions/{v}"))["tables"].values() for f in folders}
        for old in versions[: -self.keep]:
            for folders in json.loads(self._read(f"{self.home(repository)}/versions/{old}"))["tables"].values():
                for folder in folders:
                    if folder not in used:
                        remove(self.spark, folder)
            remove(self.spark, f"{self.home(repository)}/versions/{old}")
        return n

    def save(self, repository: str, tables: dict[str, DataFrame]) -> int:
        """Replace all tables of a repository by one commit."""
        before = self.manifest(repository)
        return self.commit(repository, {name: [self.stage(repository, name, t)] for name, t in tables.items()}, before)

    def load(self, repository: str, manifest: dict | None = None) -> dict[str, DataFrame]:
        """The tables of the current version, or of a given one; KeyError before the first."""
        manifest = manifest or self.manifest(repository)
        if manifest is None:
            raise KeyError(repository)
        return {name: self.spark.read.parquet(*folders) for name, folders in manifest["tables"].items()}


def with_ids(rows: DataFrame, former: DataFrame | None, key: str) -> DataFrame:
    """Adds ``id``: that of the same key in the former table, else one above all of its ids."""
    if former is None:
        return rows.withColumn("id", F.monotonically_increasing_id() + 1)
    top = former.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    out = rows.join(former.select(key, "id"), key, "left")
    return out.withColumn("id", F.coalesce("id", F.monotonically_increasing_id() + (top + 1)))


def reindex(store: Snapshots, repository: str, files: DataFrame, make) -> dict[str, int]:
    """Bring an index up to date with files (path, sha256, text); only changed ones are made anew.

    ``make(changed)`` returns tables with a column path, such as parsed files and chunks with
    vectors.  Returns the version and its numbers of files, changed and gone ones.
    """
    before = store.manifest(repository)
    former = store.load(repository, before)["files"] if before else None
    now = files.select("path", "sha256")
    if former is None:
        changed, kept, gone = files, None, 0
    else:
        kept = former.join(now, ["path", "sha256"], "left_semi")
        changed = files.join(former, ["path", "sha256"], "left_anti")
        gone = former.join(now, "path", "left_anti").count()
    segment = before["version"] + 1 if before else 1
    mark = F.lit(segment).cast("long").alias("segment")
    made = changed.select("path", "sha256", mark)
    tables = {"files": [store.stage(repository, "files", made if kept is None else kept.unionByName(made))]}
    alive = store.spark.read.parquet(*tables["files"])
    n_changed = alive.filter(F.col("segment") == segment).count()
    compact = before and max(len(f) for f in before["tables"].values()) >= MOST_SEGMENTS
    for name, table in make(changed).items():
        new = table.withColumn("segment", mark)
        old = before["tables"].get(name, []) if before else []
        if compact:  # live rows of all segments and the new ones in one folder
            rows = store.spark.read.parquet(*old).join(alive.filter(F.col("segment") < segment).select("path", "segment"), ["path", "segment"], "left_semi")
            tables[name] = [store.stage(repository, name, rows.unionByName(new))]
        else:
            tables[name] = [*old, *([store.stage(repository, name, new)] if n_changed or not old else [])]
    store.commit(repository, tables, before)
    return {"version": segment, "files": alive.count(), "changed": n_changed, "gone": gone}


def live(store: Snapshots, repository: str, name: str) -> DataFrame:
    """The live rows of a table of the index, with the version (segment) that wrote them."""
    tables = store.load(repository)
    return tables[name].join(tables["files"].select("path", "segment"), ["path", "segment"], "left_semi")
