"""Reading source trees: a data source that lists every file, archives, and import rules.

Spark's own file sources hide names that begin with ``_`` or ``.``, so a tree is walked by a
Python data source: one partition for each top-level entry, so that executors share the walk.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X

# Folders that a scan leaves out.
IGNORED = (
    ".git", "node_modules", "venv", ".venv", ".venv313", "target", "dist", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", "build", ".next", ".nuxt", "coverage", ".cache", "tmp", "egg-info", ".eggs",
)
# Languages for scans, in the alphabetical order of the extensions.
LANGUAGES = {
    ".c": "C", ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".go": "Go", ".h": "C", ".hpp": "C++", ".java": "Java",
    ".js": "JavaScript", ".jsx": "JavaScript", ".py": "Python", ".rs": "Rust", ".ts": "TypeScript", ".tsx": "TypeScript",
}
MAX_ARCHIVE, MAX_UNPACKED = 100 * 1024 * 1024, 1 << 30
#: Input partitions of a folder or an archive, unless these become smaller or larger than the bytes given.
PARTS, MIN_PART, MAX_PART, OPEN_BYTES = 64, 1 << 18, 1 << 25, 1 << 12

FILE = "path string, is_dir boolean, size_bytes long, modified_at timestamp, content binary"


class _Part(InputPartition):
    """Entries (path, is_dir) of a folder, or members of an archive by their places."""

    def __init__(self, names: list, archive: str | None = None):
        self.names, self.archive = names, archive


def _even(entries: list[tuple[object, int]], parts: int) -> Iterator[list]:
    """Entries with their bytes in about this many runs of about equal bytes, in their order; each weighs OPEN_BYTES at least."""
    whole = sum(max(n, OPEN_BYTES) for _, n in entries)
    most = min(MAX_PART, max(MIN_PART, -(-whole // parts)))
    run, held = [], 0
    for entry, n in entries:
        n = max(n, OPEN_BYTES)
        if run and held + n / 2 > most:
            yield run
            run, held = [], 0
        run.append(entry)
        held += n
    if run:
        yield run


class _Reader(DataSourceReader):
    """Names and sizes are listed first; tasks read files of about equal bytes, whatever folder they lie in."""

    def __init__(self, root: str, ignored: frozenset, parts: int):
        if not os.path.isdir(root):
            raise ValueError(f"not a directory: {root}")
        self.root, self.ignored, self.parts = root, ignored, parts

    def entries(self) -> Iterator[tuple[tuple[str, bool], int]]:
        for folder, dirs, files in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.ignored and not os.path.islink(os.path.join(folder, d)))
            inside = os.path.relpath(folder, self.root).replace(os.sep, "/")
            if inside != ".":
                yield (inside, True), 0
            for name in sorted(files):
                full = os.path.join(folder, name)
                if os.path.isfile(full) and not os.path.islink(full):
                    yield (name if inside == "." else f"{inside}/{name}", False), os.path.getsize(full)

    def partitions(self):
        return [_Part(names) for names in _even(list(self.entries()), self.parts)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, is_dir in partition.names:
            if is_dir:
                yield path, True, None, None, None
                continue
            full = os.path.join(self.root, path)
            info = os.stat(full)
            with open(full, "rb") as f:
                content = f.read()
            yield path, False, info.st_size, datetime.fromtimestamp(info.st_mtime, timezone.utc), content


class _ArchiveReader(DataSourceReader):
    """The central directories are read and judged first; tasks unpack members of about equal bytes."""

    def __init__(self, path: str, parts: int, packed: int, unpacked: int):
        self.path, self.parts, self.packed, self.unpacked = path, parts, packed, unpacked

    def partitions(self):
        store, root = _store(self.path)
        infos = store.get_file_info(FileSelector(root, recursive=False)) if store.get_file_info(root).type == FileType.Directory else [store.get_file_info(root)]
        out = []
        for info in sorted(infos, key=lambda i: i.path):
            if info.type != FileType.File or not info.path.lower().endswith(".zip"):
                continue
            if info.size > self.packed:
                raise ValueError(f"archive too large: {info.path}")
            with store.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
                members = [(k, m) for k, m in enumerate(z.infolist()) if not m.is_dir()]
            for _, m in members:
                if _unsafe(m.filename):
                    raise ValueError(f"unsafe archive member: {m.filename}")
            if sum(m.file_size for _, m in members) > self.unpacked:
                raise ValueError(f"archive too large when unpacked: {info.path}")
            out += [_Part(run, info.path) for run in _even([(k, m.file_size) for k, m in members], self.parts)]
        return out or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.names:
            return
        with _store(self.path)[0].open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            infos = z.infolist()
            for k in partition.names:
                with z.open(infos[k]) as member:
                    content = member.read(infos[k].file_size + 1)
                if len(content) != infos[k].file_size:
                    raise ValueError(f"archive member is not of its stated size: {infos[k].filename}")
                yield partition.archive, infos[k].filename, content


def _store(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _unsafe(name: str) -> bool:
    return name.startswith(("/", "\\")) or re.match("[A-Za-z]:", name) is not None or ".." in re.split(r"[/\\]", name)


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(a .zip file, or a folder of them)"""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], int(self.options.get("parts", PARTS)), int(self.options.get("max_archive", MAX_ARCHIVE)), int(self.options.get("max_unpacked", MAX_UNPACKED)))


class RepositorySource(DataSource):
    """spark.read.format("repository").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], frozenset(IGNORED), int(self.options.get("parts", PARTS)))


def language(path: Column) -> Column:
    ext = X.suffix(path)
    out = None
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name) if out is None else out.when(ext == e, name)
    return out


def scan(spark: SparkSession, folder: str, parts: int = PARTS) -> DataFrame:
    """Files and folders: path, is_dir, extension, language, size_bytes, sha256, modified_at, content, file_ord."""
    spark.dataSource.register(RepositorySource)
    return describe(spark.read.format("repository").option("parts", parts).load(folder))


def describe(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumns({
        "extension": F.when(~F.col("is_dir"), X.suffix(path)), "language": F.when(~F.col("is_dir"), language(path)),
        "sha256": F.sha2("content", 256), "file_ord": X.file_order(path),
    })


def from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Files given as (path, text), as ``scan`` would list them."""
    df = spark.createDataFrame(rows, "path string, text string")
    content = F.col("text").cast("binary")
    return describe(df.select("path", F.lit(False).alias("is_dir"), F.octet_length(content).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_at"), content.alias("content")))


def read_text(files: DataFrame, mode: str = "strict") -> DataFrame:
    """Adds ``text``.  strict: null where not UTF-8; replace: U+FFFD for bad bytes; ignore: without them."""
    raw = F.col("content").cast("string")
    if mode == "strict":
        return files.withColumn("text", F.when(F.is_valid_utf8(raw), raw))
    text = F.make_valid_utf8(raw)
    return files.withColumn("text", text if mode == "replace" else F.replace(text, F.lit("\ufffd"), F.lit("")))


def directories(files: DataFrame) -> DataFrame:
    """Every folder that some file lies in."""
    p = X.parts(F.col("path"))
    each = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.array_join(F.slice(p, 1, k), "/"))
    return files.filter(F.size(p) > 1).select(F.explode(each).alias("path")).distinct()


def safe_member(name: Column) -> Column:
    """Whether an archive member stays inside its folder."""
    return ~F.startswith(name, F.lit("/")) & ~F.startswith(name, F.lit("\\")) & ~F.rlike(name, F.lit("^[A-Za-z]:")) & ~F.array_contains(F.split(name, r"[/\\]", -1), "..")


def read_zip(spark: SparkSession, path: str, parts: int = PARTS, max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """(archive, path, content) of the members of a .zip file, or of those of a folder.

    An archive over MAX_ARCHIVE bytes, or over ``max_unpacked`` by its directory, or with a member
    that leaves its folder, is an error before anything is unpacked.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(parts=parts, max_archive=MAX_ARCHIVE, max_unpacked=max_unpacked).load(path)


def github_url(url: Column) -> Column:
    """The clone address of an https address of one repository on the host github.com; else null."""
    m = r"^https://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
    owner, name = F.regexp_extract(url, m, 1), F.regexp_extract(url, m, 2)
    return F.when((owner != "") & (name != ""), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit(".git")))


def safe_name(name: Column) -> Column:
    """A folder name from an archive or repository name."""
    clean = F.regexp_replace(X.stem(name), "[^A-Za-z0-9_.-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^[.-]+|[.-]+$", ""), F.lit("")), F.lit("repository"))
