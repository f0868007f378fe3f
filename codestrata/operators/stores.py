"""Stores of scans and graphs by repository, in versions committed at once, and of vectors in partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knowledge
from .memory import read_repository
from .snapshots import Snapshots, with_ids

SCAN_FILE = ("path", "extension", "language", "size_bytes", "sha256", "modified_at")


def save_scan(files: DataFrame, directories: DataFrame, folder: str, repository: str) -> int:
    """Replace the stored scan of a repository by one commit: its record, directories and files.

    A repository keeps its number, and a file its id, from scan to scan.  Returns the version.
    """
    spark = files.sparkSession
    store = Snapshots(spark, f"{folder}/scans")
    former = store.manifest(repository)
    known = store.load(repository, former)["files"] if former else None
    record = spark.range(1).select(F.lit(store.repository_id(repository)).cast("long").alias("id"), F.lit(repository).alias("path"), F.current_timestamp().alias("scanned_at"))
    return store.save(repository, {
        "record": record, "directories": _unique(directories.select("path"), "path"), "files": with_ids(_unique(files.select(*SCAN_FILE), "path"), known, "path"),
    })


def load_scan(spark: SparkSession, folder: str, repository: str) -> dict[str, DataFrame]:
    """record, directories and files, by path; KeyError where the repository was not saved."""
    got = Snapshots(spark, f"{folder}/scans").load(repository)
    return {"record": got["record"], "directories": got["directories"].orderBy("path"), "files": got["files"].orderBy("path")}


def _unique(rows: DataFrame, *key: str) -> DataFrame:
    """The rows; ValueError if a key stands twice."""
    if not rows.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated key {list(key)}")
    return rows


def identifiers_only(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fail on labels and relationships that are more than letters and digits of any script and underscores, or these alone."""
    bad = lambda x: ~F.rlike(x, F.lit(r"^_*[\p{L}\p{N}][\p{L}\p{N}_]*\z"))
    label = F.array_join(F.filter("labels", bad), ",")
    nodes = nodes.withColumn("labels", F.when(F.exists("labels", bad), F.raise_error(F.concat(F.lit("bad label: "), label)).cast("array<string>")).otherwise(F.col("labels")))
    relationship = F.col("relationship")
    edges = edges.withColumn("relationship", F.when(bad(relationship), F.raise_error(F.concat(F.lit("bad relationship: "), relationship)).cast("string")).otherwise(relationship))
    return nodes, edges


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, repository: str, matched: bool = False) -> int:
    """Replace the stored graph of a repository, nodes and edges by one commit; ``matched`` leaves out edges without both nodes."""
    nodes, edges = identifiers_only(nodes, edges)
    if matched:
        edges = knowledge.matched_edges(nodes, edges)
    return Snapshots(nodes.sparkSession, f"{folder}/graphs").save(repository, {"nodes": _unique(nodes, "id"), "edges": _unique(edges, "source", "relationship", "target")})


def load_graph(spark: SparkSession, folder: str, repository: str) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by their ends; KeyError where the repository was not saved."""
    got = Snapshots(spark, f"{folder}/graphs").load(repository)
    return got["nodes"].orderBy("id"), got["edges"].orderBy("source", "relationship", "target")


def whole_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with those that only edges name, as a graph in memory makes them (no labels)."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.select("id", "labels").unionByName(ends.withColumn("labels", F.array().cast("array<string>")))


def load_vectors(spark: SparkSession, folder: str, repository: str) -> DataFrame:
    """Stored chunks with vectors by path and line; rows of older stores that lack content have an empty one."""
    rows = read_repository(spark, folder, repository, "path", "start_line")
    return rows.withColumn("content", F.coalesce("content", F.lit("")) if "content" in rows.columns else F.lit(""))


def write_both(live: Callable[[], bool], durable: Callable[[], bool], counts: Callable[[], dict]) -> dict:
    """Write to the live store, then to the durable one; counts come from the durable one."""
    first, second = live(), durable()
    return {**counts(), "persisted": bool(first and second)}
