"""Shared pieces: checkpoints, tiles for hot groups and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import remove, shared_folder

#: Rows of two or three numbers that a join may broadcast; with more it shuffles.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES: list[list[str]] = []


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, so that lost executors cost nothing."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    if _SCOPES:
        file = out._jdf.logicalPlan().rdd().getCheckpointFile()
        if file.isDefined():
            _SCOPES[-1].append(file.get())
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made inside are deleted at the end: what they led to must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.pop():
            remove(spark, folder)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds little; freed memory goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def size_of(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """Buckets of about ``rows_each`` rows for a table of this many rows."""
    return max(least, -(-df.count() // rows_each))


def running(counts: DataFrame, key: str, at: str, n: str, span: int = 1024) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over the smaller ``at`` of a key.

    In two levels, so that no task holds all rows of a key: sums within spans of ``at``, and of
    whole spans before.
    """
    counts = counts.withColumn("_span", F.floor(F.col(at) / span))
    upto = lambda w, by: w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy(key, "_span").agg(F.sum(n).alias("_n"))
    spans = spans.select(key, "_span", F.coalesce(F.sum("_n").over(upto(Window.partitionBy(key), "_span")), F.lit(0)).alias("_outside"))
    counts = counts.withColumn("_inside", F.coalesce(F.sum(n).over(upto(Window.partitionBy(key, "_span"), at)), F.lit(0)))
    return counts.join(spans, [key, "_span"]).withColumn("before", F.col("_inside") + F.col("_outside")).drop("_span", "_inside", "_outside")


def tiled(rows: DataFrame, key: str, member: Column, limit: int) -> DataFrame:
    """Split hot keys into tiles, so that no task gets an unbounded group.

    Adds ``tile``, ``tile_a`` and ``tile_b``.  A key of up to ``limit`` rows has the one
    tile 0.  A larger one has ceil(n / limit) tiles and each of its rows goes to every pair
    of tiles that contains its own: rows meet in exactly one (tile_a, tile_b), those of one
    tile where tile_a = tile_b.
    """
    hot = checkpoint(
        rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
        .select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_tiles"))
    )
    n_hot = hot.count()
    if not n_hot:
        return rows.withColumns({"tile": F.lit(0), "tile_a": F.lit(0), "tile_b": F.lit(0)})
    out = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, key, "left")
    out = out.withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    out = out.withColumn("tile", F.pmod(member, F.col("_tiles")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return out.withColumns({
        "tile_a": F.least("tile", "_other"), "tile_b": F.greatest("tile", "_other"),
    }).drop("_tiles", "_other")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (src, dst): the smallest node that it reaches.

    Alternating large and small stars.  Every step is a combinable minimum and an equi join,
    no neighbour list is gathered, and each round is checkpointed.  Nothing but a count and a
    checksum reaches the driver.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    e = checkpoint(e)
    before = None
    for _ in range(rounds):
        sym = both(e)
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            sym.filter(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.u", "x.v").filter(F.col("u") != F.col("v")).distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
