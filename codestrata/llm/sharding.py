"""Sharding by rendezvous hashing of record keys over weighted shards.

Each shard scores a key with -weight / ln(u), u being the hash of (key, shard) as a number
between 0 and 1; the highest score wins.  Adding a shard moves only the rows that it wins.
Slots number the rows of a shard from 0 without gaps: rows are numbered within small
buckets of a shard by key and text, and bucket sizes are summed up in two levels, so that no
task holds a shard, nor all rows of a key.

Defined cases: a null key hashes like any other value; a null text has no bytes; rows of one
key share a shard and get a slot each, in no defined order among equal rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, running, size_of, table

BUCKET_ROWS = 8_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    # 53 bits of the hash, moved off 0 and 1
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    scores = [F.struct((F.lit(-float(w)) / F.ln(unit(k))).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights)]
    return F.array_max(F.array(*scores))["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (and grown_shard under the weights ``grown``)."""
    n = F.lit(size_of(docs, bucket_rows))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    cols = {"size": size, "text_crc32": crc, "shard": rendezvous(F.col("doc_id"), weights), "_bucket": F.pmod(F.xxhash64("doc_id", crc, size, F.lit("slot")), n)}
    if grown:
        cols["grown_shard"] = rendezvous(F.col("doc_id"), grown)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns(cols).drop("text")
    counts = checkpoint(rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")))
    counts = running(counts, "shard", "_bucket", "_n").drop("_n")
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("_row", F.row_number().over(within))
    return (
        rows.join(counts, ["shard", "_bucket"])
        .withColumn("slot", (F.col("before") + F.col("_row") - 1).cast("long")).drop("_bucket", "_row", "before")
    )


def op8_rendezvous_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))
