"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks.  With weight w, block j has release time
floor(j / w) and deadline ceil((j + 1) / w); in each slot the released block of earliest
deadline runs, so that at any time every source is less than one block from its share.
Release and deadline come from the exact weights over the whole schedule, in whole numbers,
so that no rounding adds up.  One task makes the schedule, a row a block, and holds one row a
source; slots that no released block wants (a source has run out) stay empty.  All rows are
kept, each once.

Blocks number the rows of a source by a hash of doc_id and text: rows are counted in small
buckets of a source and block numbers run on across the buckets, in two levels, so no task
holds a source, nor all rows of an id.

Defined cases: null sources are a source of their own; null doc_id and text are kept;
repeated rows count each; without given weights a source's target is its share of rows; the
blocks of a source of no weight come after all others, so that no row is lost; weights of
sources that are not there are left out; extra columns are kept.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, running, table

BLOCK_ROWS = 64
BUCKET_ROWS = 1_000
FILE_ROWS = 20_000


def exact_weights(targets: Mapping) -> dict:
    """Weights as whole numbers, in proportion."""
    exact = {n: Fraction(targets[n]) for n in sorted(targets, key=lambda n: (n is not None, n))}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights must not be negative")
    scale = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    return {n: int(w * scale) for n, w in exact.items()}


def schedule(weights: Mapping, blocks: Mapping) -> Iterator[tuple]:
    """(source, block, release, deadline, slot) of every block, by earliest deadline among released ones.

    Sources of weight 0 follow when no other block is left, each block in a window of its own.
    """
    total = sum(weights.values())
    order = [n for n, w in weights.items() if w]
    release = lambda k, j: j * total // weights[order[k]]
    waiting = [(0, k, 0) for k, n in enumerate(order) if blocks[n]]
    ready, t = [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            at, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[order[k]]), k, j, at))
        deadline, k, j, at = heapq.heappop(ready)
        yield order[k], j, at, deadline, t
        t += 1
        if j + 1 < blocks[order[k]]:
            heapq.heappush(waiting, (release(k, j + 1), k, j + 1))
    for name in (n for n, w in weights.items() if not w):
        for j in range(blocks[name]):
            yield name, j, t, t + 1, t
            t += 1


def _key(source: str | None) -> str:
    return "n" if source is None else f"s{source}"


def mix(docs: DataFrame, weights: Mapping | None = None, power: float = 1.0, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, place (within the block) and ``row`` (all columns).

    Without ``weights`` the target weight of a source is its number of rows to this power.
    """
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    base = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", text).alias("h"))
    n_buckets = max(1, -(-docs.count() // bucket_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {None if k == "n" else k[1:]: int(n) for part in batches for k, n in zip(part["key"], part["n"])}
        targets = {n: float(c**power if weights is None else weights.get(n, 0)) for n, c in counts.items()}
        if targets and not sum(targets.values()):
            targets = dict.fromkeys(targets, 1.0)
        made = ((_key(n), *rest) for n, *rest in schedule(exact_weights(targets), {n: -(-c // block_rows) for n, c in counts.items()}))
        while part := list(itertools.islice(made, 10_000)):
            yield pd.DataFrame(part, columns=["key", "block", "release", "deadline", "slot"])

    rows = base.withColumns({
        "key": F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")),
        "bucket": F.pmod(F.xxhash64("h", F.lit("mix")), F.lit(n_buckets)),
    })
    counts = checkpoint(rows.groupBy("key", "bucket").agg(F.count("*").alias("n")))  # one scan for sources, buckets and sums
    plan = counts.groupBy("key").agg(F.sum("n").alias("n")).repartition(1).mapInPandas(run, "key string, block long, release long, deadline long, slot long")
    sums = running(counts, "key", "bucket", "n")
    # the blocks of each bucket meet their slots here, so that no row moves for it
    spans = sums.withColumn("block", F.explode(F.sequence(F.floor(F.col("before") / block_rows), F.floor((F.col("before") + F.col("n") - 1) / block_rows))))
    sums = spans.join(plan, ["key", "block"]).groupBy("key", "bucket", "before").agg(F.array_sort(F.collect_list(F.struct("block", "release", "deadline", "slot"))).alias("slots"))
    within = Window.partitionBy("key", "bucket").orderBy(F.xxhash64("h", F.lit("place")), "doc_id")
    rows = rows.withColumn("nth", F.row_number().over(within))
    rows = rows.join(sums, ["key", "bucket"])
    at = F.col("before") + F.col("nth") - 1
    rows = rows.withColumns({"block": F.floor(at / block_rows), "place": (at % block_rows).cast("int")})
    rows = rows.withColumn("of", F.get("slots", (F.col("block") - F.floor(F.col("before") / block_rows)).cast("int")))
    return rows.select("doc_id", "source", "block", "of.release", "of.deadline", "of.slot", "place", "row")


#: Share of a source in the mix: its rows to this power, so that large sources do not drown small ones.
TEMPERATURE = 0.7


def op5_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text"))
    return mix(docs, power=TEMPERATURE).drop("row")


def mixed_documents(docs: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """Pipeline stage: the documents in the order of the schedule, with their columns.

    Rows and, as they are written, files follow the schedule; ``in_written_order`` brings them back.
    """
    n = max(1, -(-docs.count() // file_rows))
    return mix(docs, power=TEMPERATURE).repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def in_written_order(docs: DataFrame, part_rows: int = FILE_ROWS // 2) -> DataFrame:
    """The rows of files that Spark wrote, in the order of their writing.

    Spark deals files to tasks by size; here rows go back to the order of the numbers in file
    names and of the rows within.  Rows of another origin keep the order in which they come.
    """
    names, n = docs.columns, max(1, -(-docs.count() // part_rows))
    own = "__order"
    while any(c.lower().startswith(own) for c in names):
        own += "_"
    row, file = {f"{own}_row": F.monotonically_increasing_id()}, F.input_file_name()
    at = {f"{own}_part": F.coalesce(F.nullif(F.regexp_extract(file, r"part-(\d+)[^/]*$", 1), F.lit("")).cast("long"), F.lit(-1)), f"{own}_file": file, f"{own}_block": F.input_file_block_start(), **row}
    try:
        out = docs.withColumns(at)
    except AnalysisException:  # made of several sources: there is no one file to name
        at = row
        out = docs.withColumns(at)
    return out.repartitionByRange(n, *at).sortWithinPartitions(*at).select(*names)
