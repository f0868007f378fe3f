"""SimHash near-duplicates by a Gray-order hierarchical index.

Words are the runs other than ASCII white space of the text with A-Z lower-cased; features
are 3-word shingles, repeats included (a shorter text is one feature, one without words has
fingerprint zero).  A bit of the fingerprint is 1 if it is set in over half of the XXH64
hashes (seed 42).  Fingerprints that differ in at most 3 of 64 bits link.

Search: of five blocks of bits, two at least agree in every such pair, so each distinct
fingerprint goes to the ten keys (pair of blocks, their bits).  Within a key the fingerprints
are sorted by Gray rank; runs of them are the lowest nodes of an index, runs of those the next
ones, up to one root: a node holds the bits that all below it share (mask and pattern).  The
index is joined with itself from the root on.  A pair of nodes carries the differences of the
bits that both share, its children add those of the bits that they share besides, and with
over 3 the pair is dropped with all below it.  Nodes that are in one class already need no
more comparison.  Keys with many fingerprints are split into tiles.

Defined cases: null or empty text has fingerprint zero and links like any other; rows with
one doc_id each get a row, in one class if their fingerprints link; a null doc_id takes part
in no class and comes back with component_id null; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, components, slices, tiled

BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
DISTANCE = 3
FANOUT = 16
TILE_ROWS = 4096
BUCKET_ROWS = 40_000
#: Pairs of nodes that are opened at once.
PAIRS = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist())), np.uint64, len(begins))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; one narrow pass over whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.fromiter(map(fingerprint, part.column(1).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and the fingerprint of its text as ``fp``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.fromiter(map(fingerprint, part.column(at).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64))], names=[*part.schema.names, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    out = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of linked rows; labels are the smallest row of each class."""
    while len(a):
        x, y = labels[a], labels[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            short = labels[labels]
            if (short == labels).all():
                break
            labels = short
    return labels


def _level(start: np.ndarray, stop: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut runs [start, stop) into runs of at most ``fan``."""
    n = -(-(stop - start) // fan)
    owner = np.repeat(np.arange(len(start)), n)
    first = start[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * fan
    return first, np.minimum(first + fan, stop[owner])


def _products(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, left and right position of all pairs of na[k] by nb[k] children."""
    total = na * nb
    row = np.repeat(np.arange(len(na)), total)
    at = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    return row, at // nb[row], at % nb[row]


def index_nodes(fps: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Levels of nodes over the keys' rows [first, last), from runs of rows up, and the root of each key.

    A level is (begin, end, mask, pattern): the children of each node in the level below, the
    bits that all rows under it share, and their values.
    """
    a, b = _level(first, last, FANOUT)
    # reduceat needs rising bounds; runs of one key follow each other, other keys lie between
    bounds = np.column_stack((a, b)).ravel()
    bounds = bounds[:-1] if bounds[-1] == len(fps) else bounds
    both, either = np.bitwise_and.reduceat(fps, bounds)[::2], np.bitwise_or.reduceat(fps, bounds)[::2]
    levels = [(a, b, ~(both ^ either), both)]
    lo, hi = np.searchsorted(a, first), np.searchsorted(a, last)
    while (hi - lo).max() > 1:
        a, b = _level(lo, hi, FANOUT)  # without gaps
        both, either = np.bitwise_and.reduceat(both, a), np.bitwise_or.reduceat(either, a)
        levels.append((a, b, ~(both ^ either), both))
        lo, hi = np.searchsorted(a, lo), np.searchsorted(a, hi)
    return levels, lo


def index_links(keys: np.ndarray, fps: np.ndarray, side: np.ndarray, cross: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Class (smallest row) of each row, by links within a key.

    Rows come sorted by (key, Gray rank).  ``cross`` marks keys that only compare rows of
    different ``side``.
    """
    n = len(fps)
    labels = np.arange(n)
    if n < 2:
        return labels
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    stop = np.concatenate((start[1:], [n]))
    many = stop - start > 1
    if not many.any():
        return labels
    levels, roots = index_nodes(fps, start[many], stop[many])
    a1, b1 = levels[0][:2]
    todo = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64), levels[-1][2][roots])]
    while todo:  # depth first, in pieces, so that few pairs wait
        level, i, j, d, seen = todo.pop()
        if len(i) > PAIRS:
            for at in range(0, len(i), PAIRS):
                todo.append((level, *(x[at : at + PAIRS] for x in (i, j, d, seen))))
            continue
        if not level and len(i) == PAIRS:  # classes found so far may already join the two nodes
            low, high = np.minimum.reduceat(labels, a1), np.maximum.reduceat(labels, a1)
            whole = (low == high) & (np.diff(np.concatenate((a1, [n]))) == b1 - a1)
            open_ = ~(whole[i] & whole[j] & (low[i] == low[j]))
            i, j, d, seen = i[open_], j[open_], d[open_], seen[open_]
        begin, end = levels[level][:2]
        row, x, y = _products(end[i] - begin[i], end[j] - begin[j])
        p, q = begin[i][row] + x, begin[j][row] + y
        keep = (p <= q) if level else (p < q)
        row, p, q = row[keep], p[keep], q[keep]
        if not level:  # rows: all bits count
            more = np.bitwise_count((fps[p] ^ fps[q]) & ~seen[row]).astype(np.int64)
            keep = (d[row] + more <= distance) & ~(cross[p] & (side[p] == side[q]))
            labels = _roots(labels, p[keep], q[keep])
            continue
        mask, pattern = levels[level - 1][2:]
        shared = mask[p] & mask[q]
        more = d[row] + np.bitwise_count((pattern[p] ^ pattern[q]) & shared & ~seen[row])
        keep = more <= distance
        todo.append((level - 1, p[keep], q[keep], more[keep], shared[keep]))
    return labels


def _links(part: pd.DataFrame) -> pd.DataFrame:
    fps = part["fp"].to_numpy(np.int64).view(np.uint64)
    key = part["key"].to_numpy(np.int64)
    ta, tb, tile = (part[c].to_numpy(np.int64) for c in ("tile_a", "tile_b", "tile"))
    order = np.lexsort((gray_rank(fps), tb, ta, key))
    key, fps, ta, tb, tile = key[order], fps[order], ta[order], tb[order], tile[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])))
    labels = index_links(np.cumsum(new), fps, tile, ta != tb)
    rep = part["rep"].to_numpy(np.int64)[order]
    linked = labels != np.arange(len(labels))
    return pd.DataFrame({"src": rep[linked], "dst": rep[labels[linked]]}).drop_duplicates()


def near_groups(fps: DataFrame, tile_rows: int = TILE_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for (doc_id, fp): classes of fingerprints at DISTANCE bits or fewer.

    Equal fingerprints first become one, with the smallest doc_id; only those are compared.
    """
    reps = checkpoint(fps.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")))
    pairs = list(itertools.combinations(range(len(BLOCKS)), 2))
    keys = []
    for k, (a, b) in enumerate(pairs):
        bits = F.lit(k).cast("long")
        for lo, hi in (BLOCKS[a], BLOCKS[b]):
            bits = F.shiftleft(bits, hi - lo).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
        keys.append(bits)
    rows = reps.select("rep", "fp", F.explode(F.array(*keys)).alias("key"))
    n_buckets = max(1, -(-reps.count() * len(pairs) // bucket_rows))
    rows = tiled(rows, "key", F.xxhash64("fp"), tile_rows)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "tile_a", "tile_b"), F.lit(n_buckets)))
    edges = rows.groupBy("bucket").applyInPandas(_links, "src long, dst long")
    joined = components(edges)
    groups = reps.join(joined, reps.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(groups, "fp", "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    return near_groups(checkpoint(fingerprints(docs)))


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = simhash_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
