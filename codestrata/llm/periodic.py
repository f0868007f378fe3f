"""Periodic runs of words by branching tandem repeats in a suffix tree (Stoye and Gusfield).

The words of a batch of texts stand in one sequence, in which texts share no letter of the
alphabet, so that one suffix tree serves them all and no repeat spans two texts.  The tree is
kept as suffix array and LCP intervals: a split of an interval at depth D is an inner node,
its two sides are leaf lists.  The leaves i of the smaller side are visited (smaller half:
n log n in all), and i, i + D or i - D, i in both sides is a branching tandem repeat: two
copies of D words that cannot be rotated to the right.  Rotating it to the left as far as the
words agree gives the run; repeats whose copies are themselves powers give the run of their
root and are merged into the one of least period.

A word that occurs once in its stretch of words belongs to no run.  Such words are taken out
first and cut the sequence into stretches, which are searched if they have ``least`` words.

A run is a stretch of at least ``max(least, 2 * period)`` words with that least period, which no
neighbouring word extends.  Collapsing drops each word that any run holds after its first
``period`` words.

Defined cases: null, empty and blank texts have no words and no runs; null doc_ids and
repeated rows are rows like others; a text is searched whole, whatever its length (a long one
makes a batch of its own); extra columns are kept; the added ones replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, slices, table

LEAST_WORDS = 12
#: Words of a batch of texts that are searched together.
BATCH_WORDS = 1 << 19
#: Leaves that are tested at once.
CHUNK = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers that no two texts share, and whether a word recurs in its text."""
    codes, again, at = [np.empty(0, np.int64)], [np.empty(0, bool)], 0
    for words in texts:
        n = len(words)
        last = dict(zip(words, range(n)))
        code = np.fromiter(map(last.__getitem__, words), np.int64, n)
        again.append(np.bincount(code, minlength=n)[code] > 1)
        codes.append(code + at)
        at += n
    return np.concatenate(codes), np.concatenate(again)


def stretches(code: np.ndarray, again: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may be in a run, and the numbers of their stretches."""
    place = np.flatnonzero(again)
    while True:
        stretch = np.cumsum(np.diff(place, prepend=-2) > 1)
        long = np.bincount(stretch)[stretch] >= least if len(place) else np.empty(0, bool)
        place, stretch, n = place[long], stretch[long], len(place)
        if not len(place):
            return place, stretch
        _, word, times = np.unique(stretch * (len(code) + 1) + code[place], return_inverse=True, return_counts=True)
        recur = times[word] > 1
        if recur.all() or len(place) > 0.9 * n and recur.mean() > 0.9:  # what is left over does no harm
            return place, stretch
        place = place[recur]


def suffix_ranks(letters: np.ndarray) -> list[np.ndarray]:
    """Ranks of the blocks of 1, 2, 4, ... letters at each place, until all differ."""
    n = len(letters)
    rank = np.unique(letters, return_inverse=True)[1]
    levels = [rank]
    while len(levels) <= n.bit_length() and rank.max() < n - 1:
        width = 1 << (len(levels) - 1)
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1]
        levels.append(rank)
    return levels


def splits(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LCP value the first leaf of its left side and the last leaf of its right side."""
    n = len(lcp)
    left, right, stack = [0] * n, [n] * n, []
    for at, depth in enumerate(lcp.tolist()):
        while stack and stack[-1][1] > depth:
            right[stack.pop()[0]] = at
        left[at] = stack[-1][0] + 1 if stack else 0
        stack.append((at, depth))
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_repeats(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat, by smaller leaf lists."""
    rank, n = levels[-1], len(levels[-1])
    leaf = np.empty(n, np.int64)
    leaf[rank] = np.arange(n)
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 2, -1, -1):  # no two blocks of the last level are equal
        a, b = np.minimum(leaf[:-1] + lcp, n - 1), np.minimum(leaf[1:] + lcp, n - 1)
        lcp += (levels[k][a] == levels[k][b]).astype(np.int64) << k
    first, last = splits(lcp)
    node = np.flatnonzero(lcp)
    to_left = node - first[node] < last[node] - node  # sizes less one: the smaller side is visited
    begin = np.where(to_left, first[node], node + 1)
    size = np.where(to_left, node, last[node]) - begin + 1
    low, high = np.where(to_left, node + 1, first[node]), np.where(to_left, last[node], node)
    starts, periods = [], []
    upto = np.cumsum(size)
    cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, CHUNK), "left")
    for s, t in zip(cuts.tolist(), [*cuts.tolist()[1:], len(node)]):
        if s == t:
            continue
        of = np.repeat(np.arange(s, t), size[s:t])
        i = leaf[begin[of] + np.arange(len(of)) - np.repeat(upto[s:t] - size[s:t] - (upto[s - 1] if s else 0), size[s:t])]
        depth = lcp[node[of]]
        for other, start in ((i + depth, i), (i - depth, i - depth)):
            at = rank[np.clip(other, 0, n - 1)]
            met = (other >= 0) & (other < n) & (at >= low[of]) & (at <= high[of])
            starts.append(start[met])
            periods.append(depth[met])
    empty = [np.empty(0, np.int64)]
    return np.concatenate(starts or empty), np.concatenate(periods or empty)


def maximal_runs(code: np.ndarray, again: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period."""
    place, stretch = stretches(code, again, least)
    if not len(place):
        return np.empty((0, 3), np.int64)
    # one letter of its own ends each stretch
    at = np.arange(len(place)) + np.cumsum(np.diff(stretch, prepend=stretch[0]) > 0)
    letters = len(code) + np.arange(at[-1] + 2)
    letters[at] = code[place]
    origin = np.full(len(letters), -1)
    origin[at] = place
    levels = suffix_ranks(letters)
    start, period = branching_repeats(levels)
    end = start + 2 * period
    for k in range(len(levels) - 2, -1, -1):  # rotate to the left
        back = start - (1 << k)
        start = np.where((back >= 0) & (levels[k][back] == levels[k][back + period]), back, start)
    length = end - start
    runs = np.stack([start, length, period], 1)[length >= least]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    root = np.ones(len(runs), bool)
    root[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[root]
    runs[:, 0] = origin[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def search(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[np.ndarray]:
    """The runs of each text."""
    code, again = coded(texts)
    runs = maximal_runs(code, again, least)
    ends = np.cumsum([0, *map(len, texts)])
    cut = np.searchsorted(runs[:, 0], ends)
    return [runs[s:t] - np.array([e, 0, 0]) for s, t, e in zip(cut, cut[1:], ends)]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without repeats: those of each run after its first period."""
    if not len(runs):
        return words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def _runs(text_at: int, schema: pa.Schema, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = schema.field("runs").type
        for part in slices(batches, 1000):
            texts, at = part.column(text_at).to_pylist(), 0
            while at < len(texts):
                lists, n, begin = [], 0, at
                while at < len(texts) and (not lists or n < BATCH_WORDS):
                    lists.append(texts[at].encode().split() if texts[at] else [])
                    n, at = n + len(lists[-1]), at + 1
                found = search(lists, least)
                columns = [c for name, c in zip(part.schema.names, part.slice(begin, at - begin).columns) if name not in ADDED]
                stops = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], fields=list(kind.value_type))
                columns += [
                    pa.array([len(x) for x in lists], pa.int64()), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), rows).cast(kind),
                    pa.array([b" ".join(collapse(x, r)).decode() for x, r in zip(lists, found)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        give_back()

    return run


ADDED = ("n_words", "runs", "collapsed")


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period of words) and the collapsed text."""
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    rows = docs.withColumn("text", F.col("text").cast("string"))
    fields = [rows.schema[f.name] for f in kept] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(ADDED, ("long", RUNS, "string"))]
    out = T.StructType(fields)
    return rows.mapInArrow(_runs(rows.columns.index("text"), to_arrow_schema(out), least), out)


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def planted(docs: DataFrame) -> DataFrame:
    """One document in ten becomes periodic from a word on, as the hash of its id has it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.nullif(F.size("words"), F.lit(0))
    rows = rows.withColumn("a", (F.col("g") % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = planted(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    rows = periodic_runs(docs).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
