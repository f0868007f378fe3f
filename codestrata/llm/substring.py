"""Substring dedup with compressed FM-indexes over shards of repeated passages.

Words are the runs other than ASCII white space.  A word goes if a window of ``WINDOW`` words
that covers it also starts earlier (smaller doc_id, or earlier in the same document).

Routing: each window has an anchor, its least hashed word triple, so equal windows have equal
anchors, and neighbouring windows with one anchor form a segment.  Anchors are counted over
the corpus, and only segments whose anchor occurs again are sent on, with their words, to the
shard of their anchor: any two equal windows meet in one shard.  Hashes only route; windows
are equal if their words are.  In a batch of rows a segment that occurs again is sent once,
with its earliest place; the later ones are known to be covered.

Hot anchors: an anchor that a batch holds ``SPLIT_DOCS`` times or more is known to occur
again, so its documents are dealt by batch and only its count goes to the task of the anchor.
Anchors of over ``HOT_ANCHOR`` places have their windows dealt out one by one.

Shard: an FM-index over the distinct segments.  Words are numbered by a dictionary of the
shard, suffixes are sorted by their first WINDOW words, and what is kept is the
Burrows-Wheeler transform in a wavelet matrix of packed bits with block ranks, and one bit a
suffix that marks the intervals of WINDOW - 1 words.  Every segment is streamed through it
from its end by backward search; past WINDOW words the match drops its last word (parent
interval) and goes on, which gives the matching statistics at the threshold: the interval of
the window at each position.  Windows in one interval of more than one suffix are equal, and
all but the earliest of them are repeats.

Defined cases: a null text has no words; fewer than WINDOW words are never removed; rows of
one doc_id and start are not earlier than each other; a null doc_id is after all others (rows
with it are tied); repeated rows get a row each; extra columns are kept by ``dedup_texts``,
whose own column takes another name if that of ``told`` is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BROADCAST_ROWS, checkpoint, give_back, slices, table

WINDOW = 20
LAST_ID = 2**63 - 1
#: Text bytes for each shard: about 150,000 words of it where two fifths of the text repeat.
SHARD_BYTES = 1_750_000
#: An anchor with more places than this has its windows dealt out one by one.
HOT_ANCHOR = 4096
#: Places of an anchor in one batch from which on its documents are dealt by batch.
SPLIT_DOCS = 4
#: Windows of hot anchors that a task remembers, so that it sends each once (beyond them, once a batch).
KNOWN_WINDOWS = 100_000


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def segments(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, begin and end (in words) of the segments of a text of hashed words.

    Neighbouring windows whose least triple lies at one place (the first, of equal ones) are a
    segment: the place moves on where a window loses it, or gains a lesser one.
    """
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    triples, wide = g, 1
    while 2 * wide <= window - 2:  # minima of 2, 4, 8, ... triples
        g = np.minimum(g[:-wide], g[wide:])
        wide *= 2
    rest = window - 2 - wide
    least = np.minimum(g[: len(g) - rest], g[rest:])
    new = np.concatenate(([True], (least[1:] < least[:-1]) | (triples[: len(least) - 1] == least[:-1])))
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:], [n - window + 1])) + window - 1
    return least[begin].view(np.int64), begin, end


class Bits:
    """A packed bit vector with ranks by blocks of 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.ranks = np.concatenate(([0], np.cumsum(ones[:-1], dtype=np.int32))).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[block] + np.bitwise_count(self.words[block] & mask).astype(np.int64)


class Marks(Bits):
    """Marked positions, 0 among them: the run of positions around each one."""

    def __init__(self, bits: np.ndarray):
        super().__init__(bits)
        some = np.flatnonzero(self.words)
        block = np.arange(len(self.words))
        self.back = some[np.searchsorted(some, block, "right") - 1].astype(np.int32)  # the last block up to here with a mark
        after = np.searchsorted(some, block, "right")
        self.ahead = np.append(some, len(self.words))[after].astype(np.int32)  # the first one behind

    def run(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last mark up to each position and first one behind it (or the end)."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        low, high = self.words[block] & upto, self.words[block] & ~upto
        inside = low != 0
        left = np.where(inside, block, self.back[np.maximum(block - 1, 0)])
        x = np.where(inside, low, self.words[left])
        for k in (1, 2, 4, 8, 16, 32):
            x |= x >> np.uint64(k)
        first = left * 64 + np.bitwise_count(x) - 1
        inside = high != 0
        right = np.where(inside, block, self.ahead[block])
        end = right == len(self.words)
        x = np.where(inside, high, self.words[np.where(end, 0, right)])
        last = right * 64 + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
        return first.astype(np.int64), np.where(end, self.n, last).astype(np.int64)


class FMIndex:
    """Backward search for patterns of up to ``depth`` words over a text of numbers 0 to sigma - 1, all of which occur.

    0 parts segments and ends the text.  Kept are the levels of the wavelet matrix, a count and
    a start a word, and the marks of the intervals of ``depth`` - 1 words; no suffix is.
    """

    def __init__(self, text: np.ndarray, depth: int = WINDOW):
        n = len(text)
        rank, have = text.astype(np.int64), 1
        self.n, self.sigma = n, int(rank.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=self.sigma))))[:-1]

        def ahead(k: int) -> np.ndarray:  # ranks k words on; the end is least
            return np.concatenate((rank[k:], np.full(min(k, n), -1, np.int64))) + 1

        while have < depth:
            # order by the first ``want`` words, from ranks of ``have``: of three words at once while they are numbers
            want = min(depth, 3 if have == 1 and self.sigma < 1 << 20 else 2 * have)
            if want == 3 and have == 1:
                key = (rank << 42) + (ahead(1) << 21) + ahead(2)
            else:
                key = rank * (n + 1) + ahead(want - have)
            order = np.argsort(key)  # ties lie anyhow: only classes count
            sorted_ = key[order]
            classes = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
            if want == depth:  # where suffixes next to each other differ within depth - 1 words
                short = rank[order], ahead(max(0, depth - 1 - have))[order]
                marks = np.concatenate(([True], (short[0][1:] != short[0][:-1]) | (short[1][1:] != short[1][:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = classes
            have = want
        self.shorter = Marks(marks)
        bwt = text[order - 1].astype(np.int64)  # the text ends in 0, so position -1 is a 0
        self.levels = []
        for bit in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            b = (bwt >> bit) & 1
            self.levels.append((bit, Bits(b), n - int(b.sum())))
            bwt = np.concatenate((bwt[b == 0], bwt[b == 1]))
        self.start = self._down(np.zeros(self.sigma, np.int64), np.arange(self.sigma))

    def _down(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((c >> bit) & 1, zeros + ones, at - ones)
        return at

    def step(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the word c before the pattern of each interval."""
        both = self._down(np.concatenate((lo, hi)), np.concatenate((c, c))) + np.tile(self.before[c] - self.start[c], 2)
        return both[: len(lo)], both[len(lo) :]

    def parent(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``depth`` - 1 words of those that begin at ``lo``."""
        return self.shorter.run(lo)


def statistics(fm: FMIndex, text: np.ndarray, first: np.ndarray, size: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(stream, position, lo, hi) of the windows of streams text[first:first + size], from their ends.

    [lo, hi) is the interval of the suffixes that begin with the window.
    """
    by = np.argsort(-size, kind="stable")  # longest first
    rest, first = size[by], first[by]
    lo, hi = np.zeros(len(by), np.int64), np.full(len(by), fm.n, np.int64)
    for step in range(int(rest[0]) if len(by) else 0):
        n = int(np.searchsorted(-rest, -step, "left"))  # streams of more than ``step`` words
        lo, hi = lo[:n], hi[:n]
        if step >= window:
            lo, hi = fm.parent(lo)
        position = rest[:n] - 1 - step
        lo, hi = fm.step(lo, hi, text[first[:n] + position])
        if step >= window - 1:
            yield by[:n], position, lo, hi


def numbered(words: list[bytes]) -> np.ndarray:
    """A number from 1 for each different word."""
    code = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
    return np.fromiter(map(code.__getitem__, words), np.int64, len(words))


def repeats(words: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(segment, position) of each window of distinct segments that starts earlier elsewhere.

    Segment s is words[offsets[s]:offsets[s + 1]] (numbers from 1), and its earliest place is (doc, start).
    """
    k = len(offsets) - 1
    size = np.diff(offsets)
    text = np.zeros(len(words) + k, np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(k), size)] = words
    fm = FMIndex(text, window)
    ranks = np.unique(doc, return_inverse=True)[1].astype(np.int64)
    found = []
    for seg, at, lo, hi in statistics(fm, text, offsets[:-1] + np.arange(k), size, window):
        again = hi - lo > 1
        found.append((seg[again], at[again], lo[again]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seg, at, lo = (np.concatenate(x) for x in zip(*found))
    place = (ranks[seg] << 32) + start[seg] + at
    which, n = np.unique(lo, return_inverse=True)
    least = np.full(len(which), LAST_ID, np.int64)
    np.minimum.at(least, n, place)
    late = place > least[n]
    return seg[late], at[late]


def _runs(seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring positions: segment, first and last."""
    order = np.lexsort((at, seg))
    seg, at = seg[order], at[order]
    if not len(seg):
        return seg, at, at
    cut = np.flatnonzero((seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.concatenate(([0], cut + 1))
    last = np.concatenate((cut, [len(seg) - 1]))
    return seg[first], at[first], at[last]


SEGMENT = "shard long, doc_id long, th long, start int, stop int, words binary"


def _shard(part: pd.DataFrame) -> pd.DataFrame:
    give_back()  # what the shard before held
    known = part["words"].isna().to_numpy()
    doc, th, start, stop = (part[c].to_numpy(np.int64) for c in ("doc_id", "th", "start", "stop"))
    out = [(doc[known], th[known], start[known], stop[known])]
    rows = np.flatnonzero(~known)
    if len(rows):
        rows = rows[np.lexsort((th[rows], start[rows], doc[rows]))]
        texts = part["words"].to_numpy()
        seen: dict[bytes, int] = {}
        distinct, again = [], []
        for i in rows.tolist():
            first = seen.setdefault(texts[i], i)
            if first == i:
                distinct.append(i)
            elif (doc[first], start[first]) < (doc[i], start[i]):
                again.append(i)
        at = np.array(distinct)
        words = numbered(b" ".join(texts[i] for i in distinct).split(b" "))
        offsets = np.concatenate(([0], np.cumsum([texts[i].count(b" ") + 1 for i in distinct])))
        seg, pos = repeats(words, offsets, doc[at], start[at])
        seg, a, b = _runs(seg, pos)
        out.append((doc[at[seg]], th[at[seg]], start[at[seg]] + a, start[at[seg]] + b + WINDOW))
        again = np.array(again, np.int64)
        out.append((doc[again], th[again], start[again], stop[again]))
        # rows tied with the first place of their text share its fate
        tied = [(i, seen[texts[i]]) for i in rows.tolist() if seen[texts[i]] != i and (doc[seen[texts[i]]], start[seen[texts[i]]]) == (doc[i], start[i])]
        if tied:
            of = {d: k for k, d in enumerate(distinct)}
            by_seg: dict[int, list[int]] = {}
            for k, s in enumerate(seg.tolist()):
                by_seg.setdefault(s, []).append(k)
            for i, f in tied:
                for k in by_seg.get(of[f], ()):
                    out.append((doc[[i]], th[[i]], start[[i]] + a[[k]], start[[i]] + b[[k]] + WINDOW))
    cols = [np.concatenate(c) for c in zip(*out)]
    # join touching intervals of a document
    order = np.lexsort((cols[2], cols[1], cols[0]))
    d, t, s, e = (c[order] for c in cols)
    if len(d):
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
        group = np.cumsum(new)
        reach = np.maximum.accumulate(e + group * (1 << 33)) - group * (1 << 33)
        new[1:] |= s[1:] > reach[:-1]
        first = np.flatnonzero(new)
        d, t, s, e = d[first], t[first], s[first], np.maximum.reduceat(e, first)
    return pd.DataFrame({"__dedup_id": d, "__dedup_th": t, "start": s.astype(np.int32), "stop": e.astype(np.int32)})


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, anchor, n, docs) for each anchor of a batch; docs packs (doc_id, th) pairs.

    Usually key is the anchor.  With SPLIT_DOCS places there are two rows: one with the count
    and no docs, and one of n = 0 with the docs, whose key is of this batch alone.
    """
    part_id, batch = TaskContext.get().partitionId(), 0
    for part in slices(batches, 5000):
        batch += 1
        ids, ths = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        found, owner = [], []
        for k, text in enumerate(part.column(2).to_pylist()):
            a = segments(hashes(text.encode().split()))[0] if text else ()
            if len(a):
                found.append(a)
                owner.append(np.full(len(a), k))
        if not found:
            continue
        a, o = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((o, a))
        a, o = a[order], o[order]
        pair = np.column_stack((ids[o], ths[o]))
        once = np.concatenate(([True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])))
        head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        n = np.diff(np.concatenate((head, [len(a)])))
        kept = np.concatenate(([0], np.cumsum(once)))
        bounds = np.concatenate((kept[head], [kept[-1]])) * 16
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(pair[once]))]).cast(pa.binary())
        a = a[head]
        many = n >= SPLIT_DOCS
        salt = np.uint64(xxhash.xxh64_intdigest(f"{part_id} {batch}"))
        key = np.where(many, (a.view(np.uint64) ^ salt).view(np.int64), a)
        names = ["key", "anchor", "n", "docs"]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(np.where(many, 0, n)), packed], names=names)
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[many]), pa.array(a[many]), pa.array(n[many]), pa.array([b""] * int(many.sum()), pa.binary())], names=names)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, anchor, hot) of packed rows."""
    for part in batches:
        if not part.num_rows:
            continue
        raw = part.column(1).to_pylist()
        pair = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
        times = [len(x) // 16 for x in raw]
        a, hot = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(a), pa.array(hot)], names=["__dedup_id", "__dedup_th", "anchor", "hot"])


def _segments(n_shards: int, text_at: int, width: int):
    """Segments of repeated anchors: each distinct one of a batch with words, later ones as covered."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["shard", "doc_id", "th", "start", "stop", "words"]

    def lists(column: pa.Array) -> list[np.ndarray]:
        values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()  # of a slice too
        return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}  # windows of hot anchors
        for part in slices(batches):
            first: dict[tuple, tuple] = {}
            rows, ids, ths = [], part.column(0).to_pylist(), part.column(1).to_pylist()
            texts, wanted, hot = part.column(text_at).to_pylist(), lists(part.column(width)), lists(part.column(width + 1))
            for k in sorted(range(len(ids)), key=lambda k: (ids[k], ths[k])):
                if not len(wanted[k]):
                    continue
                all_words = texts[k].encode().split()
                a, begin, end = segments(hashes(all_words))
                line = b" ".join(all_words)
                stops = np.cumsum(np.fromiter(map(len, all_words), np.int64, len(all_words)) + 1) - 1
                hit = np.isin(a, wanted[k])
                frequent = set(hot[k].tolist())
                doc, th = ids[k], ths[k]
                covered = None
                for anchor, b, e in zip(a[hit].tolist(), begin[hit].tolist(), end[hit].tolist()):
                    # windows of a very frequent anchor go each to a shard of their own words
                    split = anchor in frequent
                    pieces = ((i, i + WINDOW) for i in range(b, e - WINDOW + 1)) if split else ((b, e),)
                    for s, t in pieces:
                        words = line[stops[s - 1] + 1 if s else 0 : stops[t - 1]]
                        if split:
                            key = xxhash.xxh64_intdigest(words)
                            place = known.get(words)
                            if (place is None or place > (doc, s)) and (place is not None or len(known) < KNOWN_WINDOWS):
                                known[words] = doc, s
                        else:
                            key = anchor
                            place = None
                        if place is None:
                            place = first.setdefault((key, words), (doc, s))
                        if place >= (doc, s):
                            rows.append((key % n_shards, doc, th, s, t, words))
                        elif covered and s <= covered[1]:
                            covered[1] = t
                        else:
                            if covered:
                                rows.append(((th + covered[0]) % n_shards, doc, th, *covered, None))
                            covered = [s, t]
                if covered:
                    rows.append(((th + covered[0]) % n_shards, doc, th, *covered, None))
                if len(rows) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _apply(text_at: int, schema: pa.Schema, rejoin: bool):
    """Remove the covered words of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            width = part.num_columns - 2
            texts, starts, stops = (part.column(i).to_pylist() for i in (text_at, width, width + 1))
            kept, told = [], []
            for text, s, e in zip(texts, starts, stops):
                words = text.encode().split() if text else []
                n, spans = len(words), []
                if s:
                    keep = np.zeros(n + 1, np.int64)
                    np.add.at(keep, s, 1)
                    np.add.at(keep, e, -1)
                    gone = np.cumsum(keep[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                    spans = [{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()]
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept.append(b" ".join(words).decode() if s or rejoin else text)
                told.append({"n_words": n, "n_removed": n - len(words), "spans": spans})
            columns = [part.column(i) for i in range(2, width)]
            columns[text_at - 2] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, schema.field(len(columns)).type)], schema=schema)

    return run


def dedup_texts(docs: DataFrame, rejoin: bool = False, hot: int = HOT_ANCHOR, told: str = "dedup") -> DataFrame:
    """``docs`` with the repeated words taken out of text, and ``told`` (n_words, n_removed, spans).

    A text that loses nothing stays as it is, unless ``rejoin`` asks for its words joined by
    one space; the others are so joined.
    """
    key = ["__dedup_id", "__dedup_th"]
    names = docs.columns
    text = F.col("text").cast("string")
    # columns go by their places, so that none clashes with the names of this function
    at, own = names.index("text"), [f"c{i}" for i in range(len(names))]
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias(key[0]), F.xxhash64(text).alias(key[1]),
        *[(text if i == at else F.col(f"`{c}`")).alias(own[i]) for i, c in enumerate(names)],
    )
    n_shards = max(8, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD_BYTES))
    anchors = rows.select(*key, own[at]).mapInArrow(_anchors, "key long, anchor long, n long, docs binary")
    anchors = anchors.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).filter("n = 0 OR total > 1")
    is_hot = F.col("total") > hot
    anchors = checkpoint(anchors.filter((F.octet_length("docs") > 0) | is_hot).select("anchor", "docs", "n", is_hot.alias("hot")))
    # the count of an anchor is known in its own task: documents dealt by batch look it up
    frequent = anchors.filter("n > 0 AND hot").select("anchor").distinct().withColumn("_hot", F.lit(True))
    dealt = anchors.filter("n = 0").join(F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent, "anchor", "left")
    dealt = dealt.select("anchor", "docs", F.coalesce("_hot", F.lit(False)).alias("hot"))
    wanted = dealt.unionByName(anchors.filter("n > 0 AND octet_length(docs) > 0").select("anchor", "docs", "hot"))
    wanted = wanted.mapInArrow(_unpack, f"{key[0]} long, {key[1]} long, anchor long, hot boolean")
    wanted = wanted.groupBy(*key).agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("frequent"))
    # both joins read the same exchange of the texts: left joins, and all columns each time
    found = rows.join(wanted, key, "left").mapInArrow(_segments(n_shards, 2 + at, 2 + len(names)), SEGMENT)
    spans = found.groupBy("shard").applyInPandas(_shard, f"{key[0]} long, {key[1]} long, start int, stop int")
    spans = spans.groupBy(*key).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    kind = "struct<n_words: long, n_removed: long, spans: array<struct<start: int, stop: int>>>"
    out = T.StructType([*docs.withColumn("text", text).schema.fields, T.StructField(told, T._parse_datatype_string(kind))])
    return rows.join(spans, key, "left").mapInArrow(_apply(2 + at, to_arrow_schema(out), rejoin), out)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), rejoin=True)
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM w
), win AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY array_to_string(words[start:start + 19], ' ') ORDER BY doc_id, start) AS nth FROM s
), gone AS (
  SELECT DISTINCT doc_id, start + k AS at FROM win, (SELECT unnest(range(20)) AS k) WHERE nth > 1
), each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM w
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.at) AS text, count(*) AS n
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.at = g.at GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
