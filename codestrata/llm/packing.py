"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

Each text is encoded and ended by an end id.  Whole sequences are cut off long documents;
what is left of a batch of neighbouring rows is dealt into k windows: every piece starts as
a partition of k sums, and the two partitions of largest spread are merged again and again,
the fullest windows of one with the emptiest of the other.  k begins at total / capacity and
rises while some window exceeds the capacity.  Batches follow the order of the input and
need no shuffle, and a task holds one batch only.

Defined cases: a null or empty text is the end id alone; repeated rows are packed like any
other; a null doc_id is kept as null; extra columns are ignored.  Sequence ids are (input
partition, number within it), so a retried task gives the same rows.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

SEQUENCE, END_ID = 4096, 2
BATCH_PIECES = 2048
CACHE_WORDS = 300_000
#: White space of every definition; other kinds are left to the tokenizer.
BREAKS = re.compile("[\t\n\r]")
#: The marks that compose with letters A-Z.
COMBINING = re.compile("[\u0300-\u036f]")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so ids of a text are those of
    its words; words are kept in a bounded cache, which the first and so most frequent ones
    fill.  It lowers case, so texts are looked up with A-Z lowered (not those with combining
    marks, which it composes first).  A word of letters with ``TAIL`` characters behind it is
    encoded as the two, which the tokenizer parts as well; such words share the cache entry of
    their letters, and only half of the cache takes them too.  Words of letters end in exactly
    one token with a word end, so many are encoded in one call and parted there.
    """

    #: Characters that stay one run with each other and apart from letters.
    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cache_words
        self.cache: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        # the fast call keeps no offsets
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def plain(self, word: str) -> bytes:
        return self.ids(word).tobytes()

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters."""
        ids = self.ids(" ".join(words))
        stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stop) != len(words):  # a letter whose lower case is more than letters
            return [self.plain(w) for w in words]
        raw, at, out = ids.tobytes(), 0, []
        for e in stop.tolist():
            out.append(raw[at:e])
            at = e
        return out

    def __call__(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        elif not COMBINING.search(text):
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        words = BREAKS.sub(" ", text).split(" ")
        cache = self.cache
        parts = list(map(cache.get, words))
        if None not in parts:
            return b"".join(parts)
        missing = []
        for i, ids in enumerate(parts):
            if ids is None:
                w = words[i]
                stem = w.rstrip(self.TAIL)
                ids, tail = cache.get(stem), cache.get(w[len(stem) :])
                if ids is None or tail is None or not stem.isalpha() or "\u0130" in stem:
                    missing.append(i)
                else:
                    parts[i] = ids + tail
        new: dict[str, bytes] = {}  # words of letters, tails and others, each once
        pairs: dict[str, tuple[str, str]] = {}
        for w in {words[i] for i in missing}:
            stem = w.rstrip(self.TAIL)
            tail = w[len(stem) :]
            if stem.isalpha() and "\u0130" not in stem:  # its lower case ends in a mark, which joins a tail
                pairs[w] = stem, tail
                if stem not in cache:
                    new[stem] = b""
                if tail not in cache and tail not in new:
                    new[tail] = self.plain(tail)
            else:
                new[w] = self.plain(w)
        stems = [w for w, ids in new.items() if not ids and w.isalpha()]
        for at in range(0, len(stems), 1000):
            new.update(zip(stems[at : at + 1000], self.letters(stems[at : at + 1000])))
        known = lambda w: new[w] if w in new else cache[w]
        whole = {w: known(stem) + known(tail) for w, (stem, tail) in pairs.items()}
        for i in missing:
            w = words[i]
            parts[i] = whole[w] if w in whole else new[w]
        if len(cache) < self.most:
            cache.update({w: new[w] for w in stems})
            if len(cache) < self.most // 2:
                cache.update(new)
                cache.update(whole)
        return b"".join(parts)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items into k sets of near-equal sums: merge the two partitions of largest spread."""
    if not sizes:
        return []
    # a set is 0 (empty), 1 + item, or a joined pair of sets with a number above
    heap = []
    for i, size in enumerate(sizes):
        sums, sets = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[-1], sets[-1] = size, i + 1
        heap.append((-size, i, sums, sets))
    heapq.heapify(heap)
    serial, fresh = len(sizes), len(sizes) + 1
    first, pairs = fresh, []
    while len(heap) > 1:
        _, _, a, s = heapq.heappop(heap)
        _, _, b, t = heapq.heappop(heap)
        b, t = b[::-1], t[::-1]
        sums, sets = a + b, s + t
        both = np.flatnonzero((s > 0) & (t > 0))
        if len(both):
            pairs.append((s[both], t[both]))
            sets[both] = np.arange(fresh, fresh + len(both))
            fresh += len(both)
        order = np.argsort(sums, kind="stable")
        sums, sets = sums[order], sets[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), serial, sums, sets))
        serial += 1
    left = np.concatenate([x for x, _ in pairs]).tolist() if pairs else []
    right = np.concatenate([x for _, x in pairs]).tolist() if pairs else []
    out = []
    for top in heap[0][3].tolist():
        items, todo = [], [top] if top else []
        while todo:
            x = todo.pop()
            if x >= first:
                todo += (left[x - first], right[x - first])
            else:
                items.append(x - 1)
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Sets of items (by position) of at most ``capacity`` each; k rises until all fit."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = difference(sizes, k)
        most = max(sum(sizes[i] for i in s) for s in sets)
        if most <= capacity:
            return [s for s in sets if s]
        # as many as would do at this spread, but in small steps: the spread changes with k
        k += max(1, min(k // 64, int((most - capacity) * k / capacity / 2)))


def pack(docs: DataFrame, path: str, capacity: int = SEQUENCE, end_id: int = END_ID, batch: int = BATCH_PIECES) -> DataFrame:
    """One row per piece (see PIECES) of ``docs`` (doc_id, text)."""
    import zlib

    def flush(part: int, serial: int, whole: list, rest: list) -> tuple[int, pa.RecordBatch]:
        rows = []
        for piece in whole:
            rows.append((*piece, (part << 32) + serial, 0))
            serial += 1
        rest = sorted(rest, key=lambda p: -p[2])
        for items in windows([p[2] for p in rest], capacity):
            at = 0
            for i in sorted(items):
                rows.append((*rest[i], (part << 32) + serial, at))
                at += rest[i][2]
            serial += 1
        cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return serial, pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        part, serial, whole, rest = TaskContext.get().partitionId(), 0, [], []
        for rows in slices(batches, 512):
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    cut = ids[4 * at : 4 * (at + capacity)]
                    piece = (doc, at, len(cut) // 4, zlib.crc32(cut), n)
                    (whole if piece[2] == capacity else rest).append(piece)
                if len(rest) >= batch or len(whole) >= 16 * batch:
                    serial, out = flush(part, serial, whole, rest)
                    whole, rest = [], []
                    yield out
        if whole or rest:
            yield flush(part, serial, whole, rest)[1]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process, so that its cache lives on between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_kk_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
