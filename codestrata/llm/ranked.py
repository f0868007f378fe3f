"""Ranked lexical search on inverted treaps.

Documents are dealt into shards as they are read.  In a shard each term of the queries has a
treap of its postings: a binary search tree by document, a heap by impact (what one occurrence
of the term in a query adds to the score before its weight).  A query walks the treaps of its
terms together over intervals of documents: the node of a term is the root of its subtree
within the interval, so the sum of the weighted impacts of the nodes is the most that a
document of the interval can score.  An interval whose sum is below the k-th best score so far
is pruned with all its subtrees; of another the document of the largest summand is scored, and
the intervals on its two sides follow.  Intervals of many queries are walked in one step, those
of the highest sums first, and no more than ``CELLS`` nodes at once.

``index_terms`` reads the documents once and writes a row a shard (lengths and postings sorted
by term and document) to the shared folder; counts of documents and terms come from these rows.
Each task of ``search`` makes the treaps of its shards and returns its best k documents a query;
a window keeps the best k of those.  Queries come in blocks whose terms are of a bounded size.

Score, all in whole numbers but for the logarithm: w = floor(1000 ln((2N+2)/(2df+1))),
m = 100-25+((25 n N) div L), score = sum of w ((10^9 tf) div (1000 tf + 12 m)) over the terms
of a query, repeats included; N counts documents with a term, L their terms, n those of one.

Defined cases: null and empty texts hold no term, so as documents they count nowhere and as
queries they return nothing; repeated documents are ranked each; equal scores go by doc_id,
null ids last; each row of the queries is a query, whatever its id; fewer than k documents of a
score above 0 are returned as they are; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, give_back, slices, table
from .terms import terms

#: A shard is closed at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 19
#: Bytes of query text in a block, whose terms travel with each task.
BLOCK_BYTES = 1 << 22
#: Nodes of treaps (intervals times terms) that are walked in one step.
CELLS = 1 << 16
SHARD = "docs array<long>, lengths array<long>, terms array<int>, counts array<long>, doc array<int>, tf array<int>, n_terms long"


def _shards(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, found, postings = [], [], [], 0

        def closed() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            size = np.array([len(x) for x in found], np.int64)
            flat = np.array([y for x in found for y in x.items()], np.int64).reshape(-1, 2)
            doc = np.repeat(place, size)
            by = np.lexsort((doc, flat[:, 0]))
            which, first = np.unique(flat[by, 0], return_index=True)
            return pa.RecordBatch.from_pydict({
                "docs": pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), "lengths": pa.array([[lengths[i] for i in order]], pa.list_(pa.int64())),
                "terms": pa.array([which], pa.list_(pa.int32())), "counts": pa.array([np.diff(first, append=len(by))], pa.list_(pa.int64())),
                "doc": pa.array([doc[by]], pa.list_(pa.int32())), "tf": pa.array([flat[by, 1]], pa.list_(pa.int32())), "n_terms": pa.array([sum(lengths)], pa.int64()),
            })

        for part in slices(batches):
            for id_, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = terms(text)
                if not words:
                    continue
                tf = Counter(filter(None, map(vocabulary.get, words)))
                ids.append(id_)
                lengths.append(len(words))
                found.append(tf)
                postings += len(tf)
                if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield closed()
                    ids, lengths, found, postings = [], [], [], 0
        if ids:
            yield closed()
        give_back()

    return run


def index_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row a shard: its documents by id, and the postings of these terms (numbered from 1)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return checkpoint(rows.mapInArrow(_shards(vocabulary), SHARD))


class Treaps:
    """The treaps of a shard; node 0 is none, nodes of a term lie side by side by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        n = len(term)
        self.key, self.impact = np.concatenate(([-1], doc)), np.concatenate(([0], impact))
        self.left, self.right = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.n_docs, self.place = n_docs, term * n_docs + doc
        # equal impacts are ordered by a scramble of the document, which keeps the trees shallow
        rank = (impact << 20) + ((doc + 1) * 2654435761 >> 7) % (1 << 20)
        left, right, root, spine, before = [0] * (n + 1), [0] * (n + 1), {}, [], -1
        for at, (t, r) in enumerate(zip(term.tolist(), rank.tolist()), 1):
            if t != before:
                if spine:
                    root[before] = spine[0][0]
                spine, before = [], t
            last = 0
            while spine and spine[-1][1] < r:
                last = spine.pop()[0]
            left[at] = last
            if spine:
                right[spine[-1][0]] = at
            spine.append((at, r))
        if spine:
            root[before] = spine[0][0]
        self.left, self.right, self.root = np.array(left), np.array(right), root

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Roots of the subtrees of documents in [low, high), below nodes of wider intervals."""
        node = node.copy()
        shape, node = node.shape, node.reshape(-1)
        low, high = (np.broadcast_to(x[:, None], shape).reshape(-1) for x in (low, high))
        at = np.flatnonzero(node)
        while len(at):
            key = self.key[node[at]]
            small, large = key < low[at], key >= high[at]
            down = np.where(small, self.right[node[at]], self.left[node[at]])
            off = small | large
            at = at[off]
            node[at] = down[off]
            at = at[node[at] > 0]
        return node.reshape(shape)

    def impacts(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impact of each term of a row (-1 is none) in the document of the row."""
        want = term * self.n_docs + doc[:, None]
        at = np.minimum(np.searchsorted(self.place, want), max(len(self.place) - 1, 0))
        hit = (term >= 0) & (self.place[at] == want) if len(self.place) else np.zeros(term.shape, bool)
        return np.where(hit, self.impact[at + 1], 0)


class Best:
    """The k best (score, document) of each query; earlier documents win ties."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.ones(queries, np.int64)
        none = np.empty(0, np.int64)
        self.query, self.score, self.doc = none, none, none

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least[query]
        if not good.any():
            return
        query, score, doc = (np.concatenate((a, b[good])) for a, b in ((self.query, query), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        begin = np.searchsorted(query, query)
        nth = np.arange(len(query)) - begin
        keep = nth < self.k
        self.query, self.score, self.doc = query[keep], score[keep], doc[keep]
        full = nth[keep] == self.k - 1
        self.least[self.query[full]] = np.maximum(self.least[self.query[full]], self.score[full])


def walk(treaps: Treaps, term: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray | None = None) -> Best:
    """Best k documents of queries (rows of terms, -1 for none, and weights) by pruned traversal."""
    best = Best(len(term), k)
    if least is not None:
        best.least = np.maximum(best.least, least)
    step = max(1, CELLS // max(1, term.shape[1]))
    root = np.zeros(int(term.max(initial=0)) + 2, np.int64)
    for t, node in treaps.root.items():
        if t < len(root):
            root[t] = node
    n = len(term)
    bound = lambda node, q: (treaps.impact[node] * weight[q]).sum(1)
    query = np.arange(n)
    node = np.where(term >= 0, root[term], 0)
    pool = [(query, np.zeros(n, np.int64), np.full(n, treaps.n_docs), node, bound(node, query))]
    while pool:
        query, low, high, node, most = pool.pop()
        if len(query) > step:  # the highest sums first, the rest waits
            order = np.argsort(most)
            rest, now = order[:-step], order[-step:]
            pool.append(tuple(x[rest] for x in (query, low, high, node, most)))
            query, low, high, node, most = (x[now] for x in (query, low, high, node, most))
        alive = most >= best.least[query]
        if not alive.any():
            continue
        query, low, high, node = query[alive], low[alive], high[alive], node[alive]
        part = treaps.impact[node] * weight[query]
        pivot = treaps.key[node[np.arange(len(node)), part.argmax(1)]]
        best.add(query, (treaps.impacts(term[query], pivot) * weight[query]).sum(1), pivot)
        sides = []
        for s, t in ((low, pivot), (pivot + 1, high)):
            some = np.flatnonzero(s < t)
            child = treaps.within(node[some], s[some], t[some])
            most = bound(child, query[some])
            ok = most >= best.least[query[some]]
            sides.append((query[some][ok], s[some][ok], t[some][ok], child[ok], most[ok]))
        pool.append(tuple(np.concatenate(x) for x in zip(*sides)))
    return best


def _search(queries: list[Counter], df: dict[int, int], n_docs: int, n_terms: int, k: int):
    w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # queries of about equal numbers of terms are walked together
        groups, order = [], sorted(range(len(queries)), key=lambda q: len(queries[q]))
        while order:
            wide = max(1, len(queries[order[-1]]))
            some = [order.pop() for _ in range(min(len(order), max(1, CELLS // wide)))]
            term, weight = np.full((len(some), wide), -1, np.int64), np.zeros((len(some), wide), np.int64)
            for row, q in enumerate(some):
                for at, (t, times) in enumerate(queries[q].items()):
                    term[row, at], weight[row, at] = t, times * w(t)
            groups.append((np.array(some), term, weight))
        best, ids = [Best(len(some), k) for some, *_ in groups], np.empty(0, object)
        for part in batches:
            for row in range(part.num_rows):
                cell = lambda name: part.column(name)[row].values  # noqa: B023, E731
                numbers = lambda name: cell(name).to_numpy(zero_copy_only=False).astype(np.int64)
                length, doc, tf = numbers("lengths"), numbers("doc"), numbers("tf")
                m = 75 + 25 * length * n_docs // n_terms
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                treaps = Treaps(np.repeat(numbers("terms"), numbers("counts")), doc, impact, len(length))
                here = np.array(cell("docs").to_pylist(), object)
                for (_, term, weight), all_ in zip(groups, best):
                    got = walk(treaps, term, weight, k, all_.least)
                    all_.add(got.query, got.score, got.doc + len(ids))
                # the best of this shard join those of the ones before, ranked by id
                ids = np.concatenate((ids, here))
                kept = np.unique(np.concatenate([b.doc for b in best] or [np.empty(0, np.int64)]))
                by = sorted(range(len(kept)), key=lambda i: (ids[kept[i]] is None, ids[kept[i]] or 0))
                rank = np.empty(len(kept), np.int64)
                rank[by] = np.arange(len(kept))
                for b in best:
                    b.doc = rank[np.searchsorted(kept, b.doc)]
                ids = ids[kept[by]] if len(kept) else np.empty(0, object)
        for (some, *_), b in zip(groups, best):
            yield pa.RecordBatch.from_pydict({
                "query": pa.array(some[b.query], pa.int64()), "doc_id": pa.array(ids[b.doc].tolist(), pa.int64()), "score": pa.array(b.score, pa.int64()),
            })
        give_back()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item (item_id, text)."""
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        counted = [Counter(terms(r["text"])) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)), 1)}
        queries = [Counter({vocabulary[t]: n for t, n in c.items()}) for c in counted]
        index = index_terms(docs, vocabulary)
        n_docs, n_terms = index.agg(F.sum(F.size("docs")), F.sum("n_terms")).first()
        df = dict(index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts")).collect())
        if not n_docs or not vocabulary:
            continue
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query long, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = index.select("docs", "lengths", "terms", "counts", "doc", "tf").mapInArrow(_search(queries, df, n_docs, n_terms, k), "query long, doc_id long, score long")
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", nth).filter(F.col("rank") <= k)
        found.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter(F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), sized AS (
  SELECT row_number() OVER () AS doc, doc_id, words, len(words) AS n FROM d WHERE len(words) > 0
), total AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized
), item AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(words) AS term FROM item) GROUP BY ALL
), tf AS (
  SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, n, unnest(words) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY term, big_n
), scored AS (
  SELECT item, item_id, doc, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
