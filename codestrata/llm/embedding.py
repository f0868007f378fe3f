"""Embedding near-dedup by collision-counting projections.

Vectors are scaled to length 1 and projected on many random lines.  Two vectors collide on a
line if one lies in the window of half-width ``w`` centred on the other's projection.  Pairs
with at least ``threshold`` collisions on ``COUNTED`` lines are verified by their exact cosine
in double precision; the threshold is the largest count that a pair at the limit reaches
but for a third of the loss that ``RECALL`` leaves.

To meet, vectors share a cell of one of L tables: a cell is the row of a grid on k further
lines.  k grows with the logarithm of the number of vectors, so that a cell holds about
``CELL_ROWS`` unrelated ones, and L is set so that a pair at the limit shares a cell with
high probability.  Within a cell, rows are sorted by the first line and a window slides over
them.  A vector moves L times, alone: pairs count in the first table that they share, and the
cells of linked rows in the other tables are computed again where that is asked.  So numbers
of links need no pair list: a task returns partial counts and a spanning forest of its links.
Sharing a cell, lying in the first window and colliding often enough each take an equal part
of the loss that ``RECALL`` leaves.  Equal vectors
become one with a weight first, and cells of many rows are split into tiles.

Defined cases: null or empty or zero vectors, and those with null or non-finite components,
link with nothing, as do vectors of different lengths with each other; repeated rows of one
vec_id count as rows of their own; a null vec_id gets a row that links with nothing; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, table, tiled

COSINE = 0.95
RECALL = 0.9999
COUNTED = 24
CELL_ROWS = 1024
#: Steps of a window's half-width, so that a line takes a byte.
STEPS = 16
WIDTH = 2.0  # of a grid cell; unrelated unit vectors differ by sqrt(2) on a line
TILE_ROWS = 4096
BUCKET_ROWS = 20_000
PAIRS = 50_000
SEED = 20240


class Plan:
    """Window, threshold and grid for ``n`` vectors, from the probabilities at the limit."""

    def __init__(self, n: int, cosine: float = COSINE, recall: float = RECALL, counted: int = COUNTED):
        if counted % 8:
            raise ValueError("lines are counted by eights")
        normal = NormalDist()
        loss = (1 - recall) / 3
        near = math.sqrt(2 - 2 * cosine)

        def same_cell(spread: float) -> float:
            r = WIDTH / spread
            return 1 - 2 * normal.cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

        self.cosine, self.counted = cosine, counted
        self.half = 2 * near
        hit = 2 * normal.cdf(self.half / near) - 1
        below = 0.0
        self.threshold = 0
        for c in range(counted + 1):
            below += math.comb(counted, c) * hit**c * (1 - hit) ** (counted - c)
            if below > loss:
                self.threshold = c
                break
        self.first = near * normal.inv_cdf(1 - loss / 2)
        p1, p2 = same_cell(near), same_cell(math.sqrt(2))
        self.k = max(1, math.ceil(math.log(max(n, 1) / CELL_ROWS) / -math.log(p2))) if n > CELL_ROWS else 0
        self.tables = 1 if not self.k else math.ceil(math.log(loss) / math.log(1 - p1**self.k))

    def lines(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, dim])
        counted = rng.standard_normal((dim, self.counted + 1))
        grid = rng.standard_normal((dim, self.tables * self.k))
        return counted, grid, rng.uniform(0, WIDTH, self.tables * self.k)

    def codes(self, p: np.ndarray) -> np.ndarray:
        """Places on the counted lines in steps of the half-width, a byte each.

        Places in one window differ by STEPS at most, so no collision is missed; a few more
        pass, which verification drops.
        """
        return np.clip(np.floor(p * (STEPS / self.half)) + 128, 0, 255).astype(np.uint8)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On how many lines the codes of each pair lie in one window.

    Differences wrap around: codes 240 apart count too, which verification drops.
    """
    d = a - b
    d += np.uint8(STEPS)
    words = (d <= 2 * STEPS).view(np.uint64)  # a line a byte, 0 or 1
    total = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        total += words[:, k]
    return (total * np.uint64(0x0101010101010101)) >> np.uint64(56)


def unit(vector) -> np.ndarray | None:
    if vector is None or not len(vector):
        return None
    try:
        v = np.asarray(vector, np.float64)
    except (TypeError, ValueError):
        return None
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    return None if not top else (v / top) / np.linalg.norm(v / top)


def stored(vector) -> bytes:
    """A vector as it came, in single precision where that loses nothing."""
    v = np.asarray(vector, np.float64)
    with np.errstate(over="ignore"):
        single = v.astype("<f4")
    return b"s" + single.tobytes() if (single == v).all() else b"d" + v.tobytes()


def restored(raw: list[bytes]) -> np.ndarray:
    """Stored vectors of one kind and dimension, scaled to length 1."""
    kind = "<f4" if raw[0][:1] == b"s" else "<f8"
    x = np.frombuffer(b"".join([r[1:] for r in raw]), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dims(raw) -> np.ndarray:
    return np.array([(len(r) - 1) // (4 if r[:1] == b"s" else 8) for r in raw])


def of_dim(raw, at: np.ndarray) -> np.ndarray:
    """Vectors of one dimension, whichever way each is stored."""
    single = np.array([raw[i][:1] == b"s" for i in at])
    parts = [restored([raw[i] for i in at[k]]) for k in (single, ~single) if k.any()]
    out = np.empty((len(at), parts[0].shape[1]))
    out[np.flatnonzero(single)] = parts[0] if single.any() else np.empty((0, out.shape[1]))
    out[np.flatnonzero(~single)] = parts[-1] if not single.all() else np.empty((0, out.shape[1]))
    return out


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, v): key is null where the vector links with nothing."""
    for part in batches:
        keys, out = [], []
        for vec_id, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            v = None if vec_id is None else unit(x)
            out.append(None if v is None else stored(x))
            keys.append(None if v is None else hashlib.md5(v.tobytes()).digest())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["vec_id", "key", "v"])


def cells_of(plan: Plan, x: np.ndarray) -> np.ndarray:
    """The cell of each unit vector in each table."""
    dim = x.shape[1]
    _, grid, shift = plan.lines(dim)
    mix = np.random.default_rng([SEED, 1]).integers(1, 2**63, (plan.tables, plan.k + 1), dtype=np.int64).astype(np.uint64) | np.uint64(1)
    cell = np.floor((x @ grid + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(x), plan.tables, plan.k)
    h = (cell * mix[None, :, : plan.k]).sum(2, dtype=np.uint64) + mix[None, :, plan.k] * np.uint64(dim)
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _cells(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table of a vector, with its cell there."""
        for part in batches:
            ids, weight, raw = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()
            sizes = dims(raw)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for lo in range(0, len(at), 2000):
                    few = at[lo : lo + 2000]
                    h = cells_of(plan, of_dim(raw, few))
                    rep = lambda a: np.repeat(a, plan.tables)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rep(ids[few])), pa.array(rep(weight[few])), pa.array([raw[i] for i in few for _ in range(plan.tables)], pa.binary()),
                        pa.array(np.tile(np.arange(plan.tables, dtype=np.int32), len(few))), pa.array(h.ravel()),
                    ], names=["rep", "weight", "v", "t", "cell"])

    return run


def _bucket(plan: Plan):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        rep, weight, t, cell, tile, ta, tb = (part[c].to_numpy(np.int64) for c in ("rep", "weight", "t", "cell", "tile", "tile_a", "tile_b"))
        raw = part["v"].to_numpy()
        sizes = dims(raw)
        links = np.zeros(len(part), np.int64)
        forest: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = of_dim(raw, at)
            p = x @ plan.lines(x.shape[1])[0]
            order = np.lexsort((p[:, 0], tb[at], ta[at], cell[at], t[at]))
            at, x, p = at[order], x[order], p[order]
            key = np.stack((t[at], cell[at], ta[at], tb[at]))
            group = np.cumsum(np.concatenate(([0], (key[:, 1:] != key[:, :-1]).any(0).astype(np.int64))))
            cross, side, table_ = ta[at] != tb[at], tile[at], t[at]
            first, code = p[:, 0].copy(), plan.codes(p[:, 1:])
            label = np.arange(len(at))
            every, known = np.zeros((len(at), plan.tables), np.int64), np.zeros(len(at), bool)

            def verify(i: np.ndarray, j: np.ndarray) -> None:
                """Links among candidate pairs: counts and classes."""
                nonlocal label
                keep = ~(cross[i] & (side[i] == side[j]))  # noqa: B023
                i, j = i[keep], j[keep]
                keep = np.einsum("ij,ij->i", x[i], x[j]) >= plan.cosine  # noqa: B023
                i, j = i[keep], j[keep]
                # a pair counts in the first table that it shares
                new = np.unique(np.concatenate((i, j)))
                new = new[~known[new]]  # noqa: B023
                for few in np.split(new, range(2000, len(new), 2000)):
                    if len(few):
                        every[few], known[few] = cells_of(plan, x[few]), True  # noqa: B023
                early = (every[i] == every[j]) & (np.arange(plan.tables)[None, :] < table_[i][:, None])  # noqa: B023
                keep = ~early.any(1)
                i, j = i[keep], j[keep]
                np.add.at(links, at[i], weight[at[j]])  # noqa: B023
                np.add.at(links, at[j], weight[at[i]])  # noqa: B023
                while len(i):  # classes within this task
                    a, b = label[i], label[j]
                    keep = a != b
                    i, j, a, b = i[keep], j[keep], a[keep], b[keep]
                    if not len(i):
                        break
                    np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                    while ((short := label[label]) != label).any():
                        label = short

            # how many of the next rows lie in a row's group and first window
            line = group * 1000.0 + first
            span = np.searchsorted(line, line + plan.first, "right") - 1 - np.arange(len(at))
            left = np.cumsum(np.bincount(span)[::-1])[::-1]  # rows with a partner at each distance
            alive, found, n_found = None, [], 0
            for step in range(1, len(left)):
                # where many rows have one, whole runs are compared, else the rows one by one
                runs = 4 * left[step] > len(at) - step
                if not runs:
                    alive = np.flatnonzero(span >= step) if alive is None else alive[span[alive] >= step]
                for lo in range(0, len(at) - step if runs else len(alive), PAIRS):
                    if runs:
                        hi = min(lo + PAIRS, len(at) - step)
                        hits = collisions(code[lo:hi], code[lo + step : hi + step]) >= plan.threshold
                        i = np.flatnonzero(hits & (span[lo:hi] >= step)) + lo
                    else:
                        i = alive[lo : lo + PAIRS]
                        i = i[collisions(code.take(i, 0), code.take(i + step, 0)) >= plan.threshold]
                    found.append((i, i + step))
                    n_found += len(i)
                    if n_found >= PAIRS:
                        verify(*(np.concatenate(c) for c in zip(*found)))
                        found, n_found = [], 0
            if n_found:
                verify(*(np.concatenate(c) for c in zip(*found)))
            moved = label != np.arange(len(at))
            forest.append((rep[at[moved]], rep[at[label[moved]]]))
        some = links > 0
        out = [pd.DataFrame({"rep": rep[some], "other": -1, "links": links[some]}).groupby(["rep", "other"], as_index=False).sum()]
        out += [pd.DataFrame({"rep": a, "other": b, "links": -1}).drop_duplicates() for a, b in forest]
        return pd.concat(out, ignore_index=True).astype("int64")

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.mapInArrow(_normal, "vec_id long, key binary, v binary")
    rows = checkpoint(rows)
    reps = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("v").alias("v"))
    reps = checkpoint(reps)
    plan = Plan(n := reps.count(), cosine)
    cells = reps.select("rep", "weight", "v").repartition(max(8, n // 20_000)).mapInArrow(_cells(plan), "rep long, weight long, v binary, t int, cell long")
    cells = tiled(cells, "cell", F.xxhash64("rep"), TILE_ROWS)
    n_buckets = max(1, -(-n * plan.tables // BUCKET_ROWS))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("cell", "tile_a", "tile_b"), F.lit(n_buckets)))
    found = checkpoint(cells.groupBy("bucket").applyInPandas(_bucket(plan), "rep long, other long, links long"))
    joined = components(found.filter("links < 0").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    links = found.filter("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    reps = reps.select("key", "rep", "weight").join(links, "rep", "left").join(joined, reps.rep == joined.node, "left")
    reps = reps.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "key").join(reps, "key", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95::DOUBLE * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
