"""Language identification by nearest centroids of TF-IDF character n-grams.

A text is lower-cased, each run of anything but letters becomes a space, and its 1- to
3-grams are hashed to ``DIM`` signed counts, so that chance collisions cancel; signed square
roots of counts times IDF, scaled to length 1, are its vector.  Each language has up to
``CLUSTERS`` centroids (spherical k-means), and a text gets the language of the centroid of
largest cosine, which is its score.

Rejection is by distance: a text is rejected if it has no letter, or if its cosine is below
the floor of its language for its number of n-grams.  The floors are ``MARGIN`` times the
lowest thousandth of the cosines of the sample itself: of whole texts and of passages of
``PASSAGES`` characters out of their middle, since short texts have small cosines.

The classifier learns from a bounded sample: ``SAMPLE_ROWS`` labelled rows over all languages,
as many of each, ``MOST_ROWS`` at most and ``LEAST_ROWS`` at least (so the bound is LEAST_ROWS
a language where there are very many), chosen by a hash of doc_id and text; repeated rows
count once.  Predictions
use the text only.

Defined cases: a letter is what Unicode calls one (categories L*; not digits, numerals or
marks); a null text or one without a letter is ``und`` with score 0; no labelled row at all
makes every text ``und``; null labels teach nothing; null doc_ids teach like others; repeated
rows get a row each; very long texts are read whole, in pieces; extra columns are kept by
``keep_known``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, slices, table

DIM = 4096
CLUSTERS = 3
SAMPLE_ROWS, LEAST_ROWS, MOST_ROWS = 6_400, 16, 800
PASSAGES = (32, 256)
MARGIN, LOWEST = 0.8, 0.001
STEPS = 24
PIECE = 1 << 18
MAYBE = re.compile(r"[^\W\d_]+")

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter; ``\\w`` takes numerals too."""
    return bool(text) and any(any(map(str.isalpha, m.group())) for m in MAYBE.finditer(text))


def counts(text: str) -> np.ndarray:
    """Hashed signed 1- to 3-gram counts of a whole text."""
    out = np.zeros(DIM)
    tail = np.array([32], np.uint64)  # the last two characters before; n-grams within them were counted
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        c = np.where(_letters()[np.minimum(c, 0x10FFFF)], c, 32).astype(np.uint64)
        c = np.concatenate((tail, c, np.full(int(at + PIECE >= len(text)), 32, np.uint64)))
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        back = len(tail)
        two = c[:-1] * np.uint64(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint64(0x85EBCA77) + c[2:]
        one = c[back:]
        for n, h in ((1, one[one != 32]), (2, two[back - 1 :]), (3, three[max(0, back - 2) :])):
            h = (h + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
            both = np.bincount((h >> np.uint64(40)).astype(np.int64) & (2 * DIM - 1), minlength=2 * DIM)
            out += both[:DIM] - both[DIM:]
        tail = c[-2:]
    return out


def roots(text: str) -> np.ndarray:
    m = counts(text)
    return (np.sign(m) * np.sqrt(np.abs(m))).astype(np.float32)


def n_grams(m: np.ndarray) -> np.ndarray:
    """About the number of n-grams of each row of signed square roots."""
    return (m * m).sum(1)


def scaled(m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    m = m * idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [x.mean(0)]
    near = x @ seeds[0]
    for _ in range(min(k, len(x)) - 1):
        seeds.append(x[int(near.argmin())])
        near = np.maximum(near, x @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def step(n: np.ndarray) -> np.ndarray:
    """Class of a number of n-grams: its power of 2."""
    return np.clip(np.log2(np.maximum(n, 1)).astype(int), 0, STEPS - 1)


class LanguageModel:
    """Languages, the language of each centroid, centroids, IDF and floors (language, step)."""

    def __init__(self, langs: list[str], owner: np.ndarray, centroids: np.ndarray, idf: np.ndarray, floors: np.ndarray):
        self.langs, self.owner, self.centroids, self.idf, self.floors = langs, owner, centroids, idf, floors

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        lang, score, rejected = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
        good = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for at in range(0, len(good), 256):
            rows = good[at : at + 256]
            m = np.stack([roots(texts[i]) for i in rows])
            cos = scaled(m, self.idf) @ self.centroids.T
            best = cos.argmax(1)
            top = np.clip(cos[np.arange(len(rows)), best], 0.0, 1.0)
            mine = self.owner[best]
            lang[rows] = [self.langs[k] for k in mine]
            score[rows], rejected[rows] = top, top < self.floors[mine, step(n_grams(m))]
        return lang, score, rejected


NOTHING = LanguageModel([], np.zeros(0, int), np.zeros((0, DIM)), np.ones(DIM), np.zeros((0, STEPS)))


def floors_of(cos: np.ndarray, owner: np.ndarray, at: np.ndarray, n_langs: int) -> np.ndarray:
    """Floors by language and step, from the own cosines of texts and passages.

    A step with few of them has the floor of a smaller one, and none falls with the length;
    languages with few rows have the least floor of all languages with enough, or none.
    """
    out = np.full((n_langs, STEPS), np.nan)
    for k in range(n_langs):
        c, s = cos[owner == k], at[owner == k]
        for i in np.unique(s).tolist():
            if (s == i).sum() >= 50:
                out[k, i] = np.quantile(c[s == i], LOWEST)
    out = np.fmax.accumulate(out, axis=1)  # nothing falls with the length
    filled = np.isfinite(out)
    least = np.array([np.nanmin(out[:, i]) if filled[:, i].any() else 0.0 for i in range(STEPS)])
    return MARGIN * np.where(filled.any(1)[:, None], np.nan_to_num(out), np.maximum(least, 0.0)[None, :])


def fit(got: pd.DataFrame) -> LanguageModel:
    """From rows of lang, whole (or a passage) and v (signed square roots)."""
    langs = sorted(got["lang"].unique())
    if not langs:
        return NOTHING
    y, whole, raw = np.searchsorted(langs, got["lang"].to_numpy()), got["whole"].to_numpy(bool), got["v"].to_numpy()
    x = np.stack([unpacked(v) for v in raw[whole]])
    idf = (np.log((1 + len(x)) / (1 + (x != 0).sum(0))) + 1).astype(np.float32)
    x = scaled(x, idf)
    parts = [k_means(x[y[whole] == k], CLUSTERS) for k in range(len(langs))]
    del x
    owner = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
    centroids = np.concatenate(parts).astype(np.float32)
    own, at = np.zeros(len(raw)), np.zeros(len(raw), int)
    for lo in range(0, len(raw), 1024):
        few = slice(lo, lo + 1024)
        m = np.stack([unpacked(v) for v in raw[few]])
        own[few] = np.where(owner[None, :] == y[few, None], scaled(m, idf) @ centroids.T, -1).max(1)
        at[few] = step(n_grams(m))
    return LanguageModel(langs, owner, centroids, idf, floors_of(own, y, at, len(langs)))


def packed(v: np.ndarray) -> bytes:
    """A vector, as places and values where most are zero."""
    at = np.flatnonzero(v)
    return v.tobytes() if len(at) * 6 >= 4 * DIM else at.astype(np.uint16).tobytes() + v[at].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == 4 * DIM:
        return np.frombuffer(raw, np.float32)
    n, out = len(raw) // 6, np.zeros(DIM, np.float32)
    out[np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw, np.float32, offset=2 * n)
    return out


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on (doc_id, text, lang)."""
    labelled = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang IS NOT NULL AND text IS NOT NULL")
    labelled = labelled.withColumn("h", F.xxhash64("doc_id", "text", F.lit("sample")))
    sizes = checkpoint(labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")))
    n_langs = sizes.count()
    if not n_langs:
        return NOTHING
    each = max(LEAST_ROWS, min(MOST_ROWS, sample_rows // n_langs))
    unit = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    rows = labelled.join(F.broadcast(sizes) if n_langs <= BROADCAST_ROWS else sizes, "lang").filter(unit < F.lit(float(each)) / F.col("n"))
    rows = rows.groupBy("lang", "h").agg(F.first("text").alias("text"))  # equal rows once

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for lang, h, text in zip(part["lang"], part["h"], part["text"]):
                if not has_letter(text):
                    continue
                out.append((lang, h, True, packed(roots(text))))
                for n in PASSAGES:
                    passage = text[(len(text) - n) // 2 :][:n] if len(text) > 2 * n else ""
                    if has_letter(passage):
                        out.append((lang, h, False, packed(roots(passage))))
            yield pd.DataFrame(out, columns=["lang", "h", "whole", "v"])

    got = rows.mapInPandas(run, "lang string, h long, whole boolean, v binary").toPandas()
    return fit(got.sort_values(["lang", "h", "whole", "v"]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Each row's doc_id with lang_pred, score and rejected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            lang, score, rejected = model.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows that are not rejected, with all their columns; learns from them."""
    model = train(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            yield part.filter(pa.array(~model.predict(part.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0
    out = predict(docs, train(docs.filter(~F.coalesce(held("doc_id"), F.lit(False)))))
    return out.select("doc_id", F.coalesce(held("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
