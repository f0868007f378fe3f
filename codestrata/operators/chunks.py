"""Chunks of files and symbols, their ids, and embeddings of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

CHUNK_CHARS = 12_000
EMBED_BATCH = 64
_KEPT = "(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])"


def chunk_id(kind: Column, path: Column, start: Column, end: Column, symbol_kind: Column, symbol_name: Column) -> Column:
    head = F.concat_ws(":", kind, path, start.cast("string"), end.cast("string"))
    digest = F.sha2(F.concat_ws(":", head, F.coalesce(symbol_kind, F.lit("")), F.coalesce(symbol_name, F.lit(""))), 256)
    return F.concat(head, F.lit(":"), F.substring(digest, 1, 16))


def file_chunks(files: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Lines packed greedily into chunks of at most ``max_chars``; a longer line is a chunk of its own.

    The packing of a file is one fold over its line lengths.
    """
    kept = F.filter(F.split("text", _KEPT, -1), lambda x: x != "")
    rows = files.filter(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("_lines", kept)
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def put(a: Column, line: Column) -> Column:
        new = (a["n"] == 0) | (a["n"] + F.length(line) > max_chars)
        return F.struct(
            F.when(new, F.concat(a["starts"], F.array(a["at"] + 1))).otherwise(a["starts"]).alias("starts"),
            F.when(new, F.length(line)).otherwise(a["n"] + F.length(line)).alias("n"), (a["at"] + 1).alias("at"))

    rows = rows.withColumn("_starts", F.aggregate("_lines", start, put, lambda a: a["starts"]))
    ends = F.transform("_starts", lambda s, k: F.struct(s.alias("start_line"), (F.coalesce(F.get("_starts", k + 1), F.size("_lines") + 1) - 1).alias("end_line")))
    rows = rows.select("path", "language", "_lines", F.explode(ends).alias("x")).select("path", "language", "x.*", F.array_join(F.slice("_lines", F.col("x.start_line"), F.col("x.end_line") - F.col("x.start_line") + 1), "").alias("content"))
    null = F.lit(None).cast("string")
    return _finish(rows.withColumns({"kind": F.lit("file"), "symbol_kind": null, "symbol_name": null, "symbol_parent": null}))


def symbol_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    kept = F.filter(F.split("text", _KEPT, -1), lambda x: x != "")
    rows = symbols.filter(F.col("kind").isin("class", "function", "interface", "method")).join(files.select("path", "language", kept.alias("_lines")), "path")
    content = F.array_join(F.slice("_lines", F.col("line"), F.col("end_line") - F.col("line") + 1), "")
    rows = rows.select("path", "language", F.col("line").alias("start_line"), "end_line", content.alias("content"), F.lit("symbol").alias("kind"),
                       F.col("kind").alias("symbol_kind"), F.col("name").alias("symbol_name"), F.col("parent").alias("symbol_parent"))
    return _finish(rows.filter(X.strip(F.col("content")) != ""))


def _finish(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumns({"id": chunk_id(c("kind"), c("path"), c("start_line"), c("end_line"), c("symbol_kind"), c("symbol_name")), "char_count": F.length("content")}).select(
        "id", "kind", "path", "language", "content", "start_line", "end_line", "char_count", "symbol_kind", "symbol_name", "symbol_parent")


def chunk_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    a = files.agg(F.count("*").alias("source_file_count"), F.count_if(F.col("text").isNull()).alias("skipped_file_count"))
    b = chunks.agg(F.count_if(F.col("kind") == "file").alias("file_chunk_count"), F.count_if(F.col("kind") == "symbol").alias("symbol_chunk_count"), F.count("*").alias("chunk_count"))
    return a.crossJoin(b)  # one-row tables


def topic_embedding(texts: list[str]) -> list[list[float]]:
    """A deterministic embedder for use without a network: counts of two topics."""
    topics = (("auth", "token", "user"), ("main", "handler", "server"))
    return [[float(sum(t.lower().count(w) for w in words)) or 0.1 for words in topics] for t in texts]


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]] = topic_embedding, batch: int = EMBED_BATCH) -> DataFrame:
    """Chunks that are not blank, with ``embedding``; the embedder gets ``batch`` texts a call."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                got = embedder(rows["content"].tolist())
                if len(got) != len(rows):
                    raise ValueError("the embedder gave another number of vectors")
                yield pd.DataFrame({"id": rows["id"], "embedding": got})

    rows = chunks.filter(X.strip(F.col("content")) != "")
    made = rows.select("id", "content").mapInPandas(run, "id string, embedding array<double>")
    return rows.join(made, "id")
