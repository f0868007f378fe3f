"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import checkpoint, passing, remove, shared_folder
from codestrata.llm.langid import keep_known
from codestrata.llm.mixing import in_written_order, mixed_documents
from codestrata.llm.packing import pack, tokenizer_path
from codestrata.llm.simhash import simhash_dedup, with_fingerprint
from codestrata.llm.substring import dedup_texts

ORACLE_SQL = None  # hashes, tokens and the classifier are not SQL; see tests/llm


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; null ids stay.

    Where several rows have one id, each counts with its own text: one of those in the group
    of that id stays, and the others go like any member of their group.
    """
    groups = simhash_dedup(docs)
    ids = checkpoint(
        groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("c"))
        .filter("n > 1 OR c < doc_id").select("doc_id", (F.col("n") > 1).alias("again"))
    )
    out = docs.join(ids, "doc_id", "left_anti").select(docs.columns)
    if ids.filter("again").isEmpty():
        return out
    rows = docs.join(ids.filter("again"), "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("row"))
    own = groups.filter("component_id = doc_id").select("doc_id", "fp").distinct()
    kept = with_fingerprint(rows).join(own, ["doc_id", "fp"]).groupBy("doc_id").agg(F.min_by("row", F.struct("fp", F.xxhash64("text"))).alias("row"))
    return out.unionByName(kept.select("row.*"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; n_chars follows the text.

    A document all of whose words stand earlier stays as an empty text.
    """
    told = "dedup"
    while told in docs.columns:
        told += "_"
    out = dedup_texts(docs, told=told).drop(told)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, which follow the order of the mix."""
    return pack(in_written_order(docs), tokenizer_path())


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; folders and checkpoints of the others are deleted on the way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    try:
        for name, stage in STAGES:
            with passing(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
            if before:
                remove(spark, f"{at}/{before}")
            before = name
    except BaseException:  # nothing of a run that failed stays
        remove(spark, at)
        raise
    return docs
