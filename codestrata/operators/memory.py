"""Conversation sessions, import events, and stores of tables by repository."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import remove

MESSAGE = "session_id string, repository_path string, seq long, role string, content string, metadata string, created_at timestamp"


class ConversationStore:
    """Messages as appended Parquet, in the order of their times; a session belongs to one repository."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def messages(self, session_id: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(MESSAGE).parquet(self.folder)
        except Exception as error:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], MESSAGE)
        return rows.filter(F.col("session_id") == session_id).orderBy("seq")

    def remember(self, repository: str, question: str, answer: str, metadata: str = "{}", session_id: str | None = None) -> str:
        session_id = session_id or str(uuid.uuid4())
        known = self.messages(session_id).agg(F.count("*"), F.min("repository_path")).first()
        if known[0] and known[1] != repository:
            raise ValueError("this session belongs to another repository")
        now, at = datetime.now(timezone.utc), time.time_ns()
        rows = [(session_id, repository, at + k, role, text, metadata if k else "{}", now) for k, (role, text) in enumerate((("user", question), ("assistant", answer)))]
        self.spark.createDataFrame(rows, MESSAGE).write.mode("append").parquet(self.folder)
        return session_id


def sessions(messages: DataFrame) -> DataFrame:
    """A row a session of (session_id, role, content, created_at): messages, questions, characters, last time."""
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.count_if(F.col("role") == "user").alias("question_count"), F.sum(F.length("content")).alias("n_chars"), F.max("created_at").alias("updated_at"))


def latest_events(events: DataFrame) -> DataFrame:
    """import_id, status, message and number of events by (import_id, stage, message, created_at)."""
    return events.groupBy("import_id").agg(F.max_by(F.struct("stage", "message"), "created_at").alias("x"), F.count("*").alias("event_count"), F.max("created_at").alias("updated_at")).select("import_id", F.col("x.stage").alias("status"), "x.message", "event_count", "updated_at")


def replace_repository(df: DataFrame, folder: str, repository: str, unique: list[str] | None = None) -> None:
    """Replace the rows of one repository: a dynamic overwrite of its partition, which goes if there are none."""
    df = df.persist()
    try:
        if unique and not df.groupBy(*unique).count().filter("count > 1").isEmpty():
            raise ValueError(f"repeated key {unique}")
        if df.isEmpty():
            name = df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repository)
            remove(df.sparkSession, f"{folder}/repository_path={name}")
        df.withColumn("repository_path", F.lit(repository)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_path").parquet(folder)
    finally:
        df.unpersist()


def read_repository(spark: SparkSession, folder: str, repository: str, *order: str) -> DataFrame:
    """The rows of one repository (partition pruning); KeyError without any."""
    rows = spark.read.option("mergeSchema", True).parquet(folder).filter(F.col("repository_path") == repository)
    if rows.isEmpty():
        raise KeyError(repository)
    return rows.orderBy(*order) if order else rows


def with_fallback(primary, fallback) -> bool:
    """Call ``primary``; on any error ``fallback``.  Whether the first one worked."""
    try:
        primary()
        return True
    except Exception:
        fallback()
        return False
