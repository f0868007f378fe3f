"""Import events as a stream: the latest stage of each import, an addition to the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "import_id string, stage string, message string, created_at timestamp"


def read_events(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    return spark.readStream.schema(EVENT).parquet(folder).withWatermark("created_at", late)


def latest_stage(events: DataFrame) -> DataFrame:
    """Works on batches and streams alike (update mode)."""
    return events.groupBy("import_id").agg(F.max_by("stage", "created_at").alias("status"), F.count("*").alias("event_count"), F.max("created_at").alias("updated_at"))


def stages_by_window(events: DataFrame, width: str = "10 minutes") -> DataFrame:
    return events.groupBy(F.window("created_at", width), "stage").agg(F.count("*").alias("event_count"))
