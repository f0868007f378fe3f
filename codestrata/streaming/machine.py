"""Imports as a state machine over a stream of events, one state an import.

Stages follow each other by ``ALLOWED``; an event that its import's stage does not allow is
rejected and changes nothing.  An import that is under way and hears nothing for ``STUCK`` fails:
by a timer once the watermark has passed, or as soon as a later event of it arrives.  After its
end an import begins anew by ``queued``.

Events of an import are judged in the order of their times within a batch; ties go by event id.
The state store and what is judged survive in the checkpoint, so a restarted query goes on
where it stopped.  Events without a key, a time or a stage are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The stages that may follow a stage; none begins.
ALLOWED = {
    None: ("queued",), "queued": ("validating", "failed"), "validating": ("cloning", "extracting", "failed"), "cloning": ("completed", "failed"), "extracting": ("completed", "failed"),
    "completed": ("queued",), "failed": ("queued",),
}
ENDS = ("completed", "failed")
STUCK = timedelta(days=1)
STATE = "stage string, since timestamp, attempt int"
JUDGED = "import_id long, event_id long, at timestamp, stage string, verdict string, attempt int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ImportMachine(StatefulProcessor):
    def __init__(self, stuck: timedelta = STUCK):
        self.stuck = stuck

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("import", STATE)

    def _late(self, stage, since, at) -> bool:
        return stage not in (None, *ENDS) and since + self.stuck <= at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((r.at, r.event_id, r.stage) for part in rows for r in part.itertuples())
        stage, since, attempt = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for at, event_id, named in events:
            at = at.to_pydatetime()
            if self._late(stage, since, at):
                out.append((key[0], None, since + self.stuck, "failed", "stuck", attempt))
                stage, since = "failed", since + self.stuck
            if named in ALLOWED[stage]:
                attempt += named == "queued"
                stage, since = named, at
                out.append((key[0], event_id, at, named, "accepted", attempt))
            else:
                out.append((key[0], event_id, at, named, "rejected", attempt))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stage is not None:
            self.state.update((stage, since, attempt))
            if stage not in ENDS:
                self.handle.registerTimer(int((pd.Timestamp(since, tz="UTC") + self.stuck).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=["import_id", "event_id", "at", "stage", "verdict", "attempt"]).astype({"event_id": "Int64", "attempt": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stage, since, attempt = self.state.get()
        if stage in ENDS:
            return
        end = since + self.stuck
        self.state.update(("failed", end, attempt))
        yield pd.DataFrame([(key[0], None, end, "failed", "stuck", attempt)], columns=["import_id", "event_id", "at", "stage", "verdict", "attempt"]).astype({"event_id": "Int64", "attempt": "int32"})

    def close(self) -> None:
        pass


def judged(events: DataFrame, late: str = "10 minutes", stuck: timedelta = STUCK) -> DataFrame:
    """A stream of verdicts on a stream of (import_id, event_id, at, stage)."""
    rows = events.filter("import_id IS NOT NULL AND at IS NOT NULL AND stage IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("import_id").transformWithStateInPandas(statefulProcessor=ImportMachine(stuck), outputStructType=JUDGED, outputMode="append", timeMode="eventTime")


def run_available(spark: SparkSession, events: DataFrame, folder: str, **options) -> DataFrame:
    """Judge all that has arrived, and go on from the last run below the same folder."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        judged(events, **options).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/verdicts").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(JUDGED).parquet(f"{folder}/verdicts")


def imports(verdicts: DataFrame) -> DataFrame:
    """A row an import: its stage, attempts, and events accepted and rejected."""
    good = F.when(F.col("verdict") != "rejected", F.struct("at", (F.col("verdict") == "accepted").alias("later"), "event_id"))
    return verdicts.groupBy("import_id").agg(
        F.max_by("stage", good).alias("status"), F.max("attempt").alias("attempts"), F.count_if(F.col("verdict") == "accepted").alias("accepted"),
        F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.count_if(F.col("verdict") == "stuck").alias("stuck"),
    )
