"""Cutting lineage in iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a session of one process may lack one)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="codestrata-")


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, deleted at the end."""
    name = f"{shared_folder(spark)}/passing-{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        remove(spark, name)
