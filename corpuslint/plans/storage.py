"""Results that several steps read, computed once on shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; never a local temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir or pass a path on shared storage")
    return folder.rstrip("/")


def saved(frame: DataFrame) -> DataFrame:
    """The rows of ``frame``, computed once into the checkpoint folder. A session that names none gets a folder of its own
    if it runs on one machine, as in tests; on a cluster that is an error."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        local = context.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-") if local else shared_folder(spark))
    return frame.checkpoint()
