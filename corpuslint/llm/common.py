"""Helpers the operators share: tables, the shared folder and native word expressions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_ROWS = 1000
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started; small Arrow batches."""
    environment = spark.sparkContext.environment
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)  # whole texts are large rows
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session without one (a test) gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(
            context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="shared-")
        )
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """Compute once into the shared folder; survives lost executors."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def saved(frame: DataFrame) -> DataFrame:
    """Computed once into a table of the shared folder. Unlike a checkpoint it carries no inferred constraints along, which
    multiply when a loop joins one step's result in the next."""
    folder = fresh_folder(frame.sparkSession, "saved")
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RUN)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


BROADCAST_IDS = 1_000_000


def checked_broadcast(ids: DataFrame) -> DataFrame:
    """A saved table of ids and hashes, broadcast if there are at most ``BROADCAST_IDS`` (some 24 MB), else as it is."""
    ids = checkpointed(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def smallest_hashes(frame: DataFrame, key: str, most: int, *ties: str) -> DataFrame:
    """A bounded sample: the ``most`` rows with the smallest hash of ``key``. Rows far above that bound are dropped where
    they are, so the tasks together hand on about ``most`` rows, whatever the input."""
    place = F.shiftrightunsigned(F.xxhash64(key), 1)
    share = 1.5 * most / max(1, frame.count())
    some = frame.filter(place < int(share * 2**63)) if share < 1 else frame
    return some.orderBy(place, key, *ties).limit(most)
