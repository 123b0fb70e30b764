"""Audit files as they arrive: every check is a function of one file, so a micro-batch
of new files is audited like a small corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.audit import Audit


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of file rows from a folder of parquet file tables."""
    schema = "file_id STRING, path STRING, file_name STRING, ext STRING, content STRING"
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def audit_stream(
    files: DataFrame, output: str, checkpoint: str, **options
) -> StreamingQuery:
    """Write findings per micro-batch. The batch id names the folder and the write
    replaces it, so a batch that is repeated after a failure leaves no duplicates."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        found = Audit(batch, **options).findings().withColumn("batch_id", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        files.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
