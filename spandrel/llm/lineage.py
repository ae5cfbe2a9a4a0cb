"""Cutting lineage and bounding Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spandrel.operators.storage import shared_folder

BATCH_BYTES = 16 * 1024 * 1024


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later stages restart from the files when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: at most ``rows`` of them, and about ``BATCH_BYTES``, go to Python at once; a longer text goes alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
