"""Tables written to cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    """A folder of this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="spandrel-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """The application's part of ``spark.checkpoint.dir``; where that is unset, a folder of this process if the master is local, else an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/spandrel/{context.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; later stages restart from its files when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Texts can be long: about ``size`` bytes of them go to Python at once; a longer text goes alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many parts as the session shuffles into. Short strings pack well, so parts that adaptive execution joins until they have its
    size in files are many times that size in a task; these stay apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def clean(spark: SparkSession) -> None:
    """Remove all that this application wrote; frames read from it are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
