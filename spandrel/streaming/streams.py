"""Streams: micro-batches, task state, debounced diagnostics, circuit breaker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spandrel.operators.storage import shared_folder

OPEN_AFTER, RETRY_MS, CLOSE_AFTER = 10, 15_000, 1


def source(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The Parquet file or folder ``path`` as a stream of bounded micro-batches."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame:
    """Run ``stream`` until its source is empty, into files; return what it wrote. Complete mode keeps the last batch only.

    ``folder`` keeps rows and checkpoint: a later call with it goes on where the last one ended, with its state.

    Every micro-batch overwrites the folder of its own epoch, so one that is run again after a failure is not there twice. A batch whose ``each``
    raises ends the stream with that error, and nothing of it is written.
    """
    spark = stream.sparkSession
    out = folder or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        if each:
            each(batch, epoch)
        batch.write.mode("overwrite").parquet(f"{out}/data" if mode == "complete" else f"{out}/data/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    written = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{out}/data")
    return written.select(*stream.columns)


def attempted(stream: DataFrame, work: Callable[[DataFrame], DataFrame], schema: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run ``stream`` until its source is empty; a batch whose ``work`` fails goes to a ledger, and the next ones go on.

    Returns what ``work`` made of the good batches (of ``schema``), and the ledger: epoch, files and error of each failed one. Both are kept by epoch, and an epoch that is run
    again replaces its rows in both, so a batch that fails and later passes is in one of them.
    """
    spark = stream.sparkSession
    out = folder or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    ledger = "epoch long, files array<string>, error string"

    def run(batch: DataFrame, epoch: int) -> None:
        at, failed = f"epoch={epoch}", []
        try:
            work(batch.drop("_file")).write.mode("overwrite").parquet(f"{out}/data/{at}")
        except Exception as e:  # whatever the work raises is the batch's result
            files = sorted(r[0] for r in batch.select("_file").distinct().collect())  # a trigger bounds them
            failed = [(epoch, files, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")]
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/data/{at}")
        spark.createDataFrame(failed, ledger).write.mode("overwrite").parquet(f"{out}/ledger/{at}")

    named = stream.withColumn("_file", F.col("_metadata.file_path"))
    named.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()
    of = lambda kind, columns: spark.read.schema(columns).option("recursiveFileLookup", True).parquet(f"{out}/{kind}")
    return of("data", schema), of("ledger", ledger)


def debounced(diagnostics: DataFrame, key: str, ts: str, gap: str, delay: str, order: str) -> DataFrame:
    """The last row of each burst: rows of a key less than ``gap`` apart. A burst is emitted when the watermark passes its end."""
    rest = [c for c in diagnostics.columns if c not in (key, ts)]
    bursts = diagnostics.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max_by(F.struct(*rest), order).alias("r"), F.count("*").alias("n"))
    return bursts.select(key, F.col("w.start").alias("burst_start"), "n", *(F.col(f"r.{c}").alias(c) for c in rest))


def breaker_step(state: tuple[str, int, int, int], at_ms: int, ok: bool, business: bool) -> tuple[str, int, int, int]:
    """Next (state, failures in a row, opened at, successes). An open breaker lets one call try after RETRY_MS; errors of the business do not count."""
    name, failures, opened, successes = state
    if name == "OPEN":
        if at_ms - opened < RETRY_MS:
            return state
        name, successes = "HALF_OPEN", 0
    if business:
        return name, failures, opened, successes
    if ok:
        successes += 1
        return ("CLOSED", 0, opened, 0) if name == "HALF_OPEN" and successes >= CLOSE_AFTER else (name, 0, opened, successes)
    failures += 1
    return ("OPEN", failures, at_ms, 0) if name == "HALF_OPEN" or failures >= OPEN_AFTER else (name, failures, opened, successes)


def breaker(calls: DataFrame) -> DataFrame:
    """key, id and state after each call (key, id, at_ms, ok, business); each key's state lives in the state store."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("CLOSED", 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "id"])
        seen = []
        for at, ok, business in zip(rows["at_ms"], rows["ok"], rows["business"], strict=True):
            now = breaker_step(now, int(at), bool(ok), bool(business))
            seen.append(now[0])
        state.update(now)
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "state": seen})

    return calls.groupBy("key").applyInPandasWithState(run, "key long, id long, state string", "name string, failures long, opened long, successes long", "append", GroupStateTimeout.NoTimeout)
