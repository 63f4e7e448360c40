"""Running a stream to completion over landed files, with sinks that survive a retry."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.results import shared_folder


def files_as_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, per_batch: int | None = None) -> DataFrame:
    """Files of a folder as they land, ``per_batch`` of them at most in a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def run_available(stream: DataFrame, mode: str, out: str | None = None, checkpoint: str | None = None) -> str:
    """Process everything available into a Parquet folder and return it.

    Each micro-batch replaces its own ``batch`` partition, so a batch retried after a failure
    leaves one copy; append mode uses the transactional file sink.
    """
    spark = stream.sparkSession
    out = out or shared_folder(spark)
    checkpoint = checkpoint or shared_folder(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        def save(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    return out


def read_back(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(out)


def account_late(stream: DataFrame, measure: Callable[[DataFrame], DataFrame], out: str | None = None) -> str:
    """Write one summary per micro-batch: late rows, backlog and totals."""
    spark = stream.sparkSession
    out = out or shared_folder(spark)

    def save(df: DataFrame, batch: int) -> None:
        measure(df).withColumn("batch_id", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", shared_folder(spark)).foreachBatch(save).start().awaitTermination()
    return out


def collect_daily(stream: DataFrame, out: str, checkpoint: str, partition: str) -> None:
    """Append landed rows once, however often the job is run."""

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").partitionBy(partition).parquet(f"{out}/batch={batch}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(save).start().awaitTermination()


class BatchLedger(StreamingQueryListener):
    """What one query's micro-batches read, kept and dropped: one small row per batch."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.run = None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.run = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.runId != self.run:
            return
        seen = {name: row["n"] for name, row in p.observedMetrics.items()}
        if "read" in seen:
            late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            repeated = sum(int(o.customMetrics.get("numDroppedDuplicateRows", 0)) for o in p.stateOperators)
            self.rows.append((p.batchId, seen["read"], seen.get("kept", 0), late, repeated))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.ended.set()


def keep_once(stream: DataFrame, keys: list[str], event_time: str, delay: str, out: str | None = None) -> tuple[str, DataFrame]:
    """Append each record once and reconcile every batch: read = kept + late + repeated.

    A record is ``keys`` with its event time.  Rows older than the watermark that the batch before began with are late
    (Spark filters by that one, so a batch right after a jump in time is spared); both counts come from the operator that drops them, read and kept from metrics observed before and after it.  Rows without an event time
    are neither late nor forgotten: they are kept once.  Gives the folder and the ledger (batch_id, read, kept, late,
    repeated); the state of a record ends with the watermark.  Queries started meanwhile in the session are not counted.
    """
    spark = stream.sparkSession
    out = out or shared_folder(spark)
    once = stream.observe("read", F.count(F.lit(1)).alias("n")).withWatermark(event_time, delay).dropDuplicates([*keys, event_time])
    ledger = BatchLedger()
    spark.streams.addListener(ledger)
    try:
        query = once.observe("kept", F.count(F.lit(1)).alias("n")).writeStream.trigger(availableNow=True).outputMode("append").option(
            "checkpointLocation", shared_folder(spark)).format("parquet").option("path", out).start()
        query.awaitTermination()
        ledger.ended.wait(60)
    finally:
        spark.streams.removeListener(ledger)
    return out, spark.createDataFrame(sorted(ledger.rows), "batch_id bigint, read bigint, kept bigint, late bigint, repeated bigint")
