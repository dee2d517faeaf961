"""Sinks for foreachBatch. A batch writes below its own number and overwrites what is there, so a batch that runs again after a
crash leaves one copy; readers see all numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.rollups import once
from roadloom.sources.tables import exists, folders


def batch_files(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Parquet of each batch, as batch_id=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return write


def several(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several sinks, read once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return write


def ignore_known(path: str, key: str, day: Column | None = None, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Rows whose key no earlier batch has written. then: a sink that gets what was inserted, as it is stored, and nothing else; a batch
    that runs again inserts the same rows, so it gets them again. day: an expression that is the same for all rows of a key; rows are then kept in
    a folder for each day, and a batch looks only at the days of its own rows, however long the history is."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if day is None else batch.withColumn("_day", day)
        written = [f for f in folders(spark, path) if f.startswith("batch_id=") and f != f"batch_id={number}" and exists(spark, f"{path}/{f}/_SUCCESS")] if exists(spark, path) else []
        known = spark.read.parquet(path).where(F.col("batch_id") != number) if written else rows.limit(0)
        if day is not None and "_day" in known.columns:
            known = known.where(F.col("_day").isin([r[0] for r in rows.select("_day").distinct().collect()]))  # the days of one batch
        out = once(rows, known, key).write
        (out if day is None else out.partitionBy("_day")).mode("overwrite").parquet(f"{path}/batch_id={number}")
        if then is not None:
            then(spark.read.schema(rows.schema).parquet(f"{path}/batch_id={number}").drop("_day"), number)

    return write


def stored_after(rows: DataFrame, at: str, stored: Column | None = None) -> DataFrame:
    """(n, p50_ms, p95_ms, late): how long after the event's own time (`at`, milliseconds) the rows were stored, now if no time is given;
    what is stored before its own time, by a clock that is ahead, counts as 0. late: rows over a minute."""
    now = F.unix_millis(F.current_timestamp()) if stored is None else stored
    wait = F.when(F.col(at).isNotNull(), F.greatest(now - F.col(at), F.lit(0)))
    return rows.agg(F.count(at).alias("n"), F.percentile(wait, 0.5).alias("p50_ms"), F.percentile(wait, 0.95).alias("p95_ms"), F.count_if(wait > 60_000).alias("late"))


def keyed_by_time(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events with their own time as the record's time: state about what is older than the latest by the delay may be given up."""
    return events.withWatermark(ts, delay)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id", "_day")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Takes all that is there, in micro-batches, and stops."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
