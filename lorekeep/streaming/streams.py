"""Structured Streaming forms: running posteriors, recall counts by time, sessions, first events, ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import lifecycle, writes
from lorekeep.session import shared_folder


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream, with the schema of what lies there."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.rpartition("/")[2] == name for f in batch.inputFiles()):
        # A stream's source is a folder: of a single file, its folder filtered by its name.
        reader, path = reader.option("pathGlobFilter", name), folder
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append", new: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is available into a table in the shared folder, and returns the table.

    Nothing is held on the driver. Each micro-batch writes a folder of its number, so a repeated batch
    replaces its rows; in ``complete`` mode each batch replaces the table. A name used before goes on where its
    stream stopped, so another stream needs another name. ``new`` picks a batch's rows given
    what the batches before have written.
    """
    spark, schema = stream.sparkSession, stream.schema
    at = f"{shared_folder(spark)}/streams/{name}"

    def rows(before: int) -> DataFrame:
        return spark.read.schema(schema.add("_batch", "long")).parquet(f"{at}/rows").filter(F.col("_batch") < before).drop("_batch")

    def write(batch: DataFrame, number: int) -> None:
        out = new(batch, rows(number)) if new else batch
        number = 0 if mode == "complete" else number
        out.write.mode("overwrite").parquet(f"{at}/rows/_batch={number}")

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{at}/rows/_batch=-1")
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).queryName(name).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{at}/checkpoint").start().awaitTermination()
    return rows(1 << 62)


def first_to_table(events: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The first event of each key, however late a repetition comes: the written table is the state, not the stream's memory."""
    return drain(events, name, new=lambda batch, before: batch.dropDuplicates(keys).join(before.select(*keys), keys, "left_anti"))


def outcomes(events: DataFrame) -> DataFrame:
    """Running Beta posterior of each lesson over a stream ``(id, outcome, used)``; state is two sums a lesson (update or complete mode)."""
    return lifecycle.reinforce(events)


def recalls_by_time(events: DataFrame, at: str, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``(window, recalls)``: tumbling counts by event time; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(at, late).groupBy(F.window(at, every)).agg(F.count("*").alias("recalls"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(key, window, n)``: event-time sessions closed by a gap."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))


def first_events(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key's events once within the watermark: the idempotent write of repeated deliveries."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def co_occurrences(a: DataFrame, b: DataFrame, late: str = "1 hour", minutes: int = 30) -> DataFrame:
    """Stream-stream interval join of two streams ``(s, id, at)`` on the session, the second at most so much later."""
    x = a.select(F.col("s").alias("s1"), F.col("id").alias("source_id"), F.col("at").alias("t1")).withWatermark("t1", late)
    y = b.select(F.col("s").alias("s2"), F.col("id").alias("target_id"), F.col("at").alias("t2")).withWatermark("t2", late)
    near = f"s1 = s2 and source_id <> target_id and t2 >= t1 and t2 <= t1 + interval {minutes} minutes"
    return x.join(y, F.expr(near)).select("source_id", "target_id", "t1", "t2")


def unexpired(rows: DataFrame, expires: str = "expires_at", at: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Rows whose expiry lies after their own event time or that never expire."""
    return rows.withWatermark(at, late).filter(F.col(expires).isNull() | (F.col(expires) > F.col(at)))


def version_stream(rows: DataFrame, name: str) -> DataFrame:
    """Bitemporal versions of a stream of lessons: rows are written as they come, validity follows from the event times.

    A late row thus closes the version before it and is closed by the next, as if it had come in time.
    """
    return writes.versions(drain(rows, name))


def ingest_stream(batches: DataFrame, current: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None], dim: int, checkpoint: str):
    """Starts continuous ingestion: each micro-batch is gated and enriched against the current lessons, then written.

    ``write`` gets accepted and refused rows and the batch number, by which it can tell a repeated batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        accepted, refused = writes.ingest(batch, current(), dim)
        write(accepted, refused, number)

    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
