"""Event streams: windows, sessions and deduplication. An extension; batch tables go through the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with the schema of what is there already; event time is a timestamp in UTC."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_time(reader.parquet(path))


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total: counts and sums of values in tumbling or sliding windows of event time."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """user_id, start, end, n: runs of a user's events with less than `gap` between them."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without those that repeat an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and read its result from files in the folder, which keeps the stream's state too.

    Each batch writes its rows from the executors to a table of its own, so nothing gathers on the driver, and a batch that is run
    again after a failure writes the same table again. In complete mode the last batch's table is the result, else all of them are.
    """
    tables = f"{folder}/rows"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{tables}/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    last = query.lastProgress
    if last is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{tables}/batch={last['batchId']}" if mode == "complete" else tables)
