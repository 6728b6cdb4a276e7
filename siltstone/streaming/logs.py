"""Streams over append-only logs: running ratios, windows per type, limits per client."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def per_window(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and values of each type in each window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def over_limit(events: DataFrame, most: int, length: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Clients with more than `most` events in a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "user_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def running(events: DataFrame) -> DataFrame:
    """Totals of each type so far, for complete or update mode."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def newest(entries: DataFrame, *order: str) -> DataFrame:
    """entries (ref, id, ...) of an append-only log -> ref, entries so far and the newest one's id, for update mode. State is
    one row a ref, however long its log grows."""
    return entries.groupBy("ref").agg(F.count("*").alias("entries"), F.max_by("id", F.struct(*order)).alias("id"))


def answered(wants: DataFrame, takes: DataFrame, ttl: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """wants (request, ts, want), takes (request, ts) -> request, want of the wants taken within their time to live, which
    is for append mode. Each request is wanted and taken once. Watermarks let both sides' state go when it is too old."""
    a = wants.withColumnRenamed("ts", "at").withWatermark("at", late).select("request", "want", "at")
    b = takes.withWatermark("ts", late).select(F.col("request").alias("taken"), F.col("ts").alias("then"))
    lives = (F.col("then") >= F.col("at")) & (F.col("then") <= F.col("at") + F.expr(f"INTERVAL {ttl}"))
    return a.join(b, (F.col("request") == F.col("taken")) & lives).select("request", "want")


def drained(stream: DataFrame, *keys: str, mode: str = "update") -> DataFrame:
    """What the stream gives when all its input is read, the last row of each key; for tests and backfills of bounded input.

    Each batch's changed rows go to the shared folder under the batch's number, so a batch that is done again replaces
    its own; nothing passes the driver."""
    path = graph.scratch(stream.sparkSession, "stream")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{path}/rows")
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).select(*stream.columns)
