"""Graph patterns over streams: stateless patterns, and counts in windows of event time.

A streaming table is registered like any other; patterns that only scan, filter, project and join static tables
translate to a streaming DataFrame as they are.  Windowed counts add a watermark, so state stays bounded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.engine import Engine
from trellis.sources.storage import shared_dir


def stream_parquet(engine: Engine, name: str, folder: str, pattern: str = "*", files_per_batch: int = 8) -> None:
    """Register a folder of parquet files as a stream; its schema is that of the files there now."""
    schema = engine.spark.read.parquet(f"{folder}/{pattern}").schema
    stream = engine.spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    engine.register_table(name, stream)


def windowed_counts(solutions: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Solutions counted by window of ``time`` and keys; rows later than ``late`` are dropped by the watermark."""
    timed = solutions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))


def run_once(df: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and return what it wrote; checkpoints and output lie in the shared folder."""
    spark = df.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def daily_counts(engine: Engine, sf_dir: str) -> DataFrame:
    """Events by day and type through a stream.

    Append mode gives a window when the watermark passes its end; so that the last windows come out of a bounded run
    too, the stream is counted by micro-batch into partial counts that are summed at the end.
    """
    stream_parquet(engine, "events", sf_dir, "events.parquet")
    solutions = engine.query("SELECT ?t ?kind WHERE { ?e v:eventTime ?t ; v:eventType ?kind }")
    days = solutions.select(F.date_trunc("day", "t").alias("day"), "kind")
    spark = engine.spark
    base = f"{shared_dir(spark).rstrip('/')}/daily-{uuid.uuid4().hex}"

    def partial(batch: DataFrame, number: int) -> None:
        batch.groupBy("day", "kind").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    spark.createDataFrame([], "day timestamp, kind string, n long").write.parquet(f"{base}/out/batch=-1")  # a stream without rows has an answer too
    days.writeStream.foreachBatch(partial).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("day", "kind").agg(F.sum("n").alias("n"))


def hourly_counts(engine: Engine, sf_dir: str) -> DataFrame:
    """Events by hour and type, as far as the watermark (ten minutes behind the latest event) has closed the hours."""
    stream_parquet(engine, "events", sf_dir, "events.parquet")
    solutions = engine.query("SELECT ?t ?kind WHERE { ?e v:eventTime ?t ; v:eventType ?kind }")
    found = run_once(windowed_counts(solutions, "t", ["kind"], "1 hour", "10 minutes"), "hourly")
    return found.select(F.col("w.start").alias("hour"), "kind", "n")
