"""Event streams with Structured Streaming: windowed counts with watermarks, and a graph kept as a table of edge states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import shared_dir


def read_events(spark: SparkSession, path: str, pattern: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream."""
    schema = spark.read.parquet(f"{path.rstrip('/')}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by tumbling or sliding event-time windows; events later than `late` are let go."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    agg = _timed(events, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), *keys, "events", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events without a pause of gap."""
    agg = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return agg.select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "events")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet in the shared folder, and read the result."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).format("parquet").option("path", f"{top}/out").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def fold_stream(stream: DataFrame, place: str | None = None) -> DataFrame:
    """(u, v, on): the last state of every edge in a stream of (seq, u, v, on).

    Spark keeps each edge's last state in its state store, beside the offsets that have been read, and each batch writes only the edges that it
    changed, into a folder of the batch's number: a batch that runs again writes the same rows there. Given a place of its own, a later call goes
    on where the last one stopped.
    """
    spark = stream.sparkSession
    top = place or f"{shared_dir(spark).rstrip('/')}/fold-{uuid.uuid4().hex}"
    last = stream.groupBy("u", "v").agg(F.max("seq").alias("seq"), F.max_by("on", "seq").alias("on"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/changes/{number}")

    last.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], last.schema).write.mode("ignore").parquet(f"{top}/changes/none")
    return spark.read.schema(last.schema).option("recursiveFileLookup", "true").parquet(f"{top}/changes").groupBy("u", "v").agg(F.max_by("on", "seq").alias("on"))
