"""Structured Streaming over files of events: what arrives is worked off once (available now) into a table of the
shared folder, with a checkpoint there, so that a restarted job goes on where it stopped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """Stream of the files ``name``.parquet in a folder, with ``ts`` as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Work off what is there and give the resulting table."""
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        write = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def run_updates(stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Work off what is there in update mode: a batch appends the rows that it changed, with its number, and the table read back has the
    last row of each key. Nothing is rewritten, and with a watermark the state holds no more than what may still change."""
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    write = lambda df, batch: df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/out/part={batch}")
    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_last")).select(*keys, "_last.*")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts and sums of windows by type. A window is closed, and its state dropped, once events are ``late`` past its end; rows that come
    later still are left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users. Session windows have no update mode: run to a table in complete mode this keeps every session in its state, for a
    bounded backlog; with a watermark on ``events`` and append mode, closed sessions only."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event once, however often its file is delivered; keys are kept for as long as rows may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
