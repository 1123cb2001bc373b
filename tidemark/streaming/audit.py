"""Audits of episodes as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators import verdict

FRAMES = "ep long, fi long, t double, action array<double>, state array<double>"


def read_frames(spark: SparkSession, path: str, schema: StructType | str = FRAMES, files: int | None = None) -> DataFrame:
    """Frames from a folder that receives Parquet files, at most ``files`` of them at a time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def audit_stream(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit what has arrived, batch by batch, into ``path/batch=N``, then stop.

    A file holds whole episodes, so each batch does too. A batch that runs again after a failure
    overwrites its own folder, so each episode is audited once.
    """

    def audit(batch: DataFrame, number: int) -> None:
        verdict.judged(verdict.scalars(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frame_rates(frames: DataFrame, window: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """ep, start, frames of each time window; frames later than ``late`` behind the newest are passed over."""
    rows = frames.withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withWatermark("at", late)
    return rows.groupBy("ep", F.window("at", window).alias("w")).agg(F.count("*").alias("frames")).select("ep", F.col("w.start").alias("start"), "frames")
