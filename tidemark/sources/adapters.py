"""Ordinary tables as frames: ep, fi (from 0), t (seconds), action and state (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def framed(df: DataFrame, ep: Column, order: list[Column], **columns: Column) -> DataFrame:
    """Frames numbered from 0 by ``order`` inside each episode."""
    rows = df.select(ep.cast("long").alias("ep"), *[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(k) for k, c in columns.items()])
    window = Window.partitionBy("ep").orderBy(*[f"o{i}" for i in range(len(order))])
    return rows.withColumn("fi", F.row_number().over(window) - 1).select("ep", "fi", *columns)


def event_frames(events: DataFrame) -> DataFrame:
    """A user is an episode; action [value], state [value, props.k]."""
    value, k = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    return framed(events, F.col("user_id"), [F.col("ts"), F.col("event_id")], t=seconds(F.col("ts")), action=F.array(value), state=F.array(value, k), event_id=F.col("event_id"))


def embedding_frames(embeddings: DataFrame, fps: float = 50.0) -> DataFrame:
    """A label is an episode; action and state are the vector; time from the frame number."""
    vector = F.col("embedding").cast("array<double>")
    rows = framed(embeddings, F.col("label"), [F.col("vec_id")], action=vector, state=vector)
    return rows.withColumn("t", F.col("fi") / F.lit(fps))


def lineitem_frames(lineitem: DataFrame) -> DataFrame:
    """A supplier is an episode with repeated time stamps; ordered by all columns."""
    action = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")])
    order = [F.col("l_shipdate"), *[F.col(c) for c in lineitem.columns if c != "l_shipdate"]]
    return framed(lineitem, F.col("l_suppkey"), order, t=seconds(F.col("l_shipdate")), action=action, state=action)


def event_streams(events: DataFrame) -> DataFrame:
    """Sensor streams: one for each event type of a user."""
    return events.select(F.col("user_id").alias("ep"), F.col("event_type").alias("stream"), seconds(F.col("ts")).alias("t"))
