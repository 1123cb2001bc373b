"""Written intermediate tables in the folder that driver and executors share.

A table written there cuts lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Above this many rows a side is joined by shuffle instead of broadcast (ids: 8 bytes each).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder if all of Spark is this machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-scratch")
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty tables that ``materialize`` gave, once all that was read from them is itself written."""
    for table in tables:
        table.sparkSession.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(table.scratch)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else unhinted (shuffle join).

    ``df`` should be materialised and narrow: its rows are counted here.
    """
    return F.broadcast(df) if df.count() <= limit else df


def attach(rows: DataFrame, marks: DataFrame, key: str, heavy_keys: int = 1024) -> DataFrame:
    """``rows`` with the columns of ``marks`` (a row for each distinct ``key``; n: how many rows have it), nulls together.

    Keys that more than one row in ``heavy_keys`` has are so many at most, whatever the size: these are
    broadcast, so a hot key is never dealt to one task. The others are joined by shuffle. Both tables
    are read twice and should be materialised.
    """
    total = marks.agg(F.sum("n")).first()[0] or 0
    own = marks.drop("n").withColumnRenamed(key, "_key").withColumn("_hit", F.lit(True))
    heavy = marks.filter(F.col("n") * heavy_keys > total).select(F.col(key).alias("_heavy"))
    hot = own.join(F.broadcast(heavy), F.col("_key").eqNullSafe(F.col("_heavy")), "left_semi")
    cold = own.join(F.broadcast(heavy), F.col("_key").eqNullSafe(F.col("_heavy")), "left_anti")
    same = F.col(key).eqNullSafe(F.col("_key"))
    near = rows.join(F.broadcast(hot), same)
    far = rows.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_heavy")), "left_anti").join(cold, same, "left")
    return near.unionByName(far).drop("_key", "_hit")
