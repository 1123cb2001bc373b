"""Numbers over a whole table in an order, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in ``order``, which must tell all rows apart.

    Rows are dealt by ranges of the order and sorted there; a row's number is its place in its part
    and the rows of the parts before, counted once. The dealt table is persisted, as counts and places
    must be of the same ranges.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_at", 33)  # the upper bits are the part, the lower ones the place in it
    sizes = sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a part
    before, starts = 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    table = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(table), part == F.col("_part")).withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")
