"""Run history from parts: states of a fixed size that add up.

An audit of a part of a dataset leaves a state: counts, exact decimal sums, and for each figure that
needs a median a histogram whose buckets never change (each a hundredth wider than the one before, with
the least and largest value in it). States of parts merge by sums and extremes, in any order and
grouping, so the state of the parts is that of the whole, and a day's new episodes need no audit of the
old ones. A state has as many rows as there are counts and filled buckets, whatever the number of
episodes.

Counts, rates and sums of a snapshot are exact. A median is exact if the middle values are the ends of
their buckets, else off by at most a hundredth of itself.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.report import HISTORY_PATTERNS, available_deviation, history_pattern
from tidemark.operators.verdict import VERDICTS

STATE = "name string, run string, field string, bucket long, n long, total decimal(38,9), lo double, hi double"
GROWTH = 1.01
NOTHING = -(1 << 31)  # bucket of zero and less
MEDIANS = {"deviation": "median_deviation_score", "sync": "sync_median", "occupancy": "occupancy_median"}
VERDICT_COUNTS = dict(zip(VERDICTS, ("passes", "review", "excluded"), strict=True))
COUNTS = ("episodes", *VERDICT_COUNTS.values(), "sound", *(f"n_{p.lower()}" for p in HISTORY_PATTERNS), "total_spikes")


def _bucket(x: Column) -> Column:
    return F.when(x > 0, F.floor(F.log(x) / math.log(GROWTH)).cast("long")).otherwise(F.lit(NOTHING).cast("long"))


def states(audit: DataFrame, name: Column, run: Column) -> DataFrame:
    """The state of each dataset and run in ``audit`` (one row an episode, see ``verdict.judged``)."""
    pattern = history_pattern()
    counts = {
        "episodes": F.lit(1),
        **{k: (F.col("verdict") == v).cast("int") for v, k in VERDICT_COUNTS.items()},
        "sound": (~F.col("hard_fail")).cast("int"),
        **{f"n_{p.lower()}": (pattern == p).cast("int") for p in HISTORY_PATTERNS},
        "total_spikes": F.col("spike_count"),
    }
    nothing = F.lit(None)
    cells = [F.struct(F.lit(k).alias("field"), nothing.cast("long").alias("bucket"), F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias("n"), nothing.cast("decimal(38,9)").alias("total"), nothing.cast("double").alias("x")) for k, c in counts.items()]
    figures = {"deviation": available_deviation(), "sync": F.col("worst_p95"), "occupancy": F.col("occupancy_rate")}
    for k, c in figures.items():
        x = c.cast("double")
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18)
        cell = F.struct(F.lit(k).alias("field"), _bucket(x).alias("bucket"), F.lit(1).cast("long").alias("n"), x.try_cast("decimal(38,9)").alias("total"), x.alias("x"))
        cells.append(F.when(finite, cell))
    rows = audit.select(name.cast("string").alias("name"), run.cast("string").alias("run"), F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
    return rows.select("name", "run", "c.*").groupBy("name", "run", "field", "bucket").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,9)").alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def merged(*parts: DataFrame) -> DataFrame:
    """One state for each dataset and run from any number of states; an empty one changes nothing."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("name", "run", "field", "bucket").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,9)").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _medians(state: DataFrame) -> DataFrame:
    """name, run and a column for each of ``MEDIANS``: the mean of the two middle places."""
    by = Window.partitionBy("name", "run", "field")  # the buckets of one figure, not its episodes
    rows = state.filter(F.col("bucket").isNotNull()).withColumns({"end": F.sum("n").over(by.orderBy("bucket")), "all": F.sum("n").over(by)})

    def at(place: Column) -> Column:
        inside = place - (F.col("end") - F.col("n"))
        value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.coalesce(F.try_divide(inside, F.col("n") - 1), F.lit(0.0))
        return F.max(F.when((inside >= 0) & (inside < F.col("n")), value))

    low, high = F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)
    mids = rows.groupBy("name", "run", "field").agg(((at(low) + at(high)) / 2).alias("median"))
    return mids.groupBy("name", "run").agg(*[F.max(F.when(F.col("field") == k, F.col("median"))).alias(c) for k, c in MEDIANS.items()])


def snapshots(state: DataFrame) -> DataFrame:
    """The rows that ``report.snapshots`` gives for the same episodes, from their merged state."""
    own = F.col("field")
    counts = state.groupBy("name", "run").agg(
        *[F.sum(F.when(own == k, F.col("n")).otherwise(0)).alias(k) for k in COUNTS],
        F.sum(F.when(own == "deviation", F.col("total"))).cast("double").alias("deviations"),
        F.sum(F.when(own == "deviation", F.col("n"))).alias("judged"),
    )
    rate, mean = F.round(F.col("sound") / F.col("episodes"), 4), F.try_divide(F.col("deviations"), F.col("judged"))
    rows = counts.withColumns({"integrity_pass_rate": rate, "mean_deviation_score": mean}).join(_medians(state), ["name", "run"], "left")
    head = ("episodes", *VERDICT_COUNTS.values(), "integrity_pass_rate", "mean_deviation_score", "median_deviation_score")
    return rows.select("name", "run", *head, *(f"n_{p.lower()}" for p in HISTORY_PATTERNS), "sync_median", "total_spikes", "occupancy_median")
