"""Exact quantiles without a task that holds all values.

Order statistics are found by refinement: the values between a low and a high bound are counted in
buckets of equal width, the bucket that holds the wanted rank becomes the next range, and so on until a
range has few values left, which are then counted one by one. Each step is one aggregate with at
most ranges x buckets (or few) rows; all columns and ranks go through it together. The ranges of a
column do not overlap, so that a value falls into one of them at most, and they come to the step as a
small table: its plan is the same however many there are. The bucket of a value never falls as the
value grows, whatever the rounding, so ranks stay exact.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
FEW = 1000
LARGEST = sys.float_info.max


class _Range:
    """The values of a column from lo to hi: how many there are, and how many lie below."""

    def __init__(self, column: str, lo: float, hi: float, n: int, below: int):
        self.column, self.lo, self.hi, self.n, self.below = column, lo, hi, n, below

    @property
    def key(self) -> tuple:
        return self.column, self.lo, self.hi


def _bucket(buckets: int) -> Column:
    """The bucket of x between lo and hi."""
    # halves, so that the width of the whole range of doubles is still a number; infinities count as the ends
    lo, hi = F.greatest("lo", F.lit(-LARGEST)) / 2, F.least("hi", F.lit(LARGEST)) / 2
    inside = F.least(F.greatest("x", F.lit(-LARGEST)), F.lit(LARGEST)) / 2
    place = F.least(F.floor((inside - lo) / (hi - lo) * buckets), F.lit(buckets - 1))
    # neighbours among the doubles may have no width
    return F.when(hi > lo, place).when(F.col("x") > F.col("lo"), buckets - 1).otherwise(0)


def _long(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, x: the values that count, in as many parts as tasks run at once: a task keeps counts alone, and many small parts cost a step more than their rows do."""
    doubles = df.coalesce(df.sparkSession.sparkContext.defaultParallelism).select(*[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([], list(columns), "column", "x").filter("x is not null and not isnan(x)")


def _table(df: DataFrame, ranges: list[_Range], few: int) -> DataFrame:
    """i, of, lo, hi, small: the ranges as rows."""
    rows = [F.struct(F.lit(i).alias("i"), F.lit(r.column).alias("of"), F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi"), F.lit(r.n <= few).alias("small")) for i, r in enumerate(ranges)]
    return df.sparkSession.range(0, 1, numPartitions=1).select(F.inline(F.array(*rows)))


def order_statistics(values: DataFrame, wanted: dict[str, list[int]], ends: dict[str, tuple[float, float, int]], buckets: int = BUCKETS, few: int = FEW) -> dict[tuple[str, int], float]:
    """The values at the places (from 0) ``wanted`` of each column in its order; ``ends``: least, largest and number of its values.

    ``values`` (column, x) is read once a step, so what it comes from should be persisted or materialised.
    """
    at = {(c, k): _Range(c, *ends[c], 0) for c, ks in wanted.items() for k in ks}
    found: dict[tuple[str, int], float] = {}
    while True:
        for place, r in list(at.items()):
            if r.lo == r.hi:
                found[place] = r.lo
                del at[place]
        ranges = list({r.key: r for r in at.values()}.values())
        if not ranges:
            return found
        inside = (F.col("column") == F.col("of")) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
        rows = values.join(F.broadcast(_table(values, ranges, few)), inside)
        rows = rows.withColumns({"b": F.when(~F.col("small"), _bucket(buckets)), "one": F.when(F.col("small"), F.col("x"))})
        counts: dict[int, list] = {}
        for row in rows.groupBy("i", "b", "one").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("largest")).collect():  # ranges x buckets rows
            counts.setdefault(row.i, []).append(row)
        for i, r in enumerate(ranges):
            cells = sorted(counts[i], key=lambda row: row.least)
            for place in [p for p, own in at.items() if own.key == r.key]:
                below = r.below
                for row in cells:
                    if place[1] < below + row.n:
                        at[place] = _Range(r.column, row.least, row.largest, row.n, below)
                        break
                    below += row.n


def exact_quantiles(df: DataFrame, columns: tuple[str, ...], shares: tuple[float, ...], buckets: int = BUCKETS, few: int = FEW) -> dict[str, tuple[int, list[float | None]]]:
    """column: (number of values, its quantiles at ``shares``, linear between neighbours); without values nulls. Null and NaN do not count."""
    long = _long(df, columns)
    rows = long.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect()  # a row a column
    ends = {r.column: (r.lo, r.hi, r.n) for r in rows}
    spots = {c: [s * (ends[c][2] - 1) for s in shares] for c in ends}
    wanted = {c: sorted({k for s in spots[c] for k in (math.floor(s), math.ceil(s))}) for c in ends}
    values = order_statistics(long, wanted, ends, buckets, few)

    def between(c: str, spot: float) -> float:
        low, high = math.floor(spot), math.ceil(spot)
        return values[c, low] if low == high else (high - spot) * values[c, low] + (spot - low) * values[c, high]

    return {c: (ends[c][2], [between(c, s) for s in spots[c]]) if c in ends else (0, [None] * len(shares)) for c in columns}


def quantile_table(df: DataFrame, columns: tuple[str, ...], shares: tuple[float, ...] = (0.05, 0.5, 0.95), **how: int) -> DataFrame:
    """metric, available and p05, p50 ... of each column, as a small table; see ``exact_quantiles``."""
    names = [f"p{round(100 * s):02d}" for s in shares]
    got = exact_quantiles(df, columns, shares, **how)
    schema = "metric string, available long, " + ", ".join(f"{n} double" for n in names)
    return df.sparkSession.createDataFrame([(c, n, *ps) for c, (n, ps) in got.items()], schema)


def median_deviations(df: DataFrame, mids: dict[str, float | None], **how: int) -> dict[str, float | None]:
    """column: the median of the distances to its median, which is given."""
    far = df.select(*[F.abs(F.col(c).cast("double") - F.lit(mid)).alias(c) for c, mid in mids.items()])
    return {c: ps[0] for c, (_, ps) in exact_quantiles(far, tuple(mids), (0.5,), **how).items()}
