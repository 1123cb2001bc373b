"""Sequence primitives over frames: differences, norms, robust statistics, bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BINS = 30
# Frames that a block sees of the one before: the longest window and two differences.
HALO = 22
BROADCAST_EPISODES = 1_000_000


def by_frame() -> WindowSpec:
    return Window.partitionBy("ep").orderBy("fi")


def whole() -> WindowSpec:
    return Window.partitionBy("ep")


def difference(vector: str | Column, by: WindowSpec | None = None) -> Column:
    """Elementwise difference to the frame before; null on the first."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.zip_with(vector, F.lag(vector).over(by or by_frame()), lambda a, b: a - b)


@dataclass(frozen=True)
class Cut:
    """How frames are dealt: an episode whole, or in blocks of ``block`` frames, for episodes longer than a task should sort.

    In blocks the frame number ``fi`` must run from 0 without gaps. A block also gets the ``HALO`` frames
    before it and the one after it (``halo``), so that what looks at neighbours is right for its own
    frames; what needs the whole episode is a grouping joined back. Its table has a row an episode and
    is broadcast if there are at most ``BROADCAST_EPISODES`` (``few``).
    """

    block: int | None = None
    few: bool = True

    @classmethod
    def of(cls, frames: DataFrame, block: int | None) -> Cut:
        if block is None:
            return cls()
        if block <= HALO:
            raise ValueError(f"a block takes more than {HALO} frames")
        return cls(block, frames.select("ep").distinct().limit(BROADCAST_EPISODES + 1).count() <= BROADCAST_EPISODES)

    def deal(self, frames: DataFrame) -> DataFrame:
        if self.block is None:
            return frames
        own, at = F.floor(F.col("fi") / self.block), F.col("fi") % self.block
        more = F.array(own, F.when(at >= self.block - HALO, own + 1), F.when((at == 0) & (own > 0), own - 1))
        return frames.withColumn("block", F.explode(F.filter(more, lambda b: b.isNotNull()))).withColumn("halo", F.col("block") != own)

    def by_frame(self) -> WindowSpec:
        return by_frame() if self.block is None else Window.partitionBy("ep", "block").orderBy("fi")

    def first(self) -> Column:
        """Whether a frame is its episode's first."""
        return F.lag("fi").over(by_frame()).isNull() if self.block is None else F.col("fi") == 0

    def own(self, rows: DataFrame) -> DataFrame:
        """Every frame once."""
        return rows if self.block is None else rows.filter(~F.col("halo")).drop("block", "halo")

    def know(self, rows: DataFrame, known: dict[str, Column], then: dict[str, Column] | None = None) -> DataFrame:
        """``rows`` with aggregates over each whole episode, and in blocks what follows from them alone (``then``)."""
        if self.block is None:
            return rows.withColumns({k: c.over(whole()) for k, c in known.items()})
        table = self.own(rows).groupBy("ep").agg(*[c.alias(k) for k, c in known.items()]).withColumns(then or {})
        return rows.join(F.broadcast(table) if self.few else table, "ep")

    def highest_before(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        """``rows`` with the highest ``value`` of the episode up to each frame."""
        upto = self.by_frame().rowsBetween(Window.unboundedPreceding, 0)
        if self.block is None:
            return rows.withColumn(name, F.max(value).over(upto))
        ends = rows.filter(~F.col("halo")).groupBy("ep", "block").agg(F.max(value).alias("end"))
        carried = F.max("end").over(Window.partitionBy("ep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
        rows = rows.join(ends.select("ep", "block", carried.alias("carried")), ["ep", "block"], "left")
        return rows.withColumn(name, F.greatest(F.max(value).over(upto), "carried")).drop("carried")


WHOLE = Cut()


def norm(vector: str | Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def finite(vector: str | Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def robust(df: DataFrame, value: str) -> DataFrame:
    """Adds med, mad (of non-null values in the episode) and z = 0.6745 (x - med) / mad, 0 where mad is 0."""
    df = df.withColumn("med", F.median(value).over(whole()))
    df = df.withColumn("mad", F.median(F.abs(F.col(value) - F.col("med"))).over(whole()))
    z = F.when(F.col("mad") == 0, 0.0).otherwise(F.try_divide(F.lit(0.6745) * (F.col(value) - F.col("med")), F.col("mad")))
    return df.withColumn("z", F.when(F.col(value).isNotNull(), z))


def edge_bin(value: Column, top: Column, bins: int | Column = BINS) -> Column:
    """The bin of ``value`` over [0, top] by comparison with the edges i * (top / bins); the last is closed."""
    width = top / bins
    guess = F.greatest(F.least(F.floor(F.try_divide(value, width)).cast("int"), F.lit(bins - 1).cast("int")), F.lit(0))
    low = F.when(value < guess * width, guess - 1).otherwise(guess)
    return F.when((low < bins - 1) & (value >= (low + 1) * width), low + 1).otherwise(low)


def valley_threshold(hist: Column, n: Column, top: Column, bins: int | Column = BINS) -> Column:
    """Upper edge of the emptiest bin between the idle peak and the next rise; null if there is none.

    One fold over the bins: ``open`` once a tenth of all steps lie at or below a nearly empty bin,
    ``shut`` at the next rise, ``best`` the emptiest bin (the first of equals) in between.
    """

    def step(s: Column, h: Column) -> Column:
        seen, empty = s["seen"] + h, h / n < 0.01
        opened = s["open"] | ((seen / n >= 0.1) & empty)
        shut = s["shut"] | (s["open"] & (h / n > 0.02))
        better = opened & ~shut & empty & (s["best"].isNull() | (h < s["least"]))
        fields = {"i": s["i"] + 1, "seen": seen, "open": opened, "shut": shut, "best": F.when(better, s["i"]).otherwise(s["best"]), "least": F.when(better, h).otherwise(s["least"])}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    none = {"i": F.lit(0), "seen": F.lit(0).cast("long"), "open": F.lit(False), "shut": F.lit(False), "best": F.lit(None).cast("int"), "least": F.lit(None).cast("long")}
    best = F.aggregate(hist, F.struct(*[c.alias(k) for k, c in none.items()]), step, lambda s: F.when(s["shut"], s["best"]))
    return F.when((n >= 10) & (top > 1e-6), (best + 1) * (top / bins))


def percentiles(value: str, *shares: float) -> Column:
    return F.percentile(value, F.array(*[F.lit(s) for s in shares]))
