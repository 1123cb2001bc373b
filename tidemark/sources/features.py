"""The features of a dataset, read from its schema: what is scanned, which one is the action, what is counted.

Columns ``observation.*`` and ``action`` or ``action.*`` are features. A feature's values are numbers,
lists of numbers or lists of lists, which are laid out flat; everything else is known by name and type
only. An exact ``action`` column stands alone, as the only action feature.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

PICTURES = ("image", "video")
# The action features that are taken first, and names of number types.
PREFERRED = ("joint_pos", "position", "action")
NUMBERS = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}
FLOATING = ("float32", "float64")
STATE = "observation.state"


@dataclass(frozen=True)
class Feature:
    """name as stored; kind: observation or action; dtype as of its numbers; depth: 0 for a number a frame, 1 for a list, and so on."""

    name: str
    kind: str
    dtype: str
    depth: int

    @property
    def label(self) -> str:
        """The name without its prefix, which is taken off once."""
        return self.name.split(".", 1)[1] if "." in self.name else self.name

    @property
    def key(self) -> str:
        """The name in reports: kind and label."""
        return f"{self.kind}.{self.label}"

    @property
    def numeric(self) -> bool:
        return self.dtype in NUMBERS.values()


def _unwrapped(kind: DataType) -> tuple[str, int]:
    depth = 0
    while isinstance(kind, ArrayType):
        kind, depth = kind.elementType, depth + 1
    return NUMBERS.get(kind.simpleString(), kind.simpleString()), depth


def registry(schema: StructType) -> list[Feature]:
    """The features of a schema, in its order; pictures are left out."""
    alone = "action" in schema.names
    out = []
    for field in schema:
        name = field.name
        if name.startswith("observation."):
            if not any(p in name.lower() for p in PICTURES):
                out.append(Feature(name, "observation", *_unwrapped(field.dataType)))
        elif name == "action" or (name.startswith("action.") and not alone):
            out.append(Feature(name, "action", *_unwrapped(field.dataType)))
    return out


def primary_action(features: list[Feature]) -> Feature | None:
    """joint_pos, position or action if there is one, else the first of lists of floating numbers, else the first of all."""
    own = [f for f in features if f.kind == "action"]
    by_label = {f.label: f for f in reversed(own)}
    for label in PREFERRED:
        if label in by_label:
            return by_label[label]
    return next((f for f in own if f.depth and f.dtype in FLOATING), own[0] if own else None)


def state_vector(features: list[Feature]) -> Feature | None:
    """observation.state if it is a list; one number a frame is no vector."""
    return next((f for f in features if f.name == STATE and f.depth and f.numeric), None)


def values(feature: Feature) -> Column:
    """A frame's numbers as one flat list of doubles; null where the frame has none or the feature is not of numbers."""
    if not feature.numeric:
        return F.lit(None).cast("array<double>")
    column, number = F.col(f"`{feature.name}`"), F.lit(None)
    for _ in range(feature.depth - 1):
        column = F.flatten(column)
    number = column.cast("array<double>") if feature.depth else F.when(column.isNotNull(), F.array(column.cast("double")))
    return number


def widths(feature: Feature) -> Column:
    """A frame's shape: its lengths from the outside in; lists of unequal lengths inside show as -1."""
    column, out = F.col(f"`{feature.name}`"), []
    for level in range(feature.depth):
        out.append(F.size(column) if level == 0 else F.when(F.array_min(F.transform(column, F.size)) == F.array_max(F.transform(column, F.size)), F.array_max(F.transform(column, F.size))).otherwise(-1))
        column = column if level == 0 else F.flatten(column)
    return F.when(F.col(f"`{feature.name}`").isNotNull(), F.array(*out).cast("array<int>"))


def counted(features: list[Feature], every: list[Feature] | None = None) -> Column:
    """One struct a frame with a field for each feature: cells, nan, inf, shape, dtype; a field is null where the frame has no value.

    ``every``: the features of all files; those that this one lacks are null.
    """
    own = {f.name: f for f in features}

    def one(feature: Feature) -> Column:
        mine = own.get(feature.name)
        if mine is None:
            return F.lit(None).cast("struct<cells:int,nan:int,inf:int,shape:array<int>,dtype:string>")
        flat = values(mine)
        many = lambda test: F.coalesce(F.size(F.filter(flat, test)), F.lit(0))
        return F.when(
            F.col(f"`{mine.name}`").isNotNull(),
            F.struct(F.coalesce(F.size(flat), F.lit(0)).alias("cells"), many(F.isnan).alias("nan"), many(lambda x: F.abs(x) == float("inf")).alias("inf"), widths(mine).alias("shape"), F.lit(mine.dtype).alias("dtype")),
        )

    return F.struct(*[one(f).alias(f.key) for f in every or features])


def keys(frames: DataFrame) -> list[str]:
    """The features that ``frames`` counts, in order."""
    return frames.schema["features"].dataType.names if "features" in frames.columns else []


def feature_counts(frames: DataFrame) -> DataFrame:
    """ep, feature, dtype, shape, frames, n, cells, nan, inf, numeric, dropped, mismatched: a row for each feature of each episode.

    n counts the frames that have a value. A numeric feature is dropped if n is not that of
    observation.state, or without one the largest n; any feature is mismatched if n is not the
    episode's number of frames. Shapes and types are those of the episode's own file.
    """
    names = keys(frames)
    field = lambda k, c: F.col("features").getField(k).getField(c)
    one = lambda k: F.struct(
        F.lit(k).alias("feature"), F.max(field(k, "dtype")).alias("dtype"), F.max(field(k, "shape")).alias("shape"), F.count(F.col("features").getField(k)).alias("n"),
        *[F.coalesce(F.sum(field(k, c)), F.lit(0).cast("long")).alias(c) for c in ("cells", "nan", "inf")],
    )
    if not names:
        return frames.sparkSession.createDataFrame([], "ep long, feature string, dtype string, shape array<int>, frames long, n long, cells long, nan long, inf long, numeric boolean, dropped boolean, mismatched boolean")
    got = frames.groupBy("ep").agg(F.count("*").alias("frames"), F.array(*map(one, names)).alias("f"))
    numeric = lambda x: x["dtype"].isin(*NUMBERS.values())
    got = got.withColumn("f", F.filter("f", lambda x: x["dtype"].isNotNull()))
    some = F.filter("f", numeric)
    state = F.get(F.filter(some, lambda x: x["feature"] == STATE), F.lit(0))["n"]
    got = got.withColumn("want", F.coalesce(state, F.array_max(F.transform(some, lambda x: x["n"]))))
    rows = got.select("ep", "frames", "want", F.explode("f").alias("x")).select("ep", "x.feature", "x.dtype", "x.shape", "frames", "x.n", "x.cells", "x.nan", "x.inf", numeric(F.col("x")).alias("numeric"), "want")
    return rows.select("*", (F.col("numeric") & (F.col("n") != F.col("want"))).alias("dropped"), (F.col("n") != F.col("frames")).alias("mismatched")).drop("want")


def feature_lists(frames: DataFrame) -> DataFrame:
    """ep, by_feature_frame_count, dropout_features, length_mismatches, checked_features, by_feature: the lists that integrity metrics report.

    by_feature maps a numeric feature to its nan and inf cells and all cells.
    """
    rows = feature_counts(frames)
    entry = lambda value: F.collect_list(F.when(F.col("numeric"), F.struct("feature", value)))
    names = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("feature"))))
    return rows.groupBy("ep").agg(
        F.map_from_entries(entry(F.col("n"))).alias("by_feature_frame_count"),
        names(F.col("dropped")).alias("dropout_features"),
        names(F.col("mismatched")).alias("length_mismatches"),
        names(F.col("numeric")).alias("checked_features"),
        F.map_from_entries(entry(F.struct(F.col("nan").alias("nan_count"), F.col("inf").alias("inf_count"), F.col("cells").alias("total_cells")).alias("cells"))).alias("by_feature"),
    )


def ragged(frames: DataFrame) -> DataFrame:
    """Episodes with a feature whose frames differ in shape: these are no arrays and the episode is skipped."""
    names = keys(frames)
    shape = lambda k: F.col("features").getField(k).getField("shape")
    uneven = [F.coalesce((F.min(shape(k)) != F.max(shape(k))) | F.bool_or(F.array_contains(shape(k), -1)), F.lit(False)) for k in names]
    return frames.groupBy("ep").agg(F.greatest(*uneven, F.lit(False), F.lit(False)).alias("ragged")).filter("ragged").select("ep")
