"""The two on-disk dataset layouts as frames.

v3.0: ``data/chunk-*/file-*.parquet`` with many episodes a file and ``meta/episodes/chunk-*/*.parquet``;
v2.1: ``data/chunk-*/episode_*.parquet``, one episode a file, and ``meta/episodes.jsonl``. All paths
are read by Spark, so the dataset can lie in any store that Spark reads.
"""

from __future__ import annotations

import json

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import features, files

DEFAULT_FPS = 50.0


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def load_info(spark: SparkSession, path: str) -> dict:
    """``meta/info.json``: one small file; FileNotFoundError without it."""
    if not _there(spark, f"{path}/meta/info.json"):
        raise FileNotFoundError(f"{path}/meta/info.json")
    return json.loads(spark.read.text(f"{path}/meta/info.json", wholetext=True).first()[0])


def feature_kind(name: Column) -> Column:
    """modality, action or null by the prefix of a feature's name."""
    return F.when(name.startswith("observation."), "modality").when((name == "action") | name.startswith("action."), "action")


def feature_label(name: Column) -> Column:
    """The feature's name without its prefix, which is taken off once."""
    return F.regexp_replace(name, r"^(observation|action)\.", "")


def feature_keys(spark: SparkSession, info: dict) -> DataFrame:
    """kind, label of every observation and action feature of ``info``; no features: no rows."""
    rows = spark.createDataFrame([(k,) for k in info.get("features") or {}], "name string")
    return rows.select(feature_kind(F.col("name")).alias("kind"), feature_label(F.col("name")).alias("label")).filter("kind is not null")


def profile(info: dict) -> dict:
    """robot, dof, fps and tasks as the metadata say; dof is else the number of action features, a missing fps is not guessed."""
    actions = [k for k in info.get("features") or {} if k == "action" or k.startswith("action.")]
    dof = int(info.get("action_dim") or info.get("dof") or len(actions)) if actions else 0
    return {"robot": info.get("robot_type") or info.get("robot") or "unknown", "dof": dof, "fps": float(info["fps"]) if info.get("fps") else None, "tasks": int(info.get("total_tasks") or info.get("num_tasks") or 0)}


def layout_version(info: dict, spark: SparkSession | None = None, path: str | None = None) -> str:
    """By ``codebase_version``; without one by which metadata are there, v3.0 if none are."""
    said = str(info.get("codebase_version", "")).lower().lstrip("v")
    if said.startswith("2"):
        return "v2.1"
    if not said.startswith("3") and spark is not None and _there(spark, f"{path}/meta/episodes.jsonl"):
        return "v2.1"
    return "v3.0"


def episodes_meta(spark: SparkSession, path: str, version: str, most: int | None = None) -> DataFrame:
    """One row per episode, the first ``most`` as stored; a file pointer in it is not used, so a stale one does no harm.

    Metadata that are missing or empty are an error.
    """
    where = f"{path}/meta/episodes.jsonl" if version == "v2.1" else f"{path}/meta/episodes/chunk-*/*.parquet"
    if not _there(spark, where):
        raise FileNotFoundError(where)
    rows = spark.read.json(where) if version == "v2.1" else spark.read.parquet(where)
    if "episode_index" not in rows.columns or rows.isEmpty():
        raise ValueError(f"{where} lists no episodes")
    if most is None:
        return rows
    stored = [F.monotonically_increasing_id()] if version == "v2.1" else [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    order = [c.alias(f"_order{i}") for i, c in enumerate(stored)]
    return rows.select("*", *order).orderBy(*[f"_order{i}" for i in range(len(order))]).limit(most).select(*[f"`{c}`" for c in rows.columns])


def data_glob(path: str, version: str) -> str:
    return f"{path}/data/chunk-*/" + ("episode_*.parquet" if version == "v2.1" else "*.parquet")


def _canonical(raw: DataFrame, version: str, every: list[features.Feature]) -> DataFrame:
    """ep, file, row, t, action, state and the counts of all features, from files of one schema."""
    own, names = features.registry(raw.schema), raw.columns
    name = lambda c: F.col(f"`{c}`")
    flat = lambda f: features.values(f) if f is not None else F.lit(None).cast("array<double>")
    action, state = features.primary_action(own), features.state_vector(own)
    stored = name("episode_index").cast("long") if "episode_index" in names else F.lit(None).cast("long")
    said = F.regexp_extract(F.col("_metadata.file_path"), r"episode_(\d+)\.parquet$", 1).cast("long")
    time = name("timestamp") if "timestamp" in names else F.lit(None)
    if "timestamp" in names and raw.schema["timestamp"].dataType.typeName() == "array":
        time = F.get(time, F.lit(0))
    others = [features.values(f) for f in own if f.numeric and f not in (action, state)]
    numbers = F.concat(*[F.coalesce(v, F.array().cast("array<double>")) for v in others]) if others else F.array().cast("array<double>")
    many = lambda test: F.size(F.filter(numbers, test)).cast("long")
    more = {"cells": F.size(numbers).cast("long"), "nan_cells": many(F.isnan), "inf_cells": many(lambda x: F.abs(x) == float("inf"))}
    if every:
        more["features"] = features.counted(own, every)
    for k, kind in (("reward", "double"), ("done", "boolean")):
        column = name(f"next.{k}") if f"next.{k}" in names else F.lit(None)
        if f"next.{k}" in names and raw.schema[f"next.{k}"].dataType.typeName() == "array":
            column = F.get(column, F.lit(0))
        more[k] = column.cast(kind)
    if version == "v2.1" and "episode_index" in names:  # a file holds its own episode only
        raw = raw.filter(stored == said)
    return raw.select((said if version == "v2.1" else stored).alias("ep"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), time.cast("double").alias("t"), flat(action).alias("action"), flat(state).alias("state"), *[c.alias(k) for k, c in more.items()])


def scan_frames(spark: SparkSession, path: str, info: dict) -> DataFrame:
    """All frames of all files that can be read, with file and row: one scan for each group of files whose schemas agree.

    Files without a footer are passed over, and what one file lacks is null in its frames: no column of
    any file is left out. No readable file: no rows.
    """
    version = layout_version(info, spark, path)
    groups = files.schema_groups(spark, data_glob(path, version))
    every = list({f.key: f for schema, _ in groups for f in features.registry(schema)}.values())
    parts = [_canonical(files.read_group(spark, schema, paths), version, every) for schema, paths in groups]
    if not parts:
        return spark.createDataFrame([], "ep long, file string, row long, t double, action array<double>, state array<double>, cells long, nan_cells long, inf_cells long, reward double, done boolean")
    return reduce(DataFrame.unionByName, parts)


def read_frames(spark: SparkSession, path: str, info: dict, skipped_files: DataFrame | None = None) -> DataFrame:
    """ep, fi, t, action, state of all frames in the order they are stored, reward and done, and what is counted of each feature.

    action is the primary action feature (``features.primary_action``), state is observation.state if
    it is a list. cells, nan_cells and inf_cells count the other numeric features, ``features`` has a
    field for every feature. Picture columns never reach the scan. Of v2.1 files of one episode the
    last by name counts. Frames of ``skipped_files`` (file) are left out; see ``files.broken_files``.
    """
    version, fps = layout_version(info, spark, path), float(info.get("fps") or DEFAULT_FPS)
    rows = scan_frames(spark, path, info)
    if skipped_files is not None:
        rows = rows.join(skipped_files.select("file"), "file", "left_anti")
    by = Window.partitionBy("ep")
    if version == "v2.1":
        rows = rows.withColumn("last", F.max("file").over(by)).filter("file = last").drop("last")
    rows = rows.withColumn("fi", F.row_number().over(by.orderBy("file", "row")) - 1)
    more = [c for c in rows.columns if c not in ("ep", "fi", "t", "action", "state", "file", "row")]
    return rows.select("ep", "fi", F.coalesce("t", F.col("fi") / F.lit(fps)).alias("t"), "action", "state", *more)


def ragged_episodes(frames: DataFrame) -> DataFrame:
    """Episodes with a feature that has more than one shape, or without counted features an action or state of more than one width."""
    if "features" in frames.columns:
        return features.ragged(frames)
    widths = frames.groupBy("ep").agg(*[(F.min(F.size(c)) != F.max(F.size(c))).alias(c) for c in ("action", "state")])
    return widths.filter("action or state").select("ep")


def broken_episodes(meta: DataFrame, version: str, broken: DataFrame) -> DataFrame:
    """ep, reason of the episodes whose file is ``broken`` (file, reason): by the file's name in v2.1, by the metadata's pointer in v3.0."""
    if version == "v2.1":
        own = broken.select(F.regexp_extract("file", r"episode_(\d+)\.parquet$", 1).cast("long").alias("ep"), F.concat_ws(" ", "reason", F.lit("file")).alias("reason"))
        return own.join(meta.select("ep").distinct(), "ep", "left_semi")
    if not {"data/chunk_index", "data/file_index"} <= set(meta.columns):
        return meta.select("ep", F.lit("").alias("reason")).limit(0)
    pointer = F.format_string("chunk-%03d/file-%03d.parquet", F.col("`data/chunk_index`").cast("long"), F.col("`data/file_index`").cast("long"))
    ends = broken.select(F.regexp_extract("file", r"([^/]+/[^/]+)$", 1).alias("pointer"), "reason")
    return meta.select("ep", pointer.alias("pointer")).join(ends, "pointer").select("ep", F.concat_ws(" ", "reason", F.lit("file")).alias("reason"))


def skipped_episodes(frames: DataFrame, meta: DataFrame, version: str, broken: DataFrame | None = None) -> DataFrame:
    """ep, reason of the episodes that an audit leaves out.

    Ragged ones; those of ``meta`` (ep, in v3.0 with the stored pointers) whose file is ``broken`` (file,
    reason); and in v2.1 those of ``meta`` without a file. An episode has one reason, in this order
    broken, ragged, missing.
    """
    none = frames.sparkSession.createDataFrame([], "ep long, reason string")
    bad = none if broken is None else broken_episodes(meta, version, broken)
    ragged = ragged_episodes(frames).withColumn("reason", F.lit("ragged")).join(bad.select("ep"), "ep", "left_anti")
    found = bad.unionByName(ragged)
    if version != "v2.1":
        return found
    absent = meta.select("ep").distinct().join(frames.select("ep").distinct(), "ep", "left_anti").join(bad.select("ep"), "ep", "left_anti")
    return found.unionByName(absent.withColumn("reason", F.lit("missing file")))


def dataset_info(meta: DataFrame, info: dict, frames: DataFrame | None = None) -> DataFrame:
    """episodes, frames: from ``info`` where it has both, else from the metadata.

    Metadata without lengths: as many ``frames`` as the first listed episode has, times the episodes;
    without ``frames`` null.
    """
    length = F.sum("length") if "length" in meta.columns else F.lit(None).cast("long")
    got = meta.agg(F.count("*").alias("episodes"), length.alias("frames"))
    if "length" not in meta.columns and frames is not None:
        first = meta.select(F.col("episode_index").cast("long").alias("ep")).limit(1)
        many = frames.join(F.broadcast(first), "ep", "left_semi").agg(F.count("*").alias("first"))
        got = got.withColumn("one", F.lit(1)).join(many.withColumn("one", F.lit(1)), "one").select("episodes", (F.col("episodes") * F.col("first")).alias("frames"))
    if info.get("total_episodes") and info.get("total_frames"):
        return got.select(F.lit(int(info["total_episodes"])).cast("long").alias("episodes"), F.lit(int(info["total_frames"])).cast("long").alias("frames"))
    return got
