"""What an audit leaves behind: a report, the run history, and a cleaned copy of the dataset.

Everything is written by Spark, so that a target can lie in any store that Spark writes. Small
documents (``info.json``, a report) are folders of one part; the readers here take folders and files.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import documents, export, history, overview, report
from tidemark.operators.verdict import CRITICAL, VERDICTS
from tidemark.sources import layouts


REPORT = "dataset struct<path:string,num_episodes:long>, episodes array<struct<episode_index:long,num_frames:long,verdict:string,metrics:map<string,struct<availability:string,passed:boolean,measurement:map<string,double>>>>>"
SNAPSHOT = "name string, run string, episodes long, passes long, review long, excluded long, integrity_pass_rate double, mean_deviation_score double, median_deviation_score double, n_stuck long, n_frozen long, n_jittery long, n_inefficient long, n_unusual long, sync_median double, total_spikes long, occupancy_median double"
ANNOTATOR = ("sample_id", "dataset_alias", "dataset_path", "episode_index", "human_label", "reviewer_id", "review_seconds", "notes")


def save_report(audit: DataFrame, results: DataFrame, path: str, dataset: str = "", info: dict | None = None) -> None:
    """The reports of an audit under ``path``; ``dataset``: where the dataset lies, ``info``: its metadata.

    ``engine``: the engine's report, a file for each document, as ``read_report`` takes it; ``dataset``:
    one document; ``episodes`` and ``metrics``: a JSON row for each episode and each metric result.
    """
    documents.engine_documents(audit, dataset, info).write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{path}/engine")
    documents.dataset_report(audit, dataset, layouts.profile(info or {})).coalesce(1).write.mode("overwrite").json(f"{path}/dataset")
    documents.episode_reports(audit).write.mode("overwrite").json(f"{path}/episodes")
    results.write.mode("overwrite").json(f"{path}/metrics")


def save_csv(audit: DataFrame, path: str, *verdicts: str, decisions: DataFrame | None = None) -> None:
    """The flat export of the episodes, or of those with one of ``verdicts``, as CSV files with a header; ``decisions`` (ep, decision, notes) are the user's."""
    rows = audit.filter(F.col("verdict").isin(*verdicts)) if verdicts else audit
    overview.export_rows(rows, decisions).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """path, num_episodes, dataset, ep, frames, verdict, hard_fail, risk of the judged episodes of JSON reports (one document a file).

    Episodes without frames or without a known verdict are passed over. A file that is no report raises.
    """
    docs = spark.read.schema(REPORT).option("multiLine", True).json(path).withColumn("source", F.col("_metadata.file_path"))
    docs = docs.withColumn("episodes", F.coalesce("episodes", F.raise_error(F.concat(F.lit("no report with a list of episodes: "), F.col("source"))).cast("array<struct<episode_index:long,num_frames:long,verdict:string,metrics:map<string,struct<availability:string,passed:boolean,measurement:map<string,double>>>>>")))
    rows = docs.select("source", F.coalesce("dataset.path", F.lit("")).alias("dataset_path"), F.explode("episodes").alias("e"))
    stem = F.regexp_extract("source", r"([^/]+?)(\.[^./]*)?$", 1)
    name = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace("dataset_path", "/+$", ""), r"([^/]+)$", 1), F.lit("")), stem)
    m = lambda metric, key: F.coalesce(F.try_element_at(F.col(f"e.metrics.{metric}.measurement"), F.lit(key)), F.lit(None))
    failed = lambda k: F.coalesce((F.col(f"e.metrics.{k}.availability") == "available") & ~F.col(f"e.metrics.{k}.passed"), F.lit(False))
    hard = reduce(lambda a, b: a | b, [failed(k) for k in CRITICAL])
    figures = rows.select("source", name.alias("dataset"), "dataset_path", F.col("e.episode_index").alias("ep"), F.col("e.num_frames").alias("frames"), F.upper("e.verdict").alias("verdict"), hard.alias("hard_fail"), m("action_discontinuity", "spike_count").alias("spike_count"), m("idle_ratio", "effective_motion_ratio").alias("effective_motion_ratio"), m("velocity_acceleration", "acceleration_spikes").alias("acc_spikes"))
    return figures.filter((F.coalesce("frames", F.lit(0)) > 0) & F.col("verdict").isin(*VERDICTS)).withColumn("risk", export.risk_points()).drop("spike_count", "effective_motion_ratio", "acc_spikes")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """ep, decision, notes from a JSON document that maps an episode's number to its decision."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,struct<decision:string,notes:string>>")).alias("ep", "d"))
    return pairs.select(F.col("ep").cast("long").alias("ep"), "d.decision", "d.notes")


def save_blind_sample(rows: DataFrame, sample: DataFrame, path: str) -> None:
    """``path/annotator``: a CSV that tells neither verdict nor risk; ``path/private``: JSON rows that do.

    ``rows`` as ``read_report`` gives them, ``sample`` as ``export.blind_sample`` picked them. A sample is small: one part.
    """
    both = sample.join(rows, ["dataset", "ep"]).orderBy("sample_id").coalesce(1)
    empty = F.lit("")
    blind = both.select("sample_id", F.col("dataset").alias("dataset_alias"), "dataset_path", F.col("ep").alias("episode_index"), *[empty.alias(c) for c in ANNOTATOR[4:]])
    blind.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{path}/annotator")
    both.write.mode("overwrite").json(f"{path}/private")


def save_snapshot(audit: DataFrame, name: str, run: str, path: str) -> None:
    """Adds one run to the history under ``path``, a folder by dataset; the same run again replaces itself."""
    row = report.snapshots(audit, F.lit(name), F.lit(run)).drop("name", "run")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/name={name}/run={run}")


def load_history(spark: SparkSession, path: str | None) -> DataFrame:
    """Every stored run; ``report.trend`` takes it. No path, no folder or a file that cannot be read: no rows from there."""
    return _stored(spark, path, SNAPSHOT)


def save_state(audit: DataFrame, name: str, run: str, part: str, path: str) -> None:
    """Adds the state of one part of a run under ``path``; the same part again replaces itself, other parts stay."""
    state = history.states(audit, F.lit(name), F.lit(run)).drop("name", "run")
    state.coalesce(1).write.mode("overwrite").parquet(f"{path}/name={name}/run={run}/part={part}")


def load_states(spark: SparkSession, path: str | None) -> DataFrame:
    """The merged state of every stored run; ``history.snapshots`` takes it. As ``load_history`` with what is not there or broken."""
    return history.merged(_stored(spark, path, history.STATE))


def _stored(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    nothing = spark.createDataFrame([], schema)
    if path is None:
        return nothing
    try:
        rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return nothing
        raise
    return rows.select(nothing.columns)


def load_labels(spark: SparkSession, path: str, samples: DataFrame | None = None) -> DataFrame:
    """ep or sample_id, label, seconds from a CSV file with a header; a byte order mark does no harm.

    With ``samples`` (sample_id, ...) the labels must be of these, of each one and of each once, or it
    is an error; the result then has the samples' columns too. Blank or unknown labels raise.
    """
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    names = {c.lstrip("\ufeff").strip().lower(): c for c in rows.columns}
    col = lambda k: F.col(f"`{names[k]}`")
    label = col("human_label") if "human_label" in names else col("label")
    own = ([col("episode_index").cast("long").alias("ep")] if samples is None else [F.trim(col("sample_id")).alias("sample_id")]) + [export.normalise_label(label).alias("label")]
    own += [F.nullif(F.trim(col("review_seconds")), F.lit("")).cast("double").alias("seconds")] if "review_seconds" in names else []
    got = rows.select(*own)
    if samples is None:
        return got
    for what, bad in {"unknown": got.join(samples, "sample_id", "left_anti"), "duplicate": got.groupBy("sample_id").count().filter("count > 1"), "missing": samples.join(got, "sample_id", "left_anti")}.items():
        if found := bad.select("sample_id").head(5):
            raise ValueError(f"{what} sample_id in the labels: {', '.join(str(r.sample_id) for r in found)}")
    return samples.join(got, "sample_id")


def write_document(spark: SparkSession, text: str, path: str) -> None:
    """A small document: one file where the path is on this machine, else a folder of one part that Spark writes; readers here take both."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if path.startswith("file:") or ("://" not in path and spark.conf.get("spark.master", "").startswith("local")):
        Path(plain).parent.mkdir(parents=True, exist_ok=True)
        Path(plain).write_text(text, encoding="utf-8")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def clean_dataset(spark: SparkSession, source: str, decisions: DataFrame, target: str) -> None:
    """Copies the kept episodes of ``source``, all columns, to ``target`` as one v3.0 layout.

    Ids that were removed go from the metadata too, and the totals of ``info.json`` are those of what
    stays. An episode without a decision stays. Nothing kept: the schema stays.
    """
    info = layouts.load_info(spark, source)
    version = layouts.layout_version(info, spark, source)
    gone = decisions.filter(~F.col("kept")).select(F.col("ep").alias("episode_index")).distinct()
    rows = spark.read.parquet(f"{source}/data/chunk-*/*.parquet")
    if version == "v2.1":
        rows = rows.withColumn("episode_index", F.regexp_extract(F.col("_metadata.file_path"), r"episode_(\d+)", 1).cast("long"))
    rows.join(gone, "episode_index", "left_anti").write.mode("overwrite").parquet(f"{target}/data/chunk-000")
    layouts.episodes_meta(spark, source, version).join(gone, "episode_index", "left_anti").write.mode("overwrite").parquet(f"{target}/meta/episodes/chunk-000")

    kept = layouts.episodes_meta(spark, target, "v3.0")
    frames = spark.read.parquet(f"{target}/data/chunk-000").count()
    info |= {"codebase_version": "v3.0", "total_episodes": kept.count(), "total_frames": frames}
    write_document(spark, json.dumps(info), f"{target}/meta/info.json")
