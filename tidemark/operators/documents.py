"""Audit results as documents: the engine's report, an episode's and a dataset's report for users.

Everything is made of columns of the audit's own row (``verdict.judged``): the array of results, the
figures and, by broadcast, one row of dataset figures. The engine's report is several documents of a
bounded number of episodes each, every one complete with the dataset's blocks, so no document holds a
whole large dataset; ``sinks.read_report`` reads them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import report, text
from tidemark.operators.verdict import CRITICAL, METRICS, VERDICTS

VERSION = "0.2.0"
EPISODES_A_DOCUMENT = 10_000
# Names of measured figures, by metric, and the audit's column; evidence classes; verdicts for users.
MEASURED = {
    "missing_dropout": {"missing_frames": "missing", "dropout_count": "dropout"},
    "invalid_values": {"total_cells": "cells"},
    "schema_consistency": {"mismatch_count": "mismatched"},
    "timestamp_validity": {"duplicates": "duplicates", "median_dt_ms": "dt_p50"},
    "joint_limit": {"violations": "violations"},
    "sensor_synchronization": {"worst_p95_offset_ms": "worst_p95", "worst_max_offset_ms": "worst_max", "num_pairs": "pairs"},
    "sampling_jitter": {"cv": "cv", "jitter_ms": "dt_std"},
    "velocity_acceleration": {"velocity_p50": "velocity_p50", "velocity_p95": "velocity_p95", "velocity_p99": "velocity_p99", "velocity_max": "velocity_max", "acceleration_spikes": "acc_spikes", "acceleration_spike_rate": "acc_spike_rate"},
    "action_discontinuity": {"spike_count": "spike_count", "spike_rate": "spike_rate", "p95_delta": "delta_p95", "p99_delta": "delta_p99", "max_delta": "delta_max", "max_second_delta": "jump_max"},
    "temporal_sufficiency": {"idle_ratio_total": "idle_total", "transition_count": "transitions"},
    "idle_ratio": {"idle_ratio": "idle_ratio", "effective_motion_ratio": "effective_motion_ratio", "total_steps": "n"},
    "distribution": {"duration_sec": "duration", "path_length": "path_length"},
    "coverage": {"occupancy_rate": "occupancy_rate", "occupied_cells": "occupied"},
}
EVIDENCE = {k: "HARD_FAIL" if k in CRITICAL else "UNVERIFIABLE" if k == "sensor_synchronization" else "RISK_SIGNAL" for k in METRICS if k != "temporal_sufficiency"}
BEHAVIOR_VERDICTS = {"PASS": "LIKELY_USABLE", "REVIEW": "NEEDS_REVIEW", "EXCLUDE": "RECOMMENDED_EXCLUDE"}
READINESS_DETAIL = {"Ready": "Dataset is ready for training.", "Not Ready": "Significant data quality issues detected."}


def _looked_up(pairs: dict[str, str], key: Column, other: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(other))


def evidence_of(metric: Column) -> Column:
    return _looked_up(EVIDENCE, metric, "RISK_SIGNAL")


def code_of(metric: Column) -> Column:
    return _looked_up(report.ISSUE_CODES, metric, "UNK-00")


def _measurement(metric: str) -> Column:
    """The metric's figures that are numbers, as a map, with the compatible score."""
    named = {k: F.col(c).cast("double") for k, c in MEASURED[metric].items()} | {"score_compat": report._state(metric, "score")}
    full = F.create_map(*[x for k, c in named.items() for x in (F.lit(k), c)])
    return F.map_filter(full, lambda _, v: v.isNotNull() & ~F.isnan(v))


def _reason(metric: str) -> Column:
    """Why a metric is not passed, in a few words; null if it passed."""
    words = {
        "missing_dropout": F.format_string("%d missing frame(s), %d feature(s) with dropout", "missing", "dropout"),
        "invalid_values": F.format_string("%d NaN and %d infinite values", "nan_cells", "inf_cells"),
        "schema_consistency": F.format_string("%d feature(s) of another length", "mismatched"),
        "timestamp_validity": F.format_string("%d backward time step(s)", "backward"),
        "joint_limit": F.format_string("%d value(s) beyond the limits", "violations"),
        "action_discontinuity": F.when(report._state(metric, "status") == "review", F.format_string("%d action spikes", "spike_count")),
        "idle_ratio": F.when(report._state(metric, "status") == "review", F.format_string("effective motion ratio %.3f", "effective_motion_ratio")),
    }
    own = words.get(metric, F.lit(None).cast("string"))
    status = report._state(metric, "status")
    return F.when(status == "na", "not enough data").when(status != "pass", F.coalesce(own, F.lit("values that are not finite")))


def _result(metric: str) -> Column:
    status = report._state(metric, "status")
    severity = F.when(status == "exclude", "high").when(status == "review", "high" if metric in CRITICAL else "medium")
    bare = F.create_map().cast("map<string,double>")
    return F.struct(
        report._state(metric, "availability").alias("availability"),
        F.when(status.isin("na", "exclude"), bare).otherwise(_measurement(metric)).alias("measurement"),
        F.struct(status.alias("status"), severity.alias("severity"), _reason(metric).alias("reason")).alias("assessment"),
        (F.map_filter(F.create_map(F.lit("threshold"), F.col("thr").cast("string"), F.lit("method"), F.col("method")), lambda _, v: v.isNotNull()) if metric == "idle_ratio" else F.create_map().cast("map<string,string>")).alias("details"),
        F.coalesce(F.concat(F.lit(f"{metric}: "), _reason(metric)), F.lit(f"{metric}: no finding")).alias("message"),
        F.lit(EVIDENCE.get(metric, "RISK_SIGNAL")).alias("evidence_level"),
        report._state(metric, "passed").alias("passed"),
        report._state(metric, "score").alias("score"),
        report._state(metric, "has_finding").alias("has_finding"),
    )


def episode_results(audit: DataFrame) -> DataFrame:
    """ep, document: episode_index, num_frames, verdict and every metric's result with availability, measurement, assessment, details, message, evidence level."""
    missing = {c: F.lit(None) for names in MEASURED.values() for c in names.values() if c not in audit.columns}
    rows = audit.withColumns({k: v.cast("double") for k, v in missing.items()}) if missing else audit
    metrics = F.create_map(*[x for k in METRICS for x in (F.lit(k), _result(k))])
    return rows.select("ep", F.struct(F.col("ep").alias("episode_index"), F.col("frames").alias("num_frames"), "verdict", metrics.alias("metrics")).alias("document"))


def _codes(test) -> Column:
    """Distinct issue codes of the results that pass ``test``, in the order of the metrics."""
    return F.array_distinct(F.transform(F.filter("results", test), lambda r: code_of(r["metric"])))


def episode_reports(audit: DataFrame) -> DataFrame:
    """ep and the report of each episode for its user: integrity, verdict, evidence in all and by metric, issues, patterns, reasons, figures, the dataset's medians, diagnosis.

    One pass over the audit and one for the three medians. Metrics that are not available have no reasons and figures.
    """
    on = lambda r: r["availability"] == "available"
    failed = lambda r: on(r) & ~r["passed"]
    hard = lambda r: failed(r) & r["metric"].isin(*CRITICAL)
    risky = lambda r: on(r) & (r["status"] == "review") & r["metric"].isin(*report.BEHAVIOUR)
    off = lambda r: r["availability"] == "not_available"
    names = lambda test: F.transform(F.filter("results", test), lambda r: r["metric"])
    some = lambda test: F.exists("results", test)
    by_metric = F.map_from_entries(F.transform("results", lambda r: F.struct(r["metric"], F.when(off(r), "UNVERIFIABLE").when(risky(r), "RISK_SIGNAL").otherwise(evidence_of(r["metric"])))))
    reason = F.create_map(*[x for k in CRITICAL for x in (F.lit(k), _reason(k))])
    issues = F.transform(F.filter("results", hard), lambda r: F.struct(code_of(r["metric"]).alias("code"), r["metric"].alias("metric"), F.coalesce(F.try_element_at(reason, r["metric"]), r["metric"]).alias("reason")))
    known = lambda pairs: F.map_filter(F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), c)]), lambda _, v: v.isNotNull())
    having = lambda metric, c: F.when(report._state(metric, "availability") == "available", c)
    r, of = report.reasons(), {"duration": "distribution", "spikes": "action_discontinuity", "low_motion": "idle_ratio", "velocity": "velocity_acceleration", "path": "distribution"}
    anomalies = {"duration_anomaly": "duration", "spike_anomaly": "spikes", "motion_ratio_anomaly": "low_motion", "velocity_anomaly": "velocity", "path_length_anomaly": "path"}
    figures = {"duration_sec": "duration", "path_length": "path", "spike_count": "spikes", "velocity_p95": "velocity"}
    medians = audit.agg(F.median("duration").alias("duration_median"), F.median("spike_count").alias("spike_median"), F.median("velocity_p95").alias("velocity_median"))
    medians = medians.select(known({c: F.col(c) for c in medians.columns}).alias("reference"), F.lit(1).alias("one"))
    missing = {c: F.lit(None).cast("long") for c in ("violations",) if c not in audit.columns}
    rows = audit.withColumns(missing) if missing else audit
    rows = rows.withColumn("pattern", report.patterns()).withColumn("one", F.lit(1)).join(F.broadcast(medians), "one")
    verdict = F.create_map(*[F.lit(x) for pair in BEHAVIOR_VERDICTS.items() for x in pair])
    named = F.get("pattern", F.lit(0))["pattern"]
    what, why, following = text.said(r["duration"], r["spikes"], r["low_motion"], named)
    return rows.select(
        "ep",
        F.struct((~some(hard)).alias("passed"), issues.alias("issues")).alias("integrity_check"),
        F.element_at(verdict, F.col("verdict")).alias("behavior_verdict"),
        report.evidence().alias("evidence_level"),
        by_metric.alias("evidence_by_metric"),
        _codes(hard).alias("hard_fail_issues"),
        names(risky).alias("risk_signals"),
        names(off).alias("unverifiable_metrics"),
        F.bround(r["duration"] + r["spikes"] + r["low_motion"], 2).alias("deviation_score"),
        F.struct(named.alias("primary"), F.get("pattern", F.lit(1))["pattern"].alias("secondary")).alias("pattern_type"),
        known({k: having(of[c], r[c]) for k, c in anomalies.items()}).alias("reason_vector"),
        known({k: having(of[c], r[c]) for k, c in figures.items()} | {"effective_motion_ratio": having("idle_ratio", 1 - r["low_motion"])}).alias("metrics"),
        "reference",
        _codes(failed).alias("issues"),
        F.struct(what.alias("what"), why.alias("why"), following.alias("next")).alias("diagnosis"),
        F.lit(None).cast("string").alias("user_verdict"),
    )


def dataset_report(audit: DataFrame, path: str = "", profile: dict | None = None) -> DataFrame:
    """The dataset's report, one row: profile, integrity with its issues, quality, verdicts, evidence, patterns, quality after a clean-up."""
    said = {"robot": "unknown", "dof": 0, "fps": 0.0, "tasks": 0} | {k: v for k, v in (profile or {}).items() if v is not None}
    bad = lambda k: (report._state(k, "availability") == "available") & ~report._state(k, "passed")
    off = lambda k: report._state(k, "availability") == "not_available"
    risky = [(report._state(k, "availability") == "available") & (report._state(k, "status") == "review") for k in report.BEHAVIOUR]
    first = F.get(report.patterns(), F.lit(0))["pattern"]
    more = {
        "issues": F.map_filter(F.create_map(*[x for k in CRITICAL for x in (F.lit(report.ISSUE_CODES[k]), F.count_if(bad(k)))]), lambda _, n: n > 0),
        "hard": F.count_if(reduce(lambda a, b: a | b, map(bad, CRITICAL))),
        "risk": F.count_if(reduce(lambda a, b: a | b, risky)),
        "unverifiable": F.map_filter(F.create_map(*[x for k in METRICS for x in (F.lit(k), F.count_if(off(k)))]), lambda _, n: n > 0),
        "patterns": F.create_map(*[x for p in report.PATTERNS for x in (F.lit(p.lower()), F.count_if(first == p))]),
    }
    row = report.dataset_health(audit, more)
    detail = F.create_map(*[F.lit(x) for pair in READINESS_DETAIL.items() for x in pair])
    detail = F.coalesce(F.try_element_at(detail, F.col("readiness")), F.format_string("Usable after reviewing %d episodes.", "review"))
    return row.select(
        F.lit(path).alias("dataset_id"),
        F.lit(VERSION).alias("version"),
        F.struct(F.col("n").alias("total_episodes"), *[F.lit(said[k]).alias(k) for k in ("robot", "dof", "fps", "tasks")]).alias("profile"),
        F.struct(F.col("integrity_passed").alias("passed"), F.col("integrity_failed").alias("failed"), F.col("issues").alias("top_issues")).alias("integrity"),
        F.struct(F.col("health").alias("dhi"), "grade", F.col("readiness").alias("training_readiness"), detail.alias("training_readiness_detail"), F.struct(*report.HEALTH_WEIGHTS).alias("dimensions")).alias("quality"),
        F.struct(F.col("passes").alias("pass"), "review", F.col("excluded").alias("exclude")).alias("behavior_summary"),
        F.struct(F.col("hard").alias("hard_fail_episodes"), F.col("risk").alias("risk_signal_episodes"), F.col("unverifiable").alias("unverifiable_metric_episodes")).alias("evidence_summary"),
        F.col("patterns").alias("pattern_distribution"),
        F.col("after_cleanup").alias("estimated_post_cleanup_quality"),
    )


def engine_documents(audit: DataFrame, path: str = "", info: dict | None = None, size: int = EPISODES_A_DOCUMENT) -> DataFrame:
    """value: the engine's report as JSON, a document for each ``size`` episode numbers.

    Every document has the dataset, the summary, integrity by metric and the ranked findings of the whole
    dataset; the lists of excluded and reviewed episodes are those of its own episodes, sorted. Without
    episodes there is one document with an empty list.
    """
    info = info or {}
    counts = audit.agg(F.count("*").alias("n"), F.sum("frames").alias("frames"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], *_integrity())
    layer = F.create_map(*[x for k in METRICS for x in (F.lit(k), F.struct(F.col(f"{k}_on").alias("available"), F.col(f"{k}_ok").alias("passed"), (F.col(f"{k}_on") - F.col(f"{k}_ok")).alias("failed"), (F.col("n") - F.col(f"{k}_on")).alias("na"), F.coalesce(F.try_divide(f"{k}_ok", f"{k}_on"), F.lit(0.0)).alias("pass_rate")))])
    found = report.top_observations(audit).agg(F.sort_array(F.collect_list(F.struct("rank", "observation", "significance", "episodes", "ratio"))).alias("top_observations"))  # five rows
    head = counts.select(
        F.struct(F.lit(path).alias("path"), F.col("n").alias("num_episodes"), F.coalesce("frames", F.lit(0).cast("long")).alias("total_frames"), F.array(*[F.lit(k.removeprefix("observation.")) for k in info.get("features") or {} if k.startswith("observation.")]).cast("array<string>").alias("modalities")).alias("dataset"),
        F.struct(F.col("n").alias("total_episodes"), F.create_map(*[x for v in VERDICTS for x in (F.lit(v), F.col(v))]).alias("verdict_counts"), F.coalesce(F.try_divide("PASS", "n"), F.lit(0.0)).alias("pass_rate")).alias("summary"),
        layer.alias("integrity"),
        F.lit(1).alias("one"),
    )
    head = head.join(found.withColumn("one", F.lit(1)), "one")
    ids = lambda v: F.sort_array(F.collect_list(F.when(F.col("document.verdict") == v, F.col("ep")))).alias(v)
    parts = episode_results(audit).groupBy(F.floor(F.col("ep") / size).alias("part")).agg(F.collect_list("document").alias("episodes"), ids("EXCLUDE"), ids("REVIEW"))
    rows = head.join(parts.withColumn("one", F.lit(1)), "one", "left")
    none = lambda c, like: F.coalesce(F.col(c), F.array().cast(like))
    kind = parts.schema["episodes"].dataType.simpleString()
    summary = F.struct("summary.*", none("EXCLUDE", "array<bigint>").alias("exclude_episodes"), none("REVIEW", "array<bigint>").alias("review_episodes"))
    document = F.struct(F.lit(VERSION).alias("version"), "dataset", summary.alias("summary"), F.struct(F.col("integrity").alias("layer1_integrity")).alias("three_layer_aggregates"), "top_observations", none("episodes", kind).alias("episodes"))
    return rows.select(F.to_json(document).alias("value"))


def _integrity() -> list[Column]:
    on = lambda k: report._state(k, "availability") == "available"
    return [c for k in METRICS for c in (F.count_if(on(k)).alias(f"{k}_on"), F.count_if(on(k) & report._state(k, "passed")).alias(f"{k}_ok"))]
