"""All registered queries over the driver tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import quantiles, seq
from tidemark.operators import calibrate, documents, export, history, metrics, overview, report, text, verdict
from tidemark.plans import sql
from tidemark.sources import adapters, layouts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_frames(adapters.table(spark, sf_dir, "events"))


def _a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.embedding_frames(adapters.table(spark, sf_dir, "embeddings"))


def _a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.lineitem_frames(adapters.table(spark, sf_dir, "lineitem"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.judged(verdict.scalars(_a1(spark, sf_dir)))


def _full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the event types as sensor streams, limits of both state dimensions, and customers without events as empty episodes."""
    limits = spark.createDataFrame([(0, 0.0, 400.0), (1, 0.0, 98.5)], "joint int, lo double, hi double")
    wide = verdict.scalars(_a1(spark, sf_dir), adapters.event_streams(adapters.table(spark, sf_dir, "events")), limits)
    return verdict.judged(verdict.with_empty(wide, adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ep"))))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.metric_results(_audit(spark, sf_dir))


def _add(name: str, source: Callable[[SparkSession, str], DataFrame], plan: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    _QUERIES[name] = lambda spark, sf_dir: plan(source(spark, sf_dir))


def _kept(rows: DataFrame, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use`` of ``rows`` that are persisted while it reads them several times; its result no longer needs them."""
    rows = rows.persist()
    try:
        return use(rows)
    finally:
        rows.unpersist()


def _corrupt(frames: DataFrame) -> DataFrame:
    v = F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("event_id") % 89 == 0, float("inf")).otherwise(F.col("action")[0])
    return frames.withColumn("action", F.array(v)).withColumn("state", F.array(v, F.col("state")[1]))


def _user_decisions(audit: DataFrame) -> DataFrame:
    names = F.element_at(F.array(F.lit("REMOVE"), F.lit("KEEP"), F.lit("UNCERTAIN")), (F.col("ep") % 3 + 1).cast("int"))
    return audit.filter(F.col("ep") % 4 == 0).select("ep", names.alias("decision"))


def _labelled(audit: DataFrame) -> DataFrame:
    said = F.when(F.col("ep") % 5 == 0, " bad ").when(F.col("ep") % 5 == 1, "review").otherwise("Good")
    return audit.select("ep", "verdict", export.normalise_label(said).alias("label"))


def _reports(audit: DataFrame) -> DataFrame:
    """Three datasets of episodes, as reports list them."""
    name = F.concat(F.lit("d"), (F.col("ep") % 3).cast("string"))
    return audit.select(name.alias("dataset"), F.concat(F.lit("/r/"), name).alias("source"), "ep", "hard_fail", export.risk_points().alias("risk"))


def _feature_names(lineitem: DataFrame) -> DataFrame:
    prefix = F.when(F.col("l_linenumber") % 3 == 0, "observation.").when(F.col("l_linenumber") % 3 == 1, "action.").otherwise("other.")
    return lineitem.select(F.concat(prefix, "l_returnflag").alias("name")).distinct()


def _flat(rows: DataFrame) -> DataFrame:
    """The lists of an episode's report as texts."""
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    lists = [joined(c).alias(c) for c in ("issues", "hard_fail_issues", "risk_signals", "unverifiable_metrics")]
    return rows.select("ep", F.col("integrity_check.passed").alias("passed"), "behavior_verdict", "evidence_level", *lists, F.col("pattern_type.primary").alias("pattern"), F.col("pattern_type.secondary").alias("second_pattern"), F.col("diagnosis.why").alias("why"))


def _with_parameters(frames: DataFrame) -> DataFrame:
    """Episodes of two kinds: one with the defaults, one with a wider spike bound and a coarser grid."""
    table = frames.sparkSession.createDataFrame([("odd", 8.0, 5)], "kind string, spike_z double, resolution int")
    return metrics.with_parameters(frames.withColumn("kind", F.when(F.col("ep") % 2 == 1, "odd").otherwise("even")), table, "kind")


def _z(audit: DataFrame) -> DataFrame:
    scores = calibrate.score_metrics(audit).persist()  # read by the profile and by z
    return calibrate.bad_z(scores, calibrate.reference_profile(scores))


_add("frames_canonical", _a1, lambda f: f.select("ep", "fi", "t", F.col("action")[0].alias("v"), F.col("state")[1].alias("k")))
_add("frame_deltas", _a1, lambda f: metrics.steps(f).select("ep", "fi", F.get("d1", F.lit(0)).alias("d1")))
_add("second_diff", _a1, lambda f: metrics.steps(f).select("ep", "fi", F.get("d2", F.lit(0)).alias("d2")))
_add("motion_norm", _a1, lambda f: f.select("ep", "fi", seq.norm(seq.difference("state")).alias("sn")))
_add("dt_percentiles", _a1, lambda f: metrics.dt_stats(f).select("ep", "dt_p50", "dt_p95", "dt_p99", "dt_max"))
_add("sampling_jitter", _a1, lambda f: metrics.dt_stats(f).select("ep", F.round("dt_mean", 3).alias("dt_mean"), F.round("cv", 9).alias("cv")))
_add("mad_per_episode", _a1, lambda f: seq.robust(metrics.steps(f), "jump").groupBy("ep").agg(F.first("med").alias("med"), F.first("mad").alias("mad")))
_add("robust_z", _a1, lambda f: seq.robust(metrics.steps(f), "jump").select("ep", "fi", F.round("z", 9).alias("z")))
_add("action_spikes", _a1, lambda f: metrics.action_discontinuity(f).select("ep", "spike_count"))
_add("action_discontinuity", _a1, metrics.action_discontinuity)
_add("joint_spikes", _a2, lambda f: metrics.joint_spikes(f).withColumn("joint", F.col("joint").cast("long")))
_add("affected_joints", _a2, lambda f: metrics.affected_joints(f).select("ep", F.array_join("joints", ",").alias("joints")))
_add("motion_histogram", _a1, lambda f: metrics.motion_bins(f).groupBy("ep", "bin").agg(F.count("*").alias("n")))
_add("idle_threshold", _a1, lambda f: metrics.idle_threshold(f).select("ep", "n", "method", "thr"))
_add("idle_mask", _a1, lambda f: metrics.idle_mask(f).select("ep", "fi", "idle"))
_add("idle_ratio", _a1, lambda f: metrics.idle_ratio(f).select("ep", "method", "thr", "idle_ratio"))
_add("active_runs", _a1, metrics.active_runs)
_add("temporal_sufficiency", _a1, lambda f: metrics.temporal_sufficiency(f).drop("status"))
_add("temporal_sufficiency_dataset", _a1, lambda f: report.quantile_row(metrics.temporal_sufficiency(f), "idle_total", "idle_prefix", "transitions", "run_p50", "run_max"))
_add("timestamp_validity", _a3, metrics.timestamp_validity)
_add("velocity_stats", _a1, lambda f: metrics.velocity_stats(f).select("ep", "status", "velocity_p50", "velocity_p95", "velocity_p99", "velocity_max", "acc_spikes"))
_add("trajectory_stats", _a1, lambda f: metrics.trajectory_stats(f).select("ep", "frames", "duration", F.round("path_length", 6).alias("path_length"), F.col("end_state")[0].alias("end_v"), F.round("velocity_p95", 6).alias("velocity_p95")))
_add("coverage", _a2, metrics.coverage)
_add("coverage_two_dims", _a1, metrics.coverage)
_add("underrepresented_cells", _a2, metrics.underrepresented_cells)
_add("missing_frames", _a1, lambda f: metrics.missing_frames(f.filter(F.col("event_id") % 7 != 0).withColumn("number", F.col("fi").cast("long"))))
_add("missing_dropout", _a1, lambda f: metrics.missing_dropout(f.filter(F.col("event_id") % 7 != 0).withColumn("number", F.col("fi").cast("long"))))
_add("invalid_values", _a1, lambda f: metrics.invalid_values(_corrupt(f)))
_add("corrupt_verdict", _a1, lambda f: verdict.judged(verdict.scalars(_corrupt(f))).select("ep", "jump_status", "idle_status", "velocity_status", "coverage_status", "hard_fail", "verdict"))
_add("joint_limit", _a2, lambda f: metrics.joint_limit(f, f.sparkSession.createDataFrame([(0, -0.1, 0.1), (1, -0.05, 0.05), (2, 0.0, 0.2)], "joint int, lo double, hi double")))
_add("action_dim_stats", _a3, lambda f: metrics.action_dim_stats(f, 3).select("ep", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "p05", "p50", "p95", "lo", "hi"))
_add("sensor_sync_pairs", lambda s, d: adapters.event_streams(adapters.table(s, d, "events")), lambda x: metrics.sensor_sync_pairs(x).select("ep", "one", "two", "n", *[F.round(c, 3).alias(c) for c in ("p50", "p95", "p99", "offset_max", "offset_mean", "offset_std", "signed_median")]))
_add("sensor_offsets_bucketed", lambda s, d: adapters.event_streams(adapters.table(s, d, "events")), lambda x: metrics.sensor_offsets(x, 7 * 86_400.0).groupBy("ep", "one", "two").agg(F.count("*").alias("n"), F.round(F.max(F.abs("offset")), 3).alias("offset_max"), F.round(F.avg("offset"), 3).alias("offset_mean")))
_add("sensor_sync", lambda s, d: adapters.event_streams(adapters.table(s, d, "events")), lambda x: metrics.sensor_sync(x).select("ep", "pairs", F.round("worst_p95", 3).alias("worst_p95"), F.round("worst_max", 3).alias("worst_max")))

_add("episode_verdict", _audit, lambda a: a.select("ep", "frames", "spike_count", "effective_motion_ratio", "severity", "verdict"))
_add("episode_verdict_blocks", lambda s, d: verdict.judged(verdict.scalars(_a1(s, d), block=40)), lambda a: a.select("ep", "frames", "spike_count", "effective_motion_ratio", "severity", "verdict"))
_add("behavior_severity", _audit, lambda a: a.groupBy("severity").agg(F.count("*").alias("episodes")))
_add("verdict_counts", _audit, verdict.verdict_counts)
_add("episode_audit", _results)
_add("episode_audit_full", _full_audit, verdict.metric_results)
_add("episode_verdict_full", _full_audit, lambda a: a.select("ep", "frames", "severity", "hard_fail", "verdict"))
_QUERIES["zero_frame_guard"] = lambda s, d: verdict.zero_frame_guard(adapters.table(s, d, "customer").select(F.col("c_custkey").alias("ep")), _audit(s, d))
_add("integrity_summary", _results, report.integrity_summary)
_add("score_distribution", _results, report.score_distribution)
_add("failing_metrics", _results, report.failing_metrics)
_add("issue_codes", _results, report.issue_codes)
_add("evidence_summary", _results, report.evidence_summary)
_add("evidence_level", _results, report.evidence_level)
_add("deviation_stats", _results, lambda r: report.deviation_stats(r).select(F.round("mean_deviation", 6).alias("mean_deviation"), F.round("median_deviation", 6).alias("median_deviation")))
_add("temporal_motion_summary", _audit, report.temporal_motion_summary)
_add("utility_summary", _audit, report.utility_summary)
_add("utility_summary_refined", _audit, lambda a: _kept(a.select(*report.UTILITY), lambda x: quantiles.quantile_table(x, report.UTILITY, few=4)))
_add("audit_summary", _audit, report.audit_summary)
_add("pattern_type", _audit, lambda a: report.pattern_types(a).select("ep", "pattern", "place"))
_add("pattern_distribution", _audit, report.pattern_distribution)
_add("pattern_type_history", _audit, report.pattern_history)
_add("pattern_counts", _audit, lambda a: report.pattern_history(a).groupBy("pattern").agg(F.count("*").alias("episodes")))
_add("deviation_heuristic", _audit, lambda a: report.reason_vector(a).select("ep", "spikes", "low_motion", F.round("deviation", 2).alias("deviation")))
_add("quality_dimensions", _audit, report.quality_dimensions)
_add("dataset_health", _audit, report.dataset_health)
_add("top_observations", _audit, report.top_observations)
_add("top_observations_full", _full_audit, lambda a: report.top_observations(a, occupancy=True))
_add("episode_report", _audit, lambda a: report.episode_report(a))
_add("episode_documents", _audit, lambda a: _flat(documents.episode_reports(a)))
_add("dataset_document", _audit, lambda a: documents.dataset_report(a, "events").select("dataset_id", "profile.total_episodes", "quality.dhi", "quality.training_readiness", F.col("integrity.top_issues").getItem("INT-04").alias("backward_episodes"), "evidence_summary.hard_fail_episodes", "evidence_summary.risk_signal_episodes", F.col("evidence_summary.unverifiable_metric_episodes").getItem("joint_limit").alias("unverifiable_limits"), *[F.col("pattern_distribution").getItem(p.lower()).alias(p.lower()) for p in report.PATTERNS], "estimated_post_cleanup_quality"))
_add("episode_table", _audit, lambda a: report.episode_table(a).withColumn("deviation", F.round("deviation", 6)).withColumn("issue_severity", F.round("issue_severity", 6)))
_add("episode_ranks", _audit, report.episode_ranks)
_add("episode_overview", _audit, overview.episode_overview)
_add("episode_export", _audit, overview.export_rows)
_add("issue_counts", _full_audit, overview.issue_counts)
_add("top_issues", _full_audit, overview.top_issues)
_add("listed_episodes", _full_audit, lambda a: overview.listed_episodes(a, 100).withColumn("episodes", F.array_join("episodes", ",")))
_add("legacy_aggregates", _full_audit, lambda a: overview.legacy_aggregates(a).select("temporal.dt_median_ms.*", F.col("temporal.sensor_sync_worst_p95_ms.p95").alias("sync_p95"), F.col("temporal.sensor_sync_worst_p95_ms.max").alias("sync_max"), "motion.total_joint_violations", "motion.total_discontinuity_spikes", "motion.discontinuity_affected_episodes", F.col("motion.idle_ratio.p95").alias("idle_p95")))
_add("measured_with_parameters", lambda s, d: _with_parameters(_a1(s, d)), lambda f: metrics.measure(f).select("ep", "spike_count", "idle_ratio", "occupancy_rate", "method"))
_add("issue_stats", _audit, lambda a: report.findings(a).groupBy("metric", "level").agg(F.count("*").alias("episodes")))
_add("anonymize", _audit, lambda a: report.anonymized(a.select("ep", F.concat(F.lit("/data/"), F.col("ep").cast("string")).alias("path")), "path"))
_QUERIES["spike_regions"] = lambda s, d: report.spike_regions(seq.robust(metrics.steps(_a1(s, d)), "jump").withColumn("frames", F.count("*").over(seq.whole())).filter(F.abs("z") > 5))
_QUERIES["episode_lookup"] = lambda s, d: _a1(s, d).filter("ep = 7").select("ep", "fi", F.col("action")[0].alias("v"))

_add("portable_metrics", _audit, lambda a: calibrate.score_metrics(a).select("ep", *calibrate.PORTABLE))
_add("platform_metrics", _audit, lambda a: calibrate.score_metrics(a).select("ep", "velocity_p95", "velocity_max", F.round("path_length", 6).alias("path_length")))
_add("reference_profile", _audit, lambda a: calibrate.reference_profile(calibrate.score_metrics(a)))
_add("reference_profile_refined", _audit, lambda a: _kept(calibrate.score_metrics(a), lambda x: calibrate.refined_profile(x, few=4)))
_add("bad_z", _audit, lambda a: _z(a).select("ep", "metric", F.round("z", 9).alias("z")))
_add("percentile_rank", _audit, lambda a: _z(a).select("ep", "metric", F.round("rank", 9).alias("rank")))
_add("rms_score", _audit, lambda a: calibrate.rms_scores(_z(a)).select("ep", *[F.round(c, 6).alias(c) for c in ("portable_score", "platform_score", "combined_rms")]))
_add("pca_covariance", _audit, lambda a: calibrate.pca_covariance(_z(a)).withColumn("cov", F.round("cov", 6)))
_add("deviation_scores", _audit, lambda a: calibrate.deviation_scores(_z(a)))
_add("approx_percentile", _audit, lambda a: calibrate.approx_percentile(_z(a)).withColumn("percentile", F.round("percentile", 9)))
_add("reference_injection", _audit, lambda a: calibrate.inject(verdict.metric_results(a), _z(a)).select("ep", "metric", F.round("z", 9).alias("z"), F.round("percentile", 9).alias("percentile")))

_QUERIES["export_decisions"] = lambda s, d: export.export_decisions(a := _audit(s, d), _user_decisions(a))
_QUERIES["export_report"] = lambda s, d: export.export_report(_QUERIES["export_decisions"](s, d))
_QUERIES["export_frames"] = lambda s, d: export.kept_frames(_a1(s, d).select("ep", "fi"), _QUERIES["export_decisions"](s, d))
_add("risk_score", _audit, export.risk_score)
_add("stable_sample", _audit, lambda a: export.stable_sample(a, 20, "salt", "a1"))
_add("blind_sample", _audit, lambda a: export.blind_sample(_reports(a), 6))
_add("qc_normalise", _audit, lambda a: _labelled(a).select("ep", "label"))
_add("qc_confusion", _audit, lambda a: export.confusion(_labelled(a)))
_add("qc_metrics", _audit, lambda a: export.label_metrics(_labelled(a).withColumn("seconds", (F.col("ep") % 7).cast("double"))))
_add("export_custom", _audit, lambda a: export.export_decisions(a, _user_decisions(a), remove=("REVIEW",), stored=a.sparkSession.range(0, 400, 2).select(F.col("id").alias("ep"))))

_add("idle_prefix", _a1, lambda f: metrics.temporal_sufficiency(f).select("ep", "idle_prefix"))
_add("idle_transitions", _a1, lambda f: metrics.temporal_sufficiency(f).select("ep", "transitions"))
_add("valid_windows", _a1, lambda f: metrics.temporal_sufficiency(f).select("ep", *[f"valid_{n}" for n in metrics.WINDOWS]))
_add("dt_stats", _a1, metrics.dt_stats)
_add("dataset_info", _a1, metrics.frame_totals)
_add("schema_consistency", _a1, lambda f: metrics.schema_consistency(f.withColumn("action", F.when(F.col("event_id") % 101 != 0, F.col("action"))), "action", "state", "t"))
_add("integrity_pass_rate", _results, report.integrity_pass_rate)
_add("episode_integrity", _results, report.episode_integrity)
_add("reference_medians", _audit, report.reference_medians)
_QUERIES["validation_records"] = lambda s, d: report.validation_records(_QUERIES["zero_frame_guard"](s, d))
_QUERIES["episode_csv"] = lambda s, d: report.episode_csv(_audit(s, d))
_QUERIES["review_queue"] = lambda s, d: report.episode_csv(_audit(s, d), "REVIEW", "EXCLUDE").select("ep", "verdict", "issue_severity")
_add("removal_list", _audit, lambda a: report.removal_list(report.episode_table(a).withColumn("issue_severity", F.round("issue_severity", 6)), export.export_decisions(a, _user_decisions(a), "aggressive")))
_add("audit_trend", _audit, lambda a: report.trend(report.snapshots(a, F.lit("a1"), F.col("ep") % 5), "pass_rate").withColumns({"value": F.round("value", 4), "change": F.round("change", 4)}))
_add("history_merged", _audit, lambda a: history.snapshots(history.merged(*[history.states(a.filter(F.col("ep") % 3 == k), F.lit("a1"), F.col("ep") % 5) for k in range(3)])).select("run", "episodes", "passes", "review", "excluded", "total_spikes", "n_stuck", "n_frozen", "n_jittery", "n_inefficient", "n_unusual"))
_QUERIES["score_summary"] = lambda s, d: calibrate.score_summary(_QUERIES["rms_score"](s, d))

_add("dataset_health_ui", _audit, report.health_by_verdict)
_QUERIES["hero_metrics"] = lambda s, d: report.hero_metrics(_audit(s, d), _QUERIES["sensor_sync"](s, d), metrics.coverage(_a2(s, d)))
_add("episode_diagnosis", _audit, text.diagnosis)
_add("feature_keys", lambda s, d: adapters.table(s, d, "lineitem"), lambda x: _feature_names(x).select("name", layouts.feature_kind(F.col("name")).alias("kind"), layouts.feature_label(F.col("name")).alias("label")))


def _rounded(query: Query, columns: tuple[str, ...]) -> Query:
    return lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: F.round(c, 6) for c in columns})


def queries() -> dict[str, Query]:
    return {k: _rounded(q, sql.ROUNDED[k]) if k in sql.ROUNDED else q for k, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLES.items() if k in _QUERIES}
