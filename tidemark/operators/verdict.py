"""From metrics to verdicts: the metric table, findings, severity, PASS / REVIEW / EXCLUDE.

The audit has one row per episode (``judged``); its column ``results`` holds the thirteen metric
results, which ``metric_results`` lists as the long table. There is one ladder, used on the results
of an episode and, in ``classify``, on a long table from elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics as m

# The metrics in order, which of them decide, and how findings are graded.
METRICS = (
    "missing_dropout",
    "invalid_values",
    "schema_consistency",
    "timestamp_validity",
    "joint_limit",
    "sensor_synchronization",
    "sampling_jitter",
    "velocity_acceleration",
    "action_discontinuity",
    "temporal_sufficiency",
    "idle_ratio",
    "distribution",
    "coverage",
)
CRITICAL = ("missing_dropout", "invalid_values", "schema_consistency", "timestamp_validity", "joint_limit")
REVIEW = ("sensor_synchronization", "sampling_jitter", "velocity_acceleration", "action_discontinuity", "idle_ratio", "distribution", "coverage")
EFFECTIVE_STEPS = ((0.1, 40), (0.2, 30), (0.3, 20), (0.5, 10))
SPIKE_STEPS = ((100, 30), (50, 20), (20, 10))
OCCUPANCY_STEPS = ((0.05, 30), (0.1, 20), (0.2, 10))
REVIEW_SEVERITY = 20
VERDICTS = ("PASS", "REVIEW", "EXCLUDE")
EMPTY_GUARD = "_zero_frame_guard"
RESULT = "struct<metric:string,availability:string,status:string,passed:boolean,has_finding:boolean,score:double>"


def _points(value: Column, steps, hit) -> Column:
    out = F.lit(0)
    for bound, points in reversed(steps):
        out = F.when(hit(value, bound), points).otherwise(out)
    return out


def effective_points(effective: Column) -> Column:
    return _points(effective, EFFECTIVE_STEPS, lambda x, b: x < b)


def spike_points(spikes: Column) -> Column:
    return _points(spikes, SPIKE_STEPS, lambda x, b: x > b)


def occupancy_points(occupancy: Column) -> Column:
    return _points(occupancy, OCCUPANCY_STEPS, lambda x, b: x < b)


def ladder(critical: Column, review: Column, severity: Column) -> Column:
    """The verdict: a critical failure excludes, another one or a severity of at least 20 asks for review."""
    return F.when(critical, "EXCLUDE").when(review | (severity >= REVIEW_SEVERITY), "REVIEW").otherwise("PASS")


def scalars(frames: DataFrame, streams: DataFrame | None = None, limits: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """One wide row per episode: what verdicts, scores and reports are made from.

    ``streams`` (ep, stream, t) make sensor synchronisation available, ``limits`` (joint, lo, hi) the
    joint limits; without them these two metrics are not available. ``block`` deals episodes in blocks
    of so many frames.
    """
    wide = m.measure(frames, block=block)
    if limits is None:
        wide = wide.withColumns({"violations": F.lit(None).cast("long")})
    else:
        beyond = m.joint_limit(frames, limits).groupBy("ep").agg(F.sum("violations").alias("violations"))
        wide = wide.join(beyond, "ep", "left")
    if streams is None:
        return wide.withColumns({"pairs": F.lit(None).cast("long"), "worst_p95": F.lit(None).cast("double"), "worst_max": F.lit(None).cast("double")})
    return wide.join(m.sensor_sync(streams), "ep", "left")


def with_empty(wide: DataFrame, meta: DataFrame) -> DataFrame:
    """A row for every episode of ``meta`` (ep): those that ``wide`` lacks have no frames and nulls."""
    return meta.select("ep").distinct().join(wide, "ep", "left").withColumn("frames", F.coalesce("frames", F.lit(0).cast("long")))


def _result(metric: str, status: Column, score: Column | None = None, points: Column | None = None) -> Column:
    """A metric's result. Points are those of a finding that was attached after the verdict: review, but the score stays."""
    status = F.coalesce(status, F.lit("na"))
    plain = F.when(status == "pass", 1.0).otherwise(0.0) if score is None else F.when(status == "na", 0.0).otherwise(score)
    if points is not None:
        status = F.when((status == "pass") & (points > 0), "review").otherwise(status)
    return F.struct(
        F.lit(metric).alias("metric"),
        F.when(status == "na", "not_available").otherwise("available").alias("availability"),
        status.alias("status"),
        (status == "pass").alias("passed"),
        status.isin("review", "exclude").alias("has_finding"),
        plain.alias("score"),
    )


def judged(wide: DataFrame, extra: DataFrame | None = None, critical: tuple[str, ...] = CRITICAL, review: tuple[str, ...] = REVIEW) -> DataFrame:
    """``wide`` with results, severity, hard_fail and verdict; missing figures are neutral.

    ``extra`` (ep, metric, availability, status, score) are results of the user's own metrics; they
    count for the verdict if ``critical`` or ``review`` name them. An episode without frames is EXCLUDE.
    """
    none = F.col("frames") == 0
    either = lambda bad, yes: F.when(~none & F.coalesce(bad, F.lit(False)), yes).otherwise("pass")
    jump = spike_points(F.coalesce("spike_count", F.lit(0)))
    idle = effective_points(F.coalesce("effective_motion_ratio", F.lit(1.0)))
    late = F.coalesce("time_score", F.lit(1.0))
    results = F.array(
        _result("missing_dropout", either((F.col("missing") > 0) | (F.col("dropout") > 0), "review")),
        _result("invalid_values", either(F.col("nan_cells") + F.col("inf_cells") > 0, "exclude")),
        _result("schema_consistency", either(F.col("mismatched") > 0, "exclude")),
        _result("timestamp_validity", either(F.col("time_status") == "exclude", "exclude"), late),
        _result("joint_limit", F.when(F.col("violations") > 0, "review").when(F.col("violations") == 0, "pass")),
        _result("sensor_synchronization", F.when(F.col("pairs") > 0, "pass")),
        _result("sampling_jitter", F.col("jitter_status")),
        _result("velocity_acceleration", F.col("velocity_status")),
        _result("action_discontinuity", F.col("jump_status"), points=jump, score=F.when(F.col("jump_status") == "pass", 1.0).otherwise(0.0)),
        _result("temporal_sufficiency", F.col("sufficiency_status")),
        _result("idle_ratio", F.col("idle_status"), points=idle, score=F.when(F.col("idle_status") == "pass", 1.0).otherwise(0.0)),
        _result("distribution", F.col("distribution_status")),
        _result("coverage", F.col("coverage_status")),
    )
    guard = F.array(F.struct(F.lit(EMPTY_GUARD).alias("metric"), F.lit("available").alias("availability"), F.lit("fail").alias("status"), F.lit(False).alias("passed"), F.lit(True).alias("has_finding"), F.lit(0.0).alias("score")))
    results = F.when(none, F.concat(results, guard)).otherwise(results)
    if extra is not None:
        own = F.struct("metric", "availability", "status", (F.col("status") == "pass").alias("passed"), F.col("status").isin("review", "exclude").alias("has_finding"), "score")
        wide = wide.join(extra.groupBy("ep").agg(F.sort_array(F.collect_list(own)).alias("own")), "ep", "left")
        results = F.concat(results, F.coalesce("own", F.array().cast(f"array<{RESULT}>")))
    out = wide.withColumn("results", results).drop("own")
    bad = lambda names: F.exists("results", lambda r: (r["availability"] == "available") & r["has_finding"] & r["metric"].isin(*names))
    # Findings attached for behaviour come after the verdict, so those two metrics count by their own state.
    own_state = lambda name, column: (F.col(column) == "exclude") if name in review else F.lit(False)
    named = tuple(k for k in review if k not in ("action_discontinuity", "idle_ratio"))
    soft = bad(named) | F.coalesce(own_state("action_discontinuity", "jump_status"), F.lit(False)) | F.coalesce(own_state("idle_ratio", "idle_status"), F.lit(False))
    out = out.withColumn("severity", F.least(jump + idle, F.lit(100))).withColumn("hard_fail", bad(CRITICAL))
    return out.withColumn("verdict", F.when(none, "EXCLUDE").otherwise(ladder(bad(critical), soft, F.col("severity"))))


def classify(results: DataFrame, critical: tuple[str, ...] = CRITICAL, review: tuple[str, ...] = REVIEW) -> DataFrame:
    """ep, severity, verdict from a long table (ep, metric, availability, has_finding, measurement map).

    Only available metrics with a finding count. An episode without rows is not in the result.
    """
    failed = (F.col("availability") == "available") & F.col("has_finding")
    value = lambda metric, key: F.max(F.when((F.col("metric") == metric) & (F.col("availability") == "available"), F.try_element_at("measurement", F.lit(key))))
    got = results.groupBy("ep").agg(
        F.bool_or(failed & F.col("metric").isin(*critical)).alias("critical"),
        F.bool_or(failed & F.col("metric").isin(*review)).alias("review"),
        value("action_discontinuity", "spike_count").alias("spikes"),
        value("idle_ratio", "effective_motion_ratio").alias("effective"),
        value("distribution", "occupancy_rate").alias("occupancy"),
    )
    points = effective_points(F.coalesce("effective", F.lit(1.0))) + spike_points(F.coalesce("spikes", F.lit(0.0))) + occupancy_points(F.coalesce("occupancy", F.lit(1.0)))
    got = got.withColumn("severity", F.least(points, F.lit(100)))
    return got.select("ep", "severity", ladder(F.col("critical"), F.col("review"), F.col("severity")).alias("verdict"))


def metric_results(audit: DataFrame) -> DataFrame:
    """The long table: ep, metric, availability, status, passed, has_finding, score."""
    return audit.select("ep", F.inline("results"))


def verdict_counts(audit: DataFrame) -> DataFrame:
    """All three verdicts, zeros included."""
    counts = audit.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("episodes")) for v in VERDICTS])).alias("r")).select("r.*")


def zero_frame_guard(meta: DataFrame, audit: DataFrame) -> DataFrame:
    """Every episode of ``meta`` (ep): those without frames are EXCLUDE."""
    return meta.join(audit.select("ep", "frames", "verdict"), "ep", "left").select("ep", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("verdict", F.lit("EXCLUDE")).alias("verdict"))
