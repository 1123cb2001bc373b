"""What a user browses: the table of episodes, counts of issues, lists of ids, flat exports, and aggregates that older readers take.

Everything is made of columns of the audit's own row (``verdict.judged``), one pass each. An audit
without episodes gives no rows, and zeros where there is one row of figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.seq import percentiles
from tidemark.operators import report
from tidemark.operators.verdict import CRITICAL, METRICS, REVIEW, effective_points, spike_points

LISTED_IN_ROW = 10_000
# Labels of the patterns that the table shows, and which of them a metric points to.
LABELS = {"Stuck": "Stuck-like (risk signal)", "Frozen": "Frozen-like (risk signal)", "Jitter": "Jitter-like (risk signal)", "Inefficient": "Inefficient-like (risk signal)", "Unusual": "Unusual-like (risk signal)"}
POINTS_TO = {"action_discontinuity": LABELS["Jitter"], "idle_ratio": "Stuck/Frozen-like (risk signal)", "distribution": LABELS["Inefficient"], "velocity_acceleration": LABELS["Jitter"], "coverage": LABELS["Unusual"]}


def _failed(r: Column) -> Column:
    return (r["availability"] == "available") & ~r["passed"]


def shown(metric: Column) -> Column:
    """A metric's name as the table shows it."""
    return F.translate(F.upper(metric), "_", "-")


def _shown_where(test) -> Column:
    return F.transform(F.filter("results", test), lambda r: shown(r["metric"]))


def signal() -> Column:
    """The label of the pattern that the table shows: idle and jumpy, idle, jumpy, a failed distribution, any other failed metric that asks for review; else null."""
    available = lambda k: report._state(k, "availability") == "available"
    idle = available("idle_ratio") & (F.coalesce("effective_motion_ratio", F.lit(1.0)) < 0.3)
    jumpy = available("action_discontinuity") & (F.coalesce("spike_count", F.lit(0)) > 20)
    far = available("distribution") & ~report._state("distribution", "passed")
    other = F.exists("results", lambda r: _failed(r) & r["metric"].isin(*REVIEW))
    return F.when(idle & jumpy, LABELS["Stuck"]).when(idle, LABELS["Frozen"]).when(jumpy, LABELS["Jitter"]).when(far, LABELS["Inefficient"]).when(other, LABELS["Unusual"])


def episode_overview(audit: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """ep, frames, integrity_check, integrity_issues, verdict, deviation (two digits), pattern, the first three issues and how many there are.

    ``scores`` (ep and any scores, as ``calibrate.deviation_scores`` gives them) are joined by episode, to
    two digits; an episode that they lack has nulls. ``report.episode_ranks`` has the order of the rows.
    """
    hard = _shown_where(lambda r: _failed(r) & r["metric"].isin(*CRITICAL))
    issues = _shown_where(_failed)
    none = lambda names, least, word: F.when(F.size(names) > 0, F.array_join(least, ", ")).otherwise(word)
    rows = audit.select(
        "ep",
        "frames",
        F.when(F.size(hard) == 0, "PASS").otherwise("FAIL").alias("integrity_check"),
        none(hard, hard, "—").alias("integrity_issues"),
        "verdict",
        F.round(report.deviation(), 2).alias("deviation"),
        F.coalesce(signal(), F.lit("—")).alias("pattern"),
        none(issues, F.slice(issues, 1, 3), "None").alias("top_issues"),
        F.size(issues).cast("long").alias("issue_count"),
    )
    if scores is None:
        return rows
    own = scores.select("ep", *[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes if c != "ep"])
    return rows.join(own, "ep", "left")


def export_rows(audit: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The flat export: issue_severity_score is the larger of deviation and behavioural severity; a pattern counts as an issue of its own.

    ``decisions`` (ep, decision, notes, one row an episode) fill the last two columns, which are else empty.
    """
    label = signal()
    issues = F.concat(_shown_where(_failed), F.filter(F.array(F.concat(F.lit("PATTERN_"), F.upper(label))), lambda x: x.isNotNull()))
    hard = F.exists("results", lambda r: _failed(r) & r["metric"].isin(*CRITICAL))
    if decisions is not None:
        audit = audit.join(decisions.select("ep", "decision", "notes"), "ep", "left")
    said = lambda c: F.coalesce(c, F.lit("")) if decisions is not None else F.lit("")
    return audit.select(
        F.col("ep").alias("episode_id"),
        F.col("frames").alias("num_frames"),
        F.when(hard, "FAIL").otherwise("PASS").alias("integrity_check"),
        F.col("verdict").alias("behavior_verdict"),
        F.round(F.greatest(F.round(report.deviation(), 2), F.col("severity").cast("double")), 2).alias("issue_severity_score"),
        F.coalesce(label, F.lit("")).alias("pattern_type"),
        F.size(issues).cast("long").alias("issue_count"),
        F.array_join(issues, "; ").alias("top_issues"),
        said("decision").alias("user_decision"),
        said("notes").alias("user_notes"),
    )


def _behaviour() -> dict[str, Column]:
    return {"action_discontinuity": spike_points(F.coalesce("spike_count", F.lit(0))) > 0, "idle_ratio": effective_points(F.coalesce("effective_motion_ratio", F.lit(1.0))) > 0}


def issue_counts(audit: DataFrame) -> DataFrame:
    """One row: episodes with a critical failure, episodes with a risk (under both of its names), results that are not available."""
    hard = F.exists("results", lambda r: _failed(r) & r["metric"].isin(*CRITICAL))
    risk = F.exists("results", lambda r: _failed(r) & r["metric"].isin(*REVIEW) & ~r["metric"].isin(*CRITICAL))
    for found in _behaviour().values():
        risk = risk | found
    off = F.size(F.filter("results", lambda r: r["availability"] == "not_available"))
    got = audit.agg(F.count_if(hard).alias("critical"), F.count_if(risk).alias("risk_signal"), F.coalesce(F.sum(off), F.lit(0)).cast("long").alias("unverifiable"))
    return got.select("critical", F.col("risk_signal").alias("warning"), "risk_signal", "unverifiable", F.lit(0).cast("long").alias("info"))


def top_issues(audit: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` metrics with most issues, of equal counts the first in the metrics' order: metric, code, episodes, severity, evidence, pattern.

    A behavioural finding counts beside its metric's failure, so such an episode counts twice.
    """
    found = F.filter(F.array(*[F.when(c, k) for k, c in _behaviour().items()]), lambda k: k.isNotNull())
    names = F.concat(F.transform(F.filter("results", _failed), lambda r: r["metric"]), found)
    counts = audit.select(F.explode(names).alias("metric")).groupBy("metric").agg(F.count("*").alias("episodes"))
    metric, place = F.col("metric"), F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric"))
    pattern = F.create_map(*[F.lit(x) for pair in POINTS_TO.items() for x in pair])
    graded = lambda a, b, c: F.when(metric.isin(*CRITICAL), a).when(metric.isin(*REVIEW), b).otherwise(c)
    rows = counts.orderBy(F.desc("episodes"), F.when(place > 0, place).otherwise(len(METRICS) + 1), "metric").limit(n)
    return rows.select("metric", shown(metric).alias("code"), "episodes", graded("critical", "warning", "info").alias("severity"), graded("HARD_FAIL", "RISK_SIGNAL", "UNVERIFIABLE").alias("evidence"), F.try_element_at(pattern, metric).alias("pattern"))


def listed_episodes(audit: DataFrame, size: int = LISTED_IN_ROW) -> DataFrame:
    """verdict, part, episodes: the sorted ids of the excluded and the reviewed episodes, a row for each ``size`` episode numbers."""
    rows = audit.filter(F.col("verdict").isin("EXCLUDE", "REVIEW")).groupBy("verdict", F.floor(F.col("ep") / size).alias("part"))
    return rows.agg(F.sort_array(F.collect_list("ep")).alias("episodes"))


def legacy_aggregates(audit: DataFrame) -> DataFrame:
    """One row of the figures that readers of older reports take: temporal, motion, distribution; 0 where no episode has a figure.

    Coverage there is that of a metric named ``state_space_occupancy``, which no built-in metric is, so
    it is 0. The fourth, scores by metric, is ``report.score_distribution``.
    """
    at = lambda k, c: F.when(report._state(k, "availability") == "available", F.col(c))
    sync, spikes = at("sensor_synchronization", "worst_p95"), at("action_discontinuity", "spike_count")
    got = audit.agg(
        percentiles(at("timestamp_validity", "dt_p50"), 0.5, 0.95, 0.99).alias("dt"),
        percentiles(sync, 0.5, 0.95).alias("sync"),
        F.max(sync).alias("sync_max"),
        F.sum(at("joint_limit", "violations")).alias("violations"),
        F.sum(spikes).alias("spikes"),
        F.count_if(spikes > 0).alias("spiky"),
        percentiles(at("idle_ratio", "idle_ratio"), 0.05, 0.5, 0.95).alias("idle"),
    )
    named = lambda c, *names: F.struct(*[F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)).alias(k) for i, k in enumerate(names)])
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("median", "min", "max", "p5", "p95")])
    return got.select(
        F.struct(named("dt", "median", "p95", "p99").alias("dt_median_ms"), F.struct(named("sync", "median", "p95")["median"].alias("median"), named("sync", "median", "p95")["p95"].alias("p95"), F.coalesce("sync_max", F.lit(0.0)).alias("max")).alias("sensor_sync_worst_p95_ms")).alias("temporal"),
        F.struct(whole(F.col("violations")).alias("total_joint_violations"), whole(F.col("spikes")).alias("total_discontinuity_spikes"), F.col("spiky").alias("discontinuity_affected_episodes"), named("idle", "p5", "median", "p95").alias("idle_ratio")).alias("motion"),
        F.struct(zero.alias("coverage")).alias("distribution"),
    )
