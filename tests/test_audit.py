"""The whole audit on hand-made episodes: thirteen metrics, one ladder, dataset figures worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibrate, custom, metrics, report, text, verdict
from tidemark.plans import registry

SCHEMA = "ep long, fi int, t double, action array<double>, state array<double>"
DIR = "/root/testdata/sf0.001"


def frames(spark, *episodes):
    rows = [(k, i, i / 10, None if a is None else [float(x) for x in a], None if a is None else [float(x) for x in a]) for k, e in enumerate(episodes) for i, a in enumerate(e)]
    return spark.createDataFrame(rows, SCHEMA)


def wave(n=40):
    """Still for six steps, then at an almost steady pace: mostly active."""
    pace = np.where(np.arange(n)[:, None] > 6, 1 + np.random.default_rng(3).normal(0, 0.02, (n, 2)), 0)
    return np.cumsum(pace, 0)


def states(audit):
    return {(r.ep, r.metric): (r.availability, r.status, r.score) for r in verdict.metric_results(audit).collect()}


def test_thirteen_results_and_the_guard(spark):
    bad = wave()
    bad[5, 0] = np.nan
    df = frames(spark, wave(), bad, [None] * 10, wave(1), wave(2))
    meta = spark.range(7).select(F.col("id").alias("ep"))
    audit = verdict.judged(verdict.with_empty(verdict.scalars(df), meta))
    got = states(audit)
    assert len(got) == 7 * 13 + 2
    off, ok, out = ("not_available", "na", 0.0), ("available", "pass", 1.0), ("available", "exclude", 0.0)
    assert all(got[0, k] == (off if k in ("joint_limit", "sensor_synchronization") else ok) for k in verdict.METRICS)
    assert got[1, "invalid_values"] == got[1, "idle_ratio"] == got[1, "action_discontinuity"] == got[1, "velocity_acceleration"] == out
    assert got[1, "temporal_sufficiency"] == got[1, "coverage"] == off
    assert got[2, "idle_ratio"] == got[2, "action_discontinuity"] == got[2, "distribution"] == off
    assert got[3, "idle_ratio"] == got[3, "sampling_jitter"] == off and got[3, "coverage"] == ok
    assert got[4, "action_discontinuity"] == off and got[4, "idle_ratio"][0] == "available"
    assert got[5, "_zero_frame_guard"] == ("available", "fail", 0.0) and got[5, "invalid_values"] == ok and got[5, "distribution"] == off
    verdicts = {r.ep: r.verdict for r in audit.collect()}
    assert {k: verdicts[k] for k in (0, 1, 2, 3, 5, 6)} == {0: "PASS", 1: "EXCLUDE", 2: "PASS", 3: "PASS", 5: "EXCLUDE", 6: "EXCLUDE"}


def test_side_tables_and_stored_frame_numbers(spark):
    df = frames(spark, wave(), wave()).withColumn("number", F.col("fi").cast("long") + F.when(F.col("ep") == 1, F.floor(F.col("fi") / 20)).otherwise(0))
    limits = spark.createDataFrame([(0, -1e9, 1e9), (1, -1e9, 0.0)], "joint int, lo double, hi double")
    streams = spark.createDataFrame([(0, "a", 0.0), (0, "b", 0.25), (1, "a", 0.0)], "ep long, stream string, t double")
    got = states(verdict.judged(verdict.scalars(df, streams, limits)))
    above = sum(x > 0 for x in wave()[:, 1])
    assert got[0, "missing_dropout"][1] == "pass" and got[1, "missing_dropout"] == ("available", "review", 0.0)
    assert got[0, "joint_limit"][1] == ("review" if above else "pass")
    assert got[0, "sensor_synchronization"][1] == "pass" and got[1, "sensor_synchronization"][1] == "na"
    wide = {r.ep: r for r in verdict.scalars(df, streams, limits).collect()}
    assert wide[0].violations == above and wide[0].worst_p95 == 250.0 and wide[1].missing == 1


def test_a_finding_of_ten_points_flips_the_metric_but_not_the_verdict(spark):
    wide = verdict.scalars(frames(spark, wave())).withColumn("spike_count", F.lit(21).cast("long"))
    audit = verdict.judged(wide)
    assert audit.first().verdict == "PASS" and states(audit)[0, "action_discontinuity"] == ("available", "review", 1.0)
    assert verdict.judged(wide.withColumn("spike_count", F.lit(51).cast("long"))).first().verdict == "REVIEW"


def made(spark, n, **over):
    """An audit of ``n`` equal episodes, with columns set by expressions over ep."""
    wide = verdict.scalars(frames(spark, *[wave()] * n))
    return verdict.judged(wide.withColumns({k: F.expr(v) for k, v in over.items()}))


def test_health_by_hand(spark):
    audit = made(spark, 20, time_status="IF(ep < 2, 'exclude', 'pass')", effective_motion_ratio="0.9", spike_count="CAST(0 AS BIGINT)", duration="IF(ep = 0, 2.0, 1.0)")
    dims = report.quality_dimensions(audit).first()
    assert tuple(dims) == (97.5, 95.0, 90.0, 95.0)  # 78 of 80; 50 + 45; median; p95 of 1 and one 2 is 1.05
    got = report.dataset_health(audit).first()
    assert (got.health, got.grade, got.readiness, got.after_cleanup) == (95, "Excellent", "Not Ready", 98)
    assert (got.passes, got.review, got.excluded, got.integrity_passed, got.integrity_failed) == (18, 0, 2, 15, 5)
    assert "Excellent" in text.summary(audit)


@pytest.mark.parametrize("excluded, review, want", [(0, 2, "Ready"), (0, 3, "Conditionally Ready"), (1, 0, "Conditionally Ready"), (2, 0, "Not Ready"), (0, 6, "Not Ready"), (1, 5, "Conditionally Ready")])
def test_readiness_bounds_are_strict(spark, excluded, review, want):
    rows = made(spark, 20, time_status=f"IF(ep < {excluded}, 'exclude', 'pass')", effective_motion_ratio=f"IF(ep >= {20 - review}, 0.25, 0.9)", spike_count="CAST(0 AS BIGINT)")
    got = report.dataset_health(rows).first()
    assert (got.excluded, got.review, got.readiness) == (excluded, review, want)


def test_observations_by_hand(spark):
    audit = made(spark, 20, time_status="IF(ep < 2, 'exclude', 'pass')", spike_count="IF(ep < 3, CAST(4 AS BIGINT), CAST(0 AS BIGINT))", acc_spikes="IF(ep = 0, CAST(2 AS BIGINT), CAST(0 AS BIGINT))", idle_ratio="0.4", effective_motion_ratio="0.6")
    got = [tuple(r)[1:] for r in report.top_observations(audit).orderBy("rank").collect()]
    assert got == [("action_discontinuity", "high", 3, 0.15), ("timestamp_validity", "high", 2, 0.1), ("idle_ratio", "medium", 20, 1.0), ("velocity_acceleration", "low", 1, 0.05), ("sensor_synchronization", "info", 0, 0.0)]
    few = made(spark, 20, spike_count="IF(ep < 1, CAST(4 AS BIGINT), CAST(0 AS BIGINT))", acc_spikes="CAST(0 AS BIGINT)", idle_ratio="0.3", effective_motion_ratio="0.7")
    assert [(r.observation, r.significance) for r in report.top_observations(few).orderBy("rank").collect()] == [("action_discontinuity", "medium"), ("sensor_synchronization", "info")]
    assert report.top_observations(few.limit(0)).collect() == []


def test_own_metrics_decide_if_named(spark):
    df = frames(spark, wave(), wave(3), wave(5))

    def long_enough(episode):
        if len(episode) == 5:
            raise RuntimeError("no")
        return ("pass", 1.0) if len(episode) > 10 else ("review", 0.2)

    own = [custom.PythonMetric("long_enough", long_enough)]
    plain = {r.ep: r.verdict for r in custom.audit(df).collect()}
    assert {r.ep: r.verdict for r in custom.audit(df, own).collect()} == plain
    got = custom.audit(df, own, critical=(*verdict.CRITICAL, "long_enough"))
    assert {r.ep: r.verdict for r in got.collect()} == plain | {1: "EXCLUDE"}
    rows = {r.ep: (r.availability, r.status) for r in verdict.metric_results(got).filter("metric = 'long_enough'").collect()}
    assert rows == {0: ("available", "pass"), 1: ("available", "review"), 2: ("error", "na")}


def test_scores_by_brute_force(spark):
    audit = registry._audit(spark, DIR)
    z = registry._z(audit)
    rows = z.collect()
    names, eps = sorted({r.metric for r in rows}), sorted({r.ep for r in rows})
    table = np.array([[next(r.z for r in rows if (r.ep, r.metric) == (e, m)) for m in names] for e in eps])
    _, sigma, vt = np.linalg.svd(table - table.mean(0), full_matrices=False)
    loadings, shares = calibrate.pca_loadings(z)
    for k in range(2):
        v = vt[k] * np.sign(vt[k][np.argmax(np.abs(vt[k]))])
        assert [loadings[k][m] for m in names] == pytest.approx(v.tolist(), abs=1e-6)
        assert shares[k] == pytest.approx(sigma[k] ** 2 / (sigma**2).sum(), rel=1e-6)
    got = {r.ep: r for r in calibrate.deviation_scores(z, min_episodes=10).collect()}
    assert all(r.method == "pca" for r in got.values())
    weights = np.array([[c[m] for m in names] for c in loadings])
    for i, e in enumerate(eps):
        assert got[e].combined_score == pytest.approx(float(np.sqrt(((weights @ table[i]) ** 2).sum())), rel=1e-6)
        part = [table[i][names.index(m)] for m in calibrate.PORTABLE]
        assert got[e].portable_score == pytest.approx(float(np.sqrt(np.mean(np.square(part)))), rel=1e-6)
    few = calibrate.deviation_scores(z, min_episodes=100).collect()
    assert all(r.method == "rms" for r in few)


@pytest.mark.parametrize("name", ["episode_verdict", "episode_audit", "temporal_sufficiency", "removal_list", "dataset_health"])
def test_frames_are_distributed_once_for_each_use(spark, name):
    """How often the table is scanned: once for an audit; lists that join several results of it scan it again for each."""
    plan = registry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("Relation [")
    assert scans <= {"removal_list": 4, "dataset_health": 2}.get(name, 1), plan
