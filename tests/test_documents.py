"""Reports as documents: what they say, worked out by hand, and that the engine's report reads back."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents, export, report, verdict
from tidemark.sources import sinks


def frames(spark):
    """0: still (no motion, 20 s); 1: moves, time goes back once; 2: moves with a NaN action; 3: two still frames; 4: state only, moves."""
    rows = []
    for i in range(21):
        rows.append((0, i, float(i), [0.0], [0.0, 0.0]))
        rows.append((1, i, float(i if i != 10 else 5), [float(i % 5)], [float(i), 0.0]))
        rows.append((2, i, float(i), [float("nan") if i == 3 else float(i)], [1.0 * i, 1.0]))
        rows.append((4, i, i / 5, None, [float(i), 0.0]))
    rows += [(3, i, float(i), [0.0], [0.0, 0.0]) for i in range(2)]
    return spark.createDataFrame(rows, "ep long, fi int, t double, action array<double>, state array<double>")


@pytest.fixture(scope="module")
def audit(spark):
    wide = verdict.with_empty(verdict.scalars(frames(spark)), spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 9)], "ep long"))
    return verdict.judged(wide).persist()


@pytest.fixture(scope="module")
def by_ep(audit):
    return {r["ep"]: r for r in map(json.loads, documents.episode_reports(audit).toJSON().collect())}


def test_patterns_with_missing_figures(audit):
    got = {}
    for r in report.pattern_types(audit).orderBy("ep", "place").collect():
        got.setdefault(r.ep, []).append((r.pattern, round(r.score, 9)))
    assert got[0] == [("STUCK_LIKE", 20.0), ("FROZEN_LIKE", 10.0)]  # 20 s times 1; 10 times 1
    assert got[3] == [("FROZEN_LIKE", 10.0), ("STUCK_LIKE", 1.0)]  # spikes are not available: 0
    assert got[4] == [("INEFFICIENT", 4.0 + 20 / 100)]  # no action: no low motion; 4 s, path 20
    assert 9 not in got


def test_episode_reports(by_ep):
    still, back, nan, short, state, none = (by_ep[k] for k in (0, 1, 2, 3, 4, 9))
    assert still["behavior_verdict"] == "NEEDS_REVIEW" and still["evidence_level"] == "RISK_SIGNAL" and still["issues"] == ["MOT-03"]
    assert still["risk_signals"] == ["idle_ratio"] and still["unverifiable_metrics"] == ["joint_limit", "sensor_synchronization"]
    assert still["reason_vector"] == {"duration_anomaly": 20.0, "spike_anomaly": 0.0, "motion_ratio_anomaly": 1.0, "velocity_anomaly": 0.0, "path_length_anomaly": 0.0}
    assert still["deviation_score"] == 21.0 and still["pattern_type"] == {"primary": "STUCK_LIKE", "secondary": "FROZEN_LIKE"}
    assert still["diagnosis"]["what"] == "Episode duration = 20.00s, effective motion = 0%."
    assert back["integrity_check"] == {"passed": False, "issues": [{"code": "INT-04", "metric": "timestamp_validity", "reason": "1 backward time step(s)"}]}
    assert back["evidence_level"] == "HARD_FAIL" and back["hard_fail_issues"] == ["INT-04"] and back["behavior_verdict"] == "RECOMMENDED_EXCLUDE"
    assert back["evidence_by_metric"]["timestamp_validity"] == "HARD_FAIL" and back["evidence_by_metric"]["joint_limit"] == "UNVERIFIABLE" and back["evidence_by_metric"]["coverage"] == "RISK_SIGNAL"
    assert nan["issues"] == ["INT-02", "MOT-01", "MOT-03"] and nan["hard_fail_issues"] == ["INT-02"] and nan["integrity_check"]["issues"][0]["reason"] == "1 NaN and 0 infinite values"
    assert set(state["reason_vector"]) == {"duration_anomaly", "velocity_anomaly", "path_length_anomaly"} and "spike_count" not in state["metrics"]
    assert set(short["metrics"]) == {"duration_sec", "path_length", "effective_motion_ratio"}
    assert none["behavior_verdict"] == "RECOMMENDED_EXCLUDE" and none["reason_vector"] == {} and "primary" not in none["pattern_type"]
    assert {r["reference"]["duration_median"] for r in by_ep.values()} == {20.0}


def test_engine_documents_read_back(spark, audit, tmp_path):
    path = f"{tmp_path}/out"
    sinks.save_report(audit, verdict.metric_results(audit), path, "/data/set", {"features": {"observation.state": {}, "action": {}}, "fps": 10, "robot_type": "arm"})
    sinks.save_csv(audit, f"{path}/csv", "EXCLUDE")
    got = {r.ep: (r.dataset, r.frames, r.verdict, r.hard_fail, r.risk) for r in sinks.read_report(spark, f"{path}/engine").collect()}
    own = audit.filter("frames > 0").select("ep", F.lit("set"), "frames", "verdict", "hard_fail", export.risk_points())
    assert got == {r[0]: tuple(r)[1:] for r in own.collect()} and len(got) == 5
    whole = json.loads(spark.read.text(f"{path}/engine").first()[0])
    assert whole["summary"] == {"total_episodes": 6, "verdict_counts": {"PASS": 1, "REVIEW": 2, "EXCLUDE": 3}, "pass_rate": 1 / 6, "exclude_episodes": [1, 2, 9], "review_episodes": [0, 3]}
    assert whole["dataset"] == {"path": "/data/set", "num_episodes": 6, "total_frames": 86, "modalities": ["state"]}
    assert whole["three_layer_aggregates"]["layer1_integrity"]["timestamp_validity"] == {"available": 6, "passed": 5, "failed": 1, "na": 0, "pass_rate": 5 / 6}
    assert [o["observation"] for o in whole["top_observations"]][:2] == ["invalid_values", "timestamp_validity"]
    ep = {e["episode_index"]: e for e in whole["episodes"]}
    assert ep[0]["metrics"]["idle_ratio"]["measurement"] == {"idle_ratio": 1.0, "effective_motion_ratio": 0.0, "total_steps": 20.0, "score_compat": 1.0}
    assert ep[0]["metrics"]["idle_ratio"]["assessment"] == {"status": "review", "severity": "medium", "reason": "effective motion ratio 0.000"} and ep[0]["metrics"]["idle_ratio"]["details"]["method"] == "floor"
    assert ep[2]["metrics"]["invalid_values"]["measurement"] == {} and ep[2]["metrics"]["invalid_values"]["assessment"]["severity"] == "high"
    assert ep[4]["metrics"]["action_discontinuity"]["availability"] == "not_available" and ep[1]["metrics"]["timestamp_validity"]["evidence_level"] == "HARD_FAIL"
    data = json.loads(spark.read.text(f"{path}/dataset").first()[0])
    assert data["profile"] == {"total_episodes": 6, "robot": "arm", "dof": 1, "fps": 10.0, "tasks": 0} and data["dataset_id"] == "/data/set"
    assert data["integrity"]["top_issues"] == {"INT-02": 1, "INT-04": 1} and data["behavior_summary"] == {"pass": 1, "review": 2, "exclude": 3}
    assert data["evidence_summary"]["hard_fail_episodes"] == 2 and data["evidence_summary"]["unverifiable_metric_episodes"]["joint_limit"] == 6
    assert data["pattern_distribution"] == {"stuck_like": 2, "frozen_like": 1, "jittery_like": 0, "inefficient": 2, "unusual": 0}
    assert spark.read.option("header", True).csv(f"{path}/csv").count() == 3


def test_documents_are_bounded(spark, audit, tmp_path):
    documents.engine_documents(audit, "/d/x", size=4).write.option("maxRecordsPerFile", 1).text(f"{tmp_path}/parts")
    docs = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/parts").collect()]
    assert sorted(len(d["episodes"]) for d in docs) == [1, 1, 4] and {d["summary"]["total_episodes"] for d in docs} == {6}
    assert sorted(d["summary"]["exclude_episodes"] for d in docs) == [[], [1, 2], [9]]
    assert {r.ep for r in sinks.read_report(spark, f"{tmp_path}/parts").collect()} == {0, 1, 2, 3, 4}
    none = documents.engine_documents(audit.filter("ep < 0"), "/d/x").collect()
    assert len(none) == 1 and json.loads(none[0][0])["episodes"] == []


def test_one_pass_over_the_frames(spark, audit):
    plain = verdict.judged(verdict.scalars(frames(spark)))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans(report.dataset_health(plain)) == scans(report.temporal_motion_summary(plain)) == 1 and scans(documents.episode_reports(plain)) == 2
    row = report.dataset_health(audit).first()
    # integrity 22 of 24 results of four metrics that are available; temporal 50 + 50 * 5/6; motion: median of 0, 0, 1; durations 20, 20, 20, 1, 4
    assert (row.integrity, row.temporal) == (91.7, 91.7) and row.consistency == 100.0 and row.readiness == "Not Ready"
