"""The table of episodes, issue counts, exports and result constructors on hand-made episodes."""

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import examples, main
from tidemark.operators import calibrate, custom, overview, report, text, verdict
from tidemark.sources import sinks

WIDE = "ep long, frames long, verdict string, severity int, spike_count long, effective_motion_ratio double, idle_ratio double, worst_p95 double, occupancy_rate double, dt_p50 double, violations long, acc_spikes long, results array<" + verdict.RESULT + ">"


def result(metric, status="pass", score=None):
    available = "not_available" if status == "na" else "available"
    return (metric, available, status, status == "pass", status in ("review", "exclude"), (1.0 if status == "pass" else 0.0) if score is None else score)


@pytest.fixture(scope="module")
def audit(spark):
    both = ("action_discontinuity", "review", 1.0), ("idle_ratio", "review", 1.0)
    rows = [
        # deviation: one of four available results at 0; both behavioural findings also fail their metrics
        (0, 50, "REVIEW", 40, 60, 0.25, 0.75, None, 0.2, 10.0, None, 0, [result("timestamp_validity"), result("joint_limit", "na"), result("velocity_acceleration", "review"), *[result(*x) for x in both]]),
        (1, 50, "EXCLUDE", 0, 0, 0.9, 0.1, 4.0, 0.4, 20.0, 3, 0, [result("timestamp_validity", "exclude"), result("joint_limit", "review"), result("action_discontinuity"), result("idle_ratio")]),
        (2, 9, "PASS", 0, 0, 1.0, 0.0, 8.0, 0.6, 30.0, 0, 2, [result("timestamp_validity", score=0.9), result("joint_limit"), result("action_discontinuity"), result("idle_ratio")]),
        (3, 0, "PASS", 0, None, None, None, None, None, None, None, None, [result("joint_limit", "na")]),
    ]
    full = [(*r[:-1], [next((x for x in r[-1] if x[0] == k), result(k, "na")) for k in verdict.METRICS]) for r in rows]
    return spark.createDataFrame(full, WIDE).persist()


def test_table_and_export(spark, audit, tmp_path):
    scores = spark.createDataFrame([(0, 1.234, "rms")], "ep long, portable_score double, method string")
    got = {r.ep: r for r in overview.episode_overview(audit, scores).collect()}
    assert tuple(got[0]) == (0, 50, "PASS", "—", "REVIEW", 25.0, "Stuck-like (risk signal)", "VELOCITY-ACCELERATION, ACTION-DISCONTINUITY, IDLE-RATIO", 3, 1.23, "rms")
    assert tuple(got[1])[2:9] == ("FAIL", "TIMESTAMP-VALIDITY, JOINT-LIMIT", "EXCLUDE", 50.0, "—", "TIMESTAMP-VALIDITY, JOINT-LIMIT", 2) and got[1].portable_score is None
    assert (got[2].deviation, got[2].pattern, got[2].top_issues, got[2].issue_count) == (2.5, "—", "None", 0)
    assert got[3].deviation == 0.0  # nothing is available
    assert [(r.rank, r.ep, r.deviation) for r in report.episode_ranks(audit).orderBy("rank").collect()] == [(1, 1, 50.0), (2, 0, 25.0), (3, 2, 2.5), (4, 3, 0.0)]
    assert {r.ep: (r["class"], r.issue_severity) for r in report.episode_table(audit).collect()} == {0: (1, 40.0), 1: (0, 50.0), 2: (2, pytest.approx(2.5)), 3: (2, 0.0)}
    decisions = spark.createDataFrame([(0, "KEEP", None), (2, "REMOVE", "why, so")], "ep long, decision string, notes string")
    sinks.save_csv(audit, f"{tmp_path}/csv", "PASS", "REVIEW", decisions=decisions)
    rows = {r.episode_id: r for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()}
    assert set(rows) == {"0", "2", "3"} and rows["2"].user_notes == "why, so" and rows["0"].user_decision == "KEEP" and not rows["3"].user_decision
    assert (rows["0"].issue_severity_score, rows["0"].issue_count) == ("40.0", "4") and rows["0"].top_issues.endswith("IDLE-RATIO; PATTERN_STUCK-LIKE (RISK SIGNAL)")


def test_issues_count_findings_beside_failures(audit):
    got = [tuple(r) for r in overview.top_issues(audit).collect()]
    assert [r[:4] for r in got] == [("action_discontinuity", "ACTION-DISCONTINUITY", 2, "warning"), ("idle_ratio", "IDLE-RATIO", 2, "warning"), ("timestamp_validity", "TIMESTAMP-VALIDITY", 1, "critical"), ("joint_limit", "JOINT-LIMIT", 1, "critical"), ("velocity_acceleration", "VELOCITY-ACCELERATION", 1, "warning")]
    assert [r[4] for r in got] == ["RISK_SIGNAL"] * 2 + ["HARD_FAIL"] * 2 + ["RISK_SIGNAL"] and got[2][5] is None and got[1][5] == "Stuck/Frozen-like (risk signal)"
    assert len(overview.top_issues(audit, 2).collect()) == 2
    assert tuple(overview.issue_counts(audit).first()) == (1, 1, 1, 13 * 4 - 5 + 1 - 4 - 4, 0)
    assert tuple(overview.issue_counts(audit.filter("ep < 0")).first()) == (0, 0, 0, 0, 0) and overview.top_issues(audit.filter("ep < 0")).count() == 0


def test_lists_and_older_aggregates(audit):
    many = audit.select(F.explode(F.array(*[F.lit(k) for k in (0, 10, 11)])).alias("k"), "*").withColumn("ep", F.col("ep") + F.col("k"))
    assert {(r.verdict, r.part): r.episodes for r in overview.listed_episodes(many, 10).collect()} == {("REVIEW", 0): [0], ("REVIEW", 1): [10, 11], ("EXCLUDE", 0): [1], ("EXCLUDE", 1): [11, 12]}
    sync = audit.withColumn("results", F.transform("results", lambda r: F.when(r["metric"] == "sensor_synchronization", r.withField("availability", F.lit("available"))).otherwise(r)))
    row = overview.legacy_aggregates(sync).first().asDict(recursive=True)
    assert row["temporal"] == {"dt_median_ms": {"median": 20.0, "p95": 29.0, "p99": pytest.approx(29.8)}, "sensor_sync_worst_p95_ms": {"median": 6.0, "p95": pytest.approx(7.8), "max": 8.0}}
    assert row["motion"] == {"total_joint_violations": 3, "total_discontinuity_spikes": 60, "discontinuity_affected_episodes": 1, "idle_ratio": {"p5": pytest.approx(0.01), "median": 0.1, "p95": pytest.approx(0.685)}}
    none = overview.legacy_aggregates(audit.filter("ep < 0")).first().asDict(recursive=True)
    assert none["temporal"]["sensor_sync_worst_p95_ms"] == {"median": 0.0, "p95": 0.0, "max": 0.0} and none["motion"]["idle_ratio"]["p5"] == 0.0 and none["distribution"]["coverage"]["max"] == 0.0


def test_observations_in_words(audit):
    got = {r.observation: r.description for r in text.described(audit, 9, occupancy=True).collect()}
    assert got["timestamp_validity"] == "Time runs backward in 1 of 4 episode(s)"
    assert got["action_discontinuity"].startswith("60 jump(s) of the action in 1 of 4 episode(s)")
    assert got["sensor_synchronization"] == "Sensor offsets: no episode has time stamps by stream"
    assert set(got) == {r.observation for r in report.top_observations(audit, 9, occupancy=True).collect()}


def test_result_constructors(spark):
    rows = spark.range(5).withColumnRenamed("id", "ep")
    figures = F.create_map(F.lit("x"), F.col("ep").cast("double"))
    chosen = F.when(F.col("ep") == 0, custom.passed("own", figures)).when(F.col("ep") == 1, custom.review("own", figures, F.concat(F.lit("x is "), F.col("ep")))).when(F.col("ep") == 2, custom.exclude("own", "broken")).when(F.col("ep") == 3, custom.not_available("own", "nothing")).otherwise(custom.error("own"))
    got = [tuple(r) for r in rows.select("ep", chosen.alias("r")).select("r.availability", "r.status", "r.severity", "r.reason", "r.measurement", "r.passed", "r.has_finding", "r.score").collect()]
    assert got == [
        ("available", "pass", None, None, {"x": 0.0}, True, False, 1.0),
        ("available", "review", "medium", "x is 1", {"x": 1.0}, False, True, 0.5),
        ("available", "exclude", "high", "broken", {}, False, True, 0.0),
        ("not_available", "na", None, "nothing", {}, False, False, 0.0),
        ("error", "skipped", "high", "", {}, False, False, 0.0),
    ]
    own = rows.select("ep", custom.review("own", F.create_map(F.lit("score_compat"), F.lit(0.7))).alias("r")).select("r.score").first()
    assert own.score == 0.7


class Share:
    """A user's metric made of the constructors."""

    name = "share"

    def compute(self, frames):
        n = F.count("*").alias("n")
        return frames.groupBy("ep").agg(n).select("ep", F.when(F.col("n") > 3, custom.passed("share")).otherwise(custom.review("share")).alias("r")).select("ep", "r.*")


def test_constructors_decide_verdicts(spark):
    rows = [(e, i, float(i), [float(i % 7)], [float(i % 5)]) for e, n in ((0, 3), (1, 30)) for i in range(n)]
    frames = spark.createDataFrame(rows, "ep long, fi int, t double, action array<double>, state array<double>")
    got = {r.ep: r.verdict for r in custom.audit(frames, [Share()], review=("share",)).collect()}
    assert got[0] == "REVIEW"


def test_one_scan(spark, audit):
    rows = [(e, i, float(i), [float(i % 7)], [float(i % 5)]) for e in range(3) for i in range(9)]
    plain = verdict.judged(verdict.scalars(spark.createDataFrame(rows, "ep long, fi int, t double, action array<double>, state array<double>")))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    for plan in (report.episode_table, report.episode_csv, overview.episode_overview, overview.export_rows, overview.issue_counts, overview.top_issues, overview.legacy_aggregates):
        assert scans(plan(plain)) == 1, plan
    assert scans(report.episode_report(plain)) == 2
    scores = calibrate.score_metrics(plain)
    assert scans(scores) == 1


def test_example_command(tmp_path, capsys):
    (tmp_path / "arm" / "meta").mkdir(parents=True)
    (tmp_path / "arm" / "meta" / "info.json").write_text("{}")
    (tmp_path / "other").mkdir()
    assert main(["example", str(tmp_path)]) == 0
    out = capsys.readouterr().out
    assert f"audit {tmp_path}/arm" in out and "other" not in out
    assert examples(f"{tmp_path}/none").startswith("No datasets")
