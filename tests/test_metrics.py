import numpy as np
import pytest

from tidemark.operators import metrics, verdict

SCHEMA = "ep long, fi int, t double, action array<double>, state array<double>"


def frames(spark, *episodes):
    rows = [(k, i, i / 10, [float(x) for x in a], [float(x) for x in a]) for k, e in enumerate(episodes) for i, a in enumerate(e)]
    return spark.createDataFrame(rows, SCHEMA)


def two(x):
    return np.stack([x, x / 2], 1)


def test_idle_ratio_of_bimodal_frozen_and_ramp(spark):
    half = np.concatenate([np.zeros(50), np.linspace(0, 1, 50)])
    got = {r.ep: r for r in metrics.idle_ratio(frames(spark, two(half), np.zeros((60, 2)), two(np.linspace(0, 5, 100)))).collect()}
    assert 0.4 <= got[0].effective_motion_ratio <= 0.6
    assert got[0].idle_ratio + got[0].effective_motion_ratio == pytest.approx(1)
    assert got[1].idle_ratio > 0.99
    assert got[2].idle_ratio < 0.1


def test_spikes_are_found_and_survive_scaling(spark):
    x = np.linspace(0, 5, 200) + np.random.default_rng(7).normal(0, 0.01, 200)
    x[[20, 60, 100, 140, 180]] += 25
    got = {r.ep: r.spike_count for r in metrics.action_discontinuity(frames(spark, two(x), two(1024 * x))).collect()}
    assert got[0] >= 5 and got[0] == got[1]


def test_not_finite_excludes_and_short_is_na(spark):
    bad = np.zeros((50, 2))
    bad[10, 0] = np.nan
    got = {r.ep: r for r in metrics.action_discontinuity(frames(spark, bad, np.zeros((2, 2)))).collect()}
    assert got[0].status == "exclude" and got[0].spike_count is None
    assert got[1].status == "na"


def test_time_steps_backward_exclude_and_equal_ones_lower_the_score(spark):
    rows = [(0, 0, 0.0), (0, 1, 2.0), (0, 2, 1.0), (1, 0, 0.0), (1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0)]
    df = spark.createDataFrame([(e, i, t, [0.0], [0.0]) for e, i, t in rows], SCHEMA)
    got = {r.ep: r for r in metrics.timestamp_validity(df).collect()}
    assert got[0].status == "exclude" and got[1].status == "pass" and got[1].score == 0.75


def test_verdict_wiring(spark):
    m = "ep long, metric string, availability string, has_finding boolean, measurement map<string,double>"
    jump = lambda e, n: (e, "action_discontinuity", "available", False, {"spike_count": float(n)})
    idle = lambda e, x: (e, "idle_ratio", "available", False, {"effective_motion_ratio": x})
    cells = lambda e, x: (e, "distribution", "available", False, {"occupancy_rate": x})
    rows = [jump(1, 150), idle(1, 0.9), idle(2, 0.05), jump(3, 200), idle(3, 0.05), cells(3, 0.03), jump(4, 2), idle(4, 0.75), cells(4, 0.42), jump(5, 25), idle(5, 0.45), idle(6, 0.9), (6, "invalid_values", "available", True, {}), (7, "invalid_values", "not_available", True, {})]
    got = {r.ep: (r.severity, r.verdict) for r in verdict.classify(spark.createDataFrame(rows, m)).collect()}
    assert got == {1: (30, "REVIEW"), 2: (40, "REVIEW"), 3: (100, "REVIEW"), 4: (0, "PASS"), 5: (20, "REVIEW"), 6: (0, "EXCLUDE"), 7: (0, "PASS")}


def test_known_verdicts_of_the_small_tables(spark):
    import __spark_entry__

    assert {r.verdict: 1 for r in __spark_entry__.entry(spark).collect()} == {"PASS": 1, "REVIEW": 1}
    counts = {r.verdict: r.episodes for r in __spark_entry__.queries()["verdict_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert counts == {"PASS": 4, "REVIEW": 11, "EXCLUDE": 0}
