"""What is split for size gives the figures of what is not: quantiles, long episodes, long streams, scores of metric subsets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantiles
from tidemark.functions.ranking import numbered
from tidemark.operators import calibrate, metrics

SHARES = (0.0, 0.05, 0.25, 0.5, 0.95, 0.99, 1.0)


def numbers(kind):
    rng = random.Random(kind)
    return {
        "plain": [rng.gauss(0, 1) for _ in range(1500)],
        "ties": [rng.choice([0.0, 1.0, 1.0, 2.0]) for _ in range(3000)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(300)] + [1.7e308, -1.7e308],
        "close": [1.0 + k * 2**-52 for k in range(500)] * 2,
        "one": [4.25],
        "few": [3.0, None, 1.0, float("nan")],
        "infinite": [float("inf")] * 40 + [float("-inf")] * 30 + [rng.uniform(-1, 1) for _ in range(100)],
    }[kind]


@pytest.mark.parametrize("kind", ["plain", "ties", "wide", "close", "one", "few", "infinite"])
def test_refined_quantiles(spark, kind):
    values = numbers(kind)
    df = spark.createDataFrame([(x,) for x in values], "x double").withColumn("none", F.lit(None).cast("double")).persist()
    real = sorted(x for x in values if x is not None and not math.isnan(x))
    for buckets, few in ((16, 8), (256, 1000)):
        got = quantiles.exact_quantiles(df, ("x", "none"), SHARES, buckets, few)
        assert got["none"] == (0, [None] * len(SHARES)) and got["x"][0] == len(real)
        for share, q in zip(SHARES, got["x"][1]):
            spot = share * (len(real) - 1)
            low, high = real[math.floor(spot)], real[math.ceil(spot)]
            assert q == low if low == high else q == pytest.approx(low * (math.ceil(spot) - spot) + high * (spot - math.floor(spot)), rel=1e-12)
    df.unpersist()


def test_refined_profile(spark):
    rng = random.Random(9)
    rows = [(i, rng.gauss(5, 2), float(rng.randint(0, 3)), rng.random()) for i in range(700)]
    scores = spark.createDataFrame(rows[:300], "ep long, duration double, spike_count double, effective_motion_ratio double").persist()
    pairs = zip(*[sorted(f.collect(), key=lambda r: r.metric) for f in (calibrate.reference_profile(scores), calibrate.refined_profile(scores, few=20, buckets=16))], strict=True)
    for one, two in pairs:
        assert one.metric == two.metric and one.n == two.n == 300
        assert list(one)[2:] == pytest.approx(list(two)[2:], abs=1e-12)


def test_neighbours_among_the_doubles(spark):
    tiny = [(x,) for x in [0.0] * 20 + [5e-324] * 20]
    ends = [(x,) for x in [float("-inf")] * 20 + [-1.7976931348623157e308] * 20]
    for values in (tiny, ends):
        got = quantiles.exact_quantiles(spark.createDataFrame(values, "x double"), ("x",), (0.0, 0.25, 0.75, 1.0), 16, 8)
        low, high = values[0][0], values[-1][0]
        assert got == {"x": (40, [low, low, high, high])}


def test_steps_of_refinement_take_no_task_a_part(spark):
    """Nor do they take more jobs for more shares."""
    sc = spark.sparkContext
    rng = random.Random(3)
    rows = [(i, rng.gauss(5, 2), rng.random(), 10.0 ** rng.uniform(-2, 2)) for i in range(900)]
    scores = spark.createDataFrame(rows, "ep long, duration double, spike_count double, effective_motion_ratio double").repartition(40).persist()
    assert scores.count() == 900
    tracker, jobs = sc.statusTracker(), {}
    try:
        for name, shares in (("one", (0.5,)), ("five", (0.5, 0.05, 0.25, 0.75, 0.95))):
            sc.setJobGroup(name, name)
            quantiles.exact_quantiles(scores, ("duration", "spike_count", "effective_motion_ratio"), shares, few=4)
            jobs[name] = tracker.getJobIdsForGroup(name)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        scores.unpersist()
    stages = [tracker.getStageInfo(s) for ids in jobs.values() for j in ids for s in tracker.getJobInfo(j).stageIds]
    ran = [s.numTasks for s in stages if s is not None and s.numCompletedTasks]
    assert ran and max(ran) <= sc.defaultParallelism
    assert len(jobs["five"]) <= len(jobs["one"]) + 3  # at most one more step


def long_frames(spark):
    rng = np.random.default_rng(4)
    rows = []
    for ep, n in ((1, 1000), (2, 401), (3, 23), (4, 1), (5, 2), (6, 300)):
        still = np.repeat(rng.random(n // 10 + 1) < 0.4, 10)[:n]
        steps = rng.normal(1, 0.05, (n, 2)) * ~still[:, None]
        steps[rng.random(n) < 0.01] += 4
        action, state, t = steps.cumsum(0), rng.normal(0, 1, (n, 3)), np.arange(n) / 10
        if ep == 6:
            action[40, 0], t[100] = float("nan"), t[99]
        rows += [(ep, i, float(t[i]), action[i].tolist(), state[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "ep long, fi int, t double, action array<double>, state array<double>")


@pytest.mark.parametrize("block", [23, 100])
def test_blocks_change_no_figure(spark, block):
    frames = long_frames(spark)
    want = {r.ep: r.asDict() for r in metrics.measure(frames).collect()}
    got = {r.ep: r.asDict() for r in metrics.measure(frames, block=block).collect()}
    assert got.keys() == want.keys() == {1, 2, 3, 4, 5, 6}
    assert want[1]["transitions"] > 10 and want[1]["spike_count"] > 3 and want[1]["run_max"] > 10 and want[1]["valid_5"] > 0
    for ep, row in want.items():
        for k, v in row.items():
            same = got[ep][k] == pytest.approx(v, rel=1e-9, nan_ok=True) if isinstance(v, float) else got[ep][k] == v
            assert same, (ep, k, v, got[ep][k])


def test_one_long_episode_is_many_tasks(spark):
    frames = spark.range(20_000).select(F.lit(1).cast("long").alias("ep"), F.col("id").cast("int").alias("fi"), (F.col("id") / 10).alias("t"), F.array(F.sin("id")).alias("action"), F.array(F.cos("id")).alias("state"))
    cut = metrics.Cut.of(frames, 500)
    dealt = cut.deal(frames).repartition(8, "ep", "block").withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in dealt.groupBy("task").count().collect()]
    assert len(tasks) == 8 and max(tasks) < 0.5 * sum(tasks)
    assert metrics.measure(frames, block=500).first().frames == 20_000
    with pytest.raises(ValueError):
        metrics.measure(frames, block=10)


@pytest.mark.parametrize("bucket", [0.5, 3.0, 1000.0])
def test_bucketed_offsets(spark, bucket):
    rng = random.Random(2)
    rows = [(ep, s, round(rng.uniform(-20, 20), 1)) for ep in range(3) for s, n in (("a", 60), ("b", 25), ("c", 2)) for _ in range(n)]
    rows += [(0, "far", 500.0), (0, "far", -500.0), (9, "alone", 1.0)]
    streams = spark.createDataFrame(rows, "ep long, stream string, t double")
    order = lambda df: sorted(map(tuple, df.collect()))
    want = order(metrics.sensor_offsets(streams))
    assert order(metrics.sensor_offsets(streams, bucket)) == want
    by = {}
    for ep, s, t in rows:
        by.setdefault((ep, s), []).append(t)
    one = {(r[0], r[1], r[2], r[3]): r[4] for r in want}
    for (ep, a, b, t), off in one.items():
        other = min((a, b), key=lambda s: (len(by[ep, s]), s == b)) == a and b or a
        assert abs(off) == pytest.approx(min(abs(x - t) for x in by[ep, other]) * 1000, abs=1e-6)


def z_rows(spark, names):
    rng = random.Random(1)
    return spark.createDataFrame([(i, k, rng.gauss(0, 1), 0.5) for i in range(5) for k in names], "ep long, metric string, z double, rank double")


def test_scores_of_metric_subsets(spark):
    p, q = calibrate.PORTABLE, calibrate.PLATFORM
    rms = lambda z, names: math.sqrt(sum(z[k] ** 2 for k in names) / len(names))
    pca = lambda z, parts: math.sqrt(sum(sum(z[k] * w for k, w in c.items()) ** 2 for c in parts))
    of_p, of_q, of_all = ([dict(zip(names, np.linspace(-0.5, 1, len(names)))), dict(zip(names, np.linspace(1, 0.2, len(names))))] for names in (p, q, p + q))
    for names, parts, want in [
        (p + q, of_all, (lambda z: rms(z, p), lambda z: rms(z, q), lambda z: pca(z, of_all), "pca")),
        (p + q, of_p, (lambda z: pca(z, of_p), lambda z: rms(z, q), lambda z: pca(z, of_p), "pca")),
        (p + q, of_q, (lambda z: rms(z, p), lambda z: pca(z, of_q), lambda z: pca(z, of_q), "pca")),
        (p + q, [], (lambda z: rms(z, p), lambda z: rms(z, q), lambda z: rms(z, p + q), "rms")),
        (p, of_p, (lambda z: pca(z, of_p), lambda z: 0.0, lambda z: pca(z, of_p), "pca")),
        (p, of_all, (lambda z: rms(z, p), lambda z: 0.0, lambda z: rms(z, p), "rms")),
    ]:
        table = z_rows(spark, names)
        z = {}
        for r in table.collect():
            z.setdefault(r.ep, {})[r.metric] = r.z
        for r in calibrate.deviation_scores(table, parts, score_type="combined").collect():
            assert [r.portable_score, r.platform_score, r.combined_score] == pytest.approx([f(z[r.ep]) for f in want[:3]])
            assert r.deviation_score == r.combined_score and r.method == want[3]
        got = calibrate.deviation_scores(table, parts, score_type="portable").first()
        assert got.deviation_score == got.portable_score and got.method == ("pca" if parts and set(parts[0]) <= set(p) else "rms")
    with pytest.raises(ValueError):
        calibrate.deviation_scores(table, [], score_type="all")


def test_portable_calibration_is_the_default(spark):
    rng = random.Random(3)
    columns = (*calibrate.PORTABLE, *calibrate.PLATFORM)
    audit = spark.createDataFrame([(i, *[rng.random() for _ in columns]) for i in range(40)], "ep long, " + ", ".join(f"{c} double" for c in columns))
    profile, parts, shares = calibrate.calibrate(audit)
    assert {r.metric for r in profile.collect()} == set(calibrate.PORTABLE) and len(parts) == len(shares) == 2 and set(parts[0]) == set(calibrate.PORTABLE)
    scored = calibrate.score_against(audit, profile, parts).collect()
    assert len(scored) == 40 and all(r.method == "pca" and r.platform_score == 0 and r.combined_score == r.portable_score > 0 for r in scored)
    wide = calibrate.calibrate(audit, include_platform=True)
    assert {r.metric for r in wide[0].collect()} == set(columns) == set(wide[1][0])
    assert calibrate.calibrate(audit, min_episodes=41)[1:] == ([], [])


def test_parameters_by_dataset(spark):
    """One plan with a table of parameters gives what a plan for each dataset gives."""
    frames = long_frames(spark).withColumn("set", F.concat(F.lit("d"), (F.col("ep") % 3).cast("string"))).withColumn("t", F.when(F.col("ep") == 2, None).otherwise(F.col("t")))
    table = spark.createDataFrame([("d1", 1e6, 1.0, 0.9, 12, 4, None), ("d2", None, None, None, None, None, 5.0)], "set string, spike_z double, idle_multiple double, idle_floor double, bins int, resolution int, default_hz double")
    got = {r.ep: r.asDict() for r in metrics.measure(metrics.with_parameters(frames, table, "set")).collect()}
    plain = {r.ep: r.asDict() for r in metrics.measure(frames).collect()}
    assert got[3] == plain[3] and got[6]["n"] == plain[6]["n"]  # d0 has no row: the defaults
    assert got[2]["duration"] == pytest.approx(400 / 5.0) and plain[2]["duration"] == pytest.approx(400 / 30.0)
    assert got[1]["spike_count"] < plain[1]["spike_count"] and got[1]["occupancy_rate"] == got[1]["occupied"] / 4**3 != plain[1]["occupancy_rate"]
    assert got[1]["thr"] >= 0.9 and got[1]["method"] in ("bimodal_gap", "floor", "mad")
    blocks = {r.ep: r.asDict() for r in metrics.measure(metrics.with_parameters(frames, table, "set"), block=50).collect()}
    for ep in (1, 2):
        assert all(blocks[ep][k] == pytest.approx(got[ep][k], rel=1e-9) for k in ("thr", "spike_count", "idle_ratio", "duration", "occupancy_rate"))


def test_numbers_over_a_whole_table(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), rng.choice([0.5, 1.0, 2.0]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b double, i long").repartition(7)
    got = numbered(df, [F.asc("a"), F.desc("b"), F.asc("i")]).collect()
    want = {r[2]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[0], -r[1], r[2])))}
    assert {r.i: r["rank"] for r in got} == want and len(got) == 2000
    assert numbered(df.limit(0), ["i"]).collect() == []
    plan = numbered(df, ["a", "i"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
