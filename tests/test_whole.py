"""Queries that must not leave part of their job out."""

import collections

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"


def test_zero_frame_guard_takes_every_customer(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("user_id", F.col("user_id") + 250)
    events.write.parquet(f"{tmp_path}/events.parquet")
    frames = {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect() if r.user_id < 300}
    got = registry.queries()["zero_frame_guard"](spark, str(tmp_path)).collect()
    assert {r.ep: r.frames for r in got} == {k: frames.get(k, 0) for k in range(300)} and len(got) == 300
    assert all((r.verdict == "EXCLUDE") == (r.ep not in frames) for r in got)
    kept = registry.queries()["validation_records"](spark, str(tmp_path)).collect()
    assert frames and {r.ep: r.frames for r in kept} == frames


def vectors(spark):
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect():
        by[r.label].append(np.array(r.embedding, np.float64))
    return {k: np.stack(v) for k, v in by.items()}


def test_joint_spikes_of_all_joints_by_brute_force(spark):
    want = {}
    for ep, x in vectors(spark).items():
        d2 = np.abs(np.diff(x, 2, axis=0))
        med = np.median(d2, 0)
        mad = np.median(np.abs(d2 - med), 0)
        spikes = ((mad > 0) & (np.abs(0.6745 * (d2 - med)) > 5 * mad)).sum(0)
        want |= {(ep, j): int(n) for j, n in enumerate(spikes)}
    got = registry.queries()["joint_spikes"](spark, DIR).collect()
    assert {(r.ep, r.joint): r.spikes for r in got} == want and len(got) == len(want)
    assert {j for _, j in want} == set(range(64))


def test_underrepresented_cells_are_thin_or_empty(spark):
    want = {}
    for ep, x in vectors(spark).items():
        lo, hi = x[:, :3].min(0), x[:, :3].max(0)
        cell = ((x[:, None, :3] - lo) >= np.arange(1, 10)[None, :, None] * ((hi - lo) / 10)).sum(1)
        counts = collections.Counter(map(tuple, cell.tolist()))
        want |= {(ep, *i): counts[i] for i in np.ndindex(10, 10, 10) if counts[i] < 0.1 * len(x) / 1000}
    got = registry.queries()["underrepresented_cells"](spark, DIR).collect()
    assert {(r.ep, r.b0, r.b1, r.b2): r.n for r in got} == want and len(got) == len(want)


def test_thin_cells_with_frames_are_kept_and_others_not(spark):
    state = [[0.0] * 3] * 20_100 + [[1.0] * 3, [0.5, 0.5, 0.5], [0.5, 0.5, 0.5], [0.5, 0.5, 0.5]]
    df = spark.createDataFrame([(7, i, x) for i, x in enumerate(state)], "ep long, fi int, state array<double>")
    got = {(r.b0, r.b1, r.b2): r.n for r in metrics.underrepresented_cells(df).collect()}
    assert len(got) == 998 and got[9, 9, 9] == 1 and (5, 5, 5) not in got and (0, 0, 0) not in got and got[0, 0, 1] == 0
