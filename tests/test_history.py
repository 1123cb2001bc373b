"""States of parts against the audit of the whole."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, report, verdict
from tidemark.sources import adapters, sinks

SF = "/root/testdata/sf0.001"
EXACT = ["episodes", "passes", "review", "excluded", "integrity_pass_rate", "n_stuck", "n_frozen", "n_jittery", "n_inefficient", "n_unusual", "total_spikes"]
MEDIANS = list(history.MEDIANS.values())


@pytest.fixture(scope="module")
def audit(spark):
    events = adapters.table(spark, SF, "events")
    wide = verdict.scalars(adapters.event_frames(events), adapters.event_streams(events))
    return verdict.judged(wide).persist()


def one(df):
    return [r.asDict() for r in df.collect()]


def test_parts_merge_to_the_state_of_the_whole(spark, audit):
    name, run = F.lit("a"), F.lit("r")
    whole = history.states(audit, name, run)
    parts = [history.states(audit.filter(F.col("ep") % 3 == k), name, run) for k in range(3)]
    nothing = history.states(audit.filter("ep is null"), name, run)
    rows = lambda s: sorted(map(str, s.collect()))
    left = history.merged(history.merged(parts[0], parts[1]), parts[2], nothing)
    right = history.merged(parts[2], history.merged(parts[1], parts[0]))
    assert rows(left.select(whole.columns)) == rows(right.select(whole.columns)) == rows(whole)
    assert nothing.count() == 0 and whole.schema.simpleString() == spark.createDataFrame([], history.STATE).schema.simpleString()


def test_snapshot_of_the_state_is_that_of_the_audit(audit):
    name, run = F.lit("a"), (F.col("ep") % 4).cast("string")
    got = {r["run"]: r for r in one(history.snapshots(history.states(audit, name, run)))}
    want = {r["run"]: r for r in one(report.snapshots(audit, name, run))}
    assert set(got) == set(want) and len(got) == 4
    for k, w in want.items():
        assert list(got[k]) == list(w)
        assert {c: got[k][c] for c in EXACT} == {c: w[c] for c in EXACT}
        assert got[k]["mean_deviation_score"] == pytest.approx(w["mean_deviation_score"], abs=1e-8)
        for c in MEDIANS:
            assert got[k][c] == (None if w[c] is None else pytest.approx(w[c], rel=0.01, abs=1e-9))
    assert any(w["sync_median"] is not None for w in want.values())


@pytest.mark.parametrize("values, want", [([0.0, 0.0, 5.0], 0.0), ([2.0], 2.0), ([1.0, 3.0], 2.0), ([7.0] * 5, 7.0), ([float("nan"), None, 4.0], 4.0), ([None], None), ([float("inf"), 1.0], 1.0)])
def test_medians_of_few_values(spark, audit, values, want):
    some = audit.limit(1).drop("occupancy_rate").crossJoin(spark.createDataFrame([(v,) for v in values], "occupancy_rate double"))
    (got,) = one(history.snapshots(history.states(some, F.lit("a"), F.lit("r"))))
    assert got["occupancy_median"] == want and got["episodes"] == len(values)


def test_stored_parts_make_the_history(spark, audit, tmp_path):
    path = str(tmp_path / "states")
    assert sinks.load_states(spark, None).count() == sinks.load_states(spark, path).count() == 0
    for part in range(2):
        sinks.save_state(audit.filter(F.col("ep") % 2 == part), "set", "1", f"p{part}", path)
    sinks.save_state(audit.filter(F.col("ep") % 2 == 1), "set", "1", "p1", path)  # once more: replaces itself
    sinks.save_state(audit.filter(F.col("ep") % 2 == 0), "set", "2", "p0", path)
    got = {r["run"]: r for r in one(history.snapshots(sinks.load_states(spark, path)))}
    (want,) = one(report.snapshots(audit, F.lit("set"), F.lit("1")))
    assert {c: got["1"][c] for c in EXACT} == {c: want[c] for c in EXACT} and got["2"]["episodes"] < got["1"]["episodes"]
    rows = report.trend(history.snapshots(sinks.load_states(spark, path)), "total_episodes").orderBy("run").collect()
    assert [(r.name, r.run) for r in rows] == [("set", "1"), ("set", "2")] and rows[1].change == got["2"]["episodes"] - got["1"]["episodes"]
