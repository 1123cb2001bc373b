import json

import pytest

from tidemark.__main__ import audited, main
from tidemark.operators import calibrate, export, history, report
from tidemark.sources import layouts, sinks


@pytest.fixture
def dataset(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "set"
    (root / "data/chunk-000").mkdir(parents=True)
    (root / "meta/episodes/chunk-000").mkdir(parents=True)
    (root / "meta/info.json").write_text(json.dumps({"codebase_version": "v3.0", "fps": 10, "features": {"observation.state": {}, "action.arm": {}, "timestamp": {}}}))
    pq.write_table(pa.Table.from_pylist([{"episode_index": k, "length": 20} for k in range(3)]), root / "meta/episodes/chunk-000/file-000.parquet")
    value = lambda k, i: float("nan") if (k, i) == (1, 5) else float(i)
    rows = [{"episode_index": k, "timestamp": i / 10, "action": [value(k, i)], "observation.state": [float(i)], "note": "x"} for k in range(3) for i in range(20)]
    pq.write_table(pa.Table.from_pylist(rows), root / "data/chunk-000/file-000.parquet")
    return str(root)


def test_clean_copy_reads_back_without_the_excluded_episode(spark, dataset, tmp_path):
    out = str(tmp_path / "clean")
    assert main(["clean", dataset, out], spark) == 0
    with open(f"{out}/meta/info.json", encoding="utf-8") as f:
        assert json.load(f)["total_episodes"] == 2
    info = layouts.load_info(spark, out)
    assert (info["total_episodes"], info["total_frames"]) == (2, 40)
    assert {r.ep for r in layouts.read_frames(spark, out, info).select("ep").distinct().collect()} == {0, 2}
    assert {r.episode_index for r in layouts.episodes_meta(spark, out, "v3.0").collect()} == {0, 2}
    assert "note" in spark.read.parquet(f"{out}/data/chunk-000").columns


def test_audit_prints_reports_and_keeps_runs(spark, dataset, tmp_path, capsys):
    for run in ("1", "2", "2"):
        assert 2 == main(["audit", dataset, "--history", str(tmp_path / "runs"), "--run", run, "--report", str(tmp_path / "report")], spark)
    assert "EXCLUDE 1" in capsys.readouterr().out
    history = sinks.load_history(spark, str(tmp_path / "runs"))
    assert [(r.name, r.run, r.episodes) for r in history.orderBy("run").collect()] == [("set", "1", 3), ("set", "2", 3)]
    assert [r.change for r in report.trend(history, "pass_rate").orderBy("run").collect()] == [None, 0.0]
    assert spark.read.json(str(tmp_path / "report/episodes")).count() == 3


def test_audit_of_parts_keeps_states(spark, dataset, tmp_path):
    for part in ("a", "b", "b"):
        assert 2 == main(["audit", dataset, "--history", str(tmp_path / "states"), "--name", "both", "--part", part], spark)
    (got,) = history.snapshots(sinks.load_states(spark, str(tmp_path / "states"))).collect()
    assert (got.name, got.run, got.episodes, got.excluded) == ("both", "0", 6, 2)


def test_calibrate_writes_a_reference(spark, dataset, tmp_path):
    with pytest.raises(ValueError, match="too few"):
        main(["calibrate", dataset, str(tmp_path / "ref")], spark)
    assert main(["calibrate", dataset, str(tmp_path / "ref"), "--min-episodes", "2"], spark) == 0
    profile, loadings, shares = calibrate.load_profile(spark, str(tmp_path / "ref"))
    assert {r.metric for r in profile.collect()} >= {"duration", "spike_count"} and len(loadings) == len(shares)
    audit = audited(spark, dataset)
    got = calibrate.score_against(audit, profile, loadings)
    assert got.count() == 3 and set(got.columns) == {"ep", "portable_score", "platform_score", "combined_score", "method", "percentile"}
    assert audited(spark, dataset, 1).count() == 1
    assert main(["recommend", dataset, "--policy", "act"], spark) == 0


def test_feature_keys_and_labels(spark, dataset, tmp_path):
    got = layouts.feature_keys(spark, layouts.load_info(spark, dataset))
    assert sorted(map(tuple, got.collect())) == [("action", "arm"), ("modality", "state")]
    (tmp_path / "labels.csv").write_text("\ufeffepisode_index,label\n3, remove \n4,good\n", encoding="utf-8")
    assert [tuple(r) for r in sinks.load_labels(spark, str(tmp_path / "labels.csv")).orderBy("ep").collect()] == [(3, "REMOVE"), (4, "KEEP")]


def test_reports_to_blind_sample_to_labels(spark, tmp_path):
    metric = lambda ok, **m: {"availability": "available", "passed": ok, "measurement": m}
    episode = lambda k, verdict, frames, bad, spikes, moving: {"episode_index": k, "num_frames": frames, "verdict": verdict, "metrics": {"invalid_values": metric(not bad), "action_discontinuity": metric(True, spike_count=spikes), "idle_ratio": metric(True, effective_motion_ratio=moving)}}
    episodes = [episode(0, "exclude", 9, True, 0, 0.9), episode(1, "REVIEW", 9, False, 100, 0.1), episode(2, "PASS", 9, False, 0, 0.9), episode(3, "PASS", 0, False, 0, 0.9), episode(4, "ODD", 9, False, 0, 0.9)]
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports/a.json").write_text(json.dumps({"dataset": {"path": "/x/arm/"}, "episodes": episodes}, indent=1))
    rows = sinks.read_report(spark, str(tmp_path / "reports"))
    assert {(r.dataset, r.ep, r.verdict, r.hard_fail, r.risk) for r in rows.collect()} == {("arm", 0, "EXCLUDE", True, 0.0), ("arm", 1, "REVIEW", False, 12.0), ("arm", 2, "PASS", False, 0.0)}
    sample = export.blind_sample(rows, 3)
    sinks.save_blind_sample(rows, sample, str(tmp_path / "sample"))
    blind = spark.read.option("header", True).csv(f"{tmp_path}/sample/annotator")
    assert tuple(blind.columns) == sinks.ANNOTATOR and [r.sample_id for r in blind.orderBy("sample_id").collect()] == ["S0001", "S0002", "S0003"]
    private = spark.read.json(f"{tmp_path}/sample/private")
    text = "sample_id,human_label,review_seconds\nS0001,remove,12\nS0002,keep,12\nS0003,Good,12\n"
    (tmp_path / "labels.csv").write_text(text)
    labelled = sinks.load_labels(spark, str(tmp_path / "labels.csv"), private)
    got = export.label_metrics(labelled).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.precision, got.recall, got.hard_fail_overlap, got.total_seconds) == (1, 1, 0, 1, 0.5, 1.0, 1, 36.0)
    cells = {(r.label, r.verdict): r.n for r in export.confusion(labelled).collect()}
    assert len(cells) == 9 and cells["REMOVE", "EXCLUDE"] == 1 and cells["REVIEW", "PASS"] == 0
    for what, wrong in {"unknown": text + "S0009,keep,\n", "duplicate": text + "S0001,keep,\n", "missing": text[: text.index("S0003")]}.items():
        (tmp_path / f"{what}.csv").write_text(wrong)
        with pytest.raises(ValueError, match=what):
            sinks.load_labels(spark, str(tmp_path / f"{what}.csv"), private)
    (tmp_path / "no.json").write_text("{}")
    with pytest.raises(Exception, match="no report"):
        sinks.read_report(spark, str(tmp_path / "no.json")).collect()


def test_decisions_and_missing_history(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"0": {"decision": "KEEP", "notes": "n"}, "3": {"decision": "REMOVE"}}, indent=2))
    assert [tuple(r) for r in sinks.read_decisions(spark, str(tmp_path / "d.json")).orderBy("ep").collect()] == [(0, "KEEP", "n"), (3, "REMOVE", None)]
    assert sinks.load_history(spark, None).collect() == sinks.load_history(spark, str(tmp_path / "no")).collect() == []
    (tmp_path / "runs/name=a/run=1").mkdir(parents=True)
    (tmp_path / "runs/name=a/run=1/part-0.parquet").write_text("not parquet at all")
    assert sinks.load_history(spark, str(tmp_path / "runs")).collect() == []


def test_policies():
    assert [export.target_policy(k) for k in ("Frame-Wise", "ACT", " diffusion_policy ")] == ["frame_wise", "temporal", "temporal"]
    with pytest.raises(ValueError, match="unknown policy"):
        export.target_policy("x")
