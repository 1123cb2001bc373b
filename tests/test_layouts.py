"""The cases that a stored dataset can show, for both layouts."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from tidemark.__main__ import audited, loaded, main
from tidemark.operators import metrics
from tidemark.sources import features, files, layouts

VERSIONS = pytest.mark.parametrize("version", ["v2.1", "v3.0"])


def frame(k, i, **over):
    return {"episode_index": k, "timestamp": i / 10, "action": [float(i % 7), 0.0], "observation.state": [float(i), float(k)], "observation.images.top": b"x"} | over


def store(root, version, episodes, meta=None, info=None):
    """``episodes``: rows by index. Files of v3.0 hold two episodes each."""
    (root / "data/chunk-000").mkdir(parents=True)
    (root / "meta").mkdir()
    (root / "meta/info.json").write_text(json.dumps({"codebase_version": version, "fps": 10} if info is None else info))
    meta = meta or [{"episode_index": k, "length": len(v), "data/file_index": 99} for k, v in episodes.items()]
    if version == "v2.1":
        (root / "meta/episodes.jsonl").write_text("\n\n".join(map(json.dumps, meta)))
        for k, rows in episodes.items():
            pq.write_table(pa.Table.from_pylist(rows), root / f"data/chunk-000/episode_{k:06d}.parquet")
    else:
        (root / "meta/episodes/chunk-000").mkdir(parents=True)
        pq.write_table(pa.Table.from_pylist(meta), root / "meta/episodes/chunk-000/file-000.parquet")
        ks = sorted(episodes)
        for n in range(0, len(ks), 2):
            pq.write_table(pa.Table.from_pylist([r for k in ks[n : n + 2] for r in episodes[k]]), root / f"data/chunk-000/file-{n:03d}.parquet")
    return str(root)


@VERSIONS
def test_clean_absent_ragged_and_swapped_episodes(spark, tmp_path, version):
    rows = {k: [frame(k, i) for i in range(20)] for k in range(5)}
    rows[1][4]["action"] = [1.0]
    rows[2][5], rows[2][6] = rows[2][6], rows[2][5]
    rows[3][7]["timestamp"] = rows[3][6]["timestamp"]
    rows[4][3]["observation.state"] = [float("nan"), 0.0]
    meta = [{"episode_index": k, "length": 20} for k in (0, 1, 2, 3, 4, 9)]
    path = store(tmp_path / "set", version, rows, meta)
    got = {r.ep: (r.frames, r.verdict, r.time_status) for r in audited(spark, path).collect()}
    assert all(got[k][::2] == (20, "pass") and got[k][1] != "EXCLUDE" for k in (0, 3)) and 1 not in got
    assert got[2] == (20, "EXCLUDE", "exclude") and got[4] == (20, "EXCLUDE", "pass")
    assert got.get(9) == (None if version == "v2.1" else (0, "EXCLUDE", None))
    assert {r.ep: r.duplicates for r in metrics.timestamp_validity(loaded(spark, path)[0]).collect()}[3] == 1
    info = layouts.load_info(spark, path)
    frames = layouts.read_frames(spark, path, info)
    want = {(1, "ragged")} | ({(9, "missing file")} if version == "v2.1" else set())
    table = layouts.episodes_meta(spark, path, version)
    assert {tuple(r) for r in layouts.skipped_episodes(frames, table.selectExpr("episode_index ep"), version).collect()} == want
    assert tuple(layouts.dataset_info(table, info).first()) == (6, 120)
    assert [r.episode_index for r in layouts.episodes_meta(spark, path, version, 3).collect()] == [0, 1, 2]
    plan = frames._jdf.queryExecution().executedPlan().toString() if hasattr(frames, "_jdf") else ""
    assert "observation.state" in plan and "images" not in plan


@VERSIONS
def test_no_time_several_actions_and_a_scalar_state(spark, tmp_path, version):
    rows = {0: [{"episode_index": 0, "action.joint_pos": [float(i)], "action.gripper": float(i == 3), "observation.state": float("nan") if i == 2 else 1.0, "next.reward": 0.5, "next.done": i == 5} for i in range(6)]}
    path = store(tmp_path / "set", version, rows, info={"codebase_version": version})
    frames = layouts.read_frames(spark, path, layouts.load_info(spark, path))
    got = frames.orderBy("fi").collect()
    assert [r.t for r in got] == [i / 50 for i in range(6)]
    assert [r.action for r in got] == [[float(i)] for i in range(6)]  # joint_pos alone is the action
    assert all(r.state is None and r.reward == 0.5 and r.cells == 2 for r in got) and got[5].done
    row = metrics.measure(frames).first()
    assert (row.velocity_status, row.coverage_status, row.distribution_status) == ("na", "na", "pass")
    assert (row.cells, row.nan_cells) == (18, 1)


@VERSIONS
def test_layout_is_found_without_a_version(spark, tmp_path, version):
    path = store(tmp_path / "set", version, {0: [frame(0, i) for i in range(4)]}, info={"fps": 10})
    assert layouts.layout_version(layouts.load_info(spark, path), spark, path) == version


def test_what_is_no_dataset(spark, tmp_path, capsys):
    assert main(["audit", str(tmp_path / "none")], spark) == 1 and "info.json" in capsys.readouterr().err
    path = store(tmp_path / "set", "v3.0", {0: [frame(0, i) for i in range(4)]})
    (tmp_path / "set/meta/episodes/chunk-000/file-000.parquet").unlink()
    assert main(["audit", path], spark) == 1


def test_profile_does_not_guess():
    assert layouts.profile({}) == {"robot": "unknown", "dof": 0, "fps": None, "tasks": 0}
    assert layouts.profile({"features": {"action.a": {}, "action.b": {}}, "fps": 30, "robot_type": "x"}) == {"robot": "x", "dof": 2, "fps": 30.0, "tasks": 0}


def features_of(names):
    kinds = {"f": (DoubleType(), 1), "g": (FloatType(), 1), "n": (DoubleType(), 0), "i": (LongType(), 1), "s": (StringType(), 0), "d": (DoubleType(), 2)}

    def kind(k):
        base, depth = kinds[k]
        for _ in range(depth):
            base = ArrayType(base)
        return base

    return features.registry(StructType([StructField(n, kind(k)) for n, k in names]))


@pytest.mark.parametrize(
    "columns, want",
    [
        ([("action.gripper", "n"), ("action.joint_pos", "f")], "action.joint_pos"),
        ([("action.position", "n"), ("action.arm", "f")], "action.position"),
        ([("action.joint_pos", "f"), ("action", "f")], "action"),  # an exact action stands alone
        ([("action.grip", "n"), ("action.count", "i"), ("action.arm", "g"), ("action.hand", "f")], "action.arm"),
        ([("action.grip", "n"), ("action.count", "i")], "action.grip"),
        ([("observation.state", "f")], None),
    ],
)
def test_primary_action(columns, want):
    found = features.primary_action(features_of(columns))
    assert (found and found.name) == want


def test_feature_registry():
    got = features_of([("observation.state", "g"), ("observation.images.top", "f"), ("observation.note", "s"), ("action.a.b", "d"), ("index", "i")])
    assert [(f.name, f.key, f.label, f.dtype, f.depth, f.numeric) for f in got] == [("observation.state", "observation.state", "state", "float32", 1, True), ("observation.note", "observation.note", "note", "string", 0, False), ("action.a.b", "action.a.b", "a.b", "float64", 2, True)]


@VERSIONS
def test_features_are_counted_one_by_one(spark, tmp_path, version):
    rows = {k: [frame(k, i) | {"observation.force": None if i == 3 and k == 1 else float("nan") if i == 2 else 1.0, "observation.grid": [[1.0, float(i)], [2.0, float("inf") if i == 0 else 0.0]], "observation.note": "x", "action.extra": 5} for i in range(6)] for k in range(2)}
    path = store(tmp_path / "set", version, rows)
    frames = layouts.read_frames(spark, path, layouts.load_info(spark, path))
    got = {(r.ep, r.feature): (r.dtype, r["shape"], r.n, r.cells, r["nan"], r.inf, r.numeric, r.dropped, r.mismatched) for r in features.feature_counts(frames).collect()}
    assert {k for _, k in got} == {"action.action", "observation.state", "observation.force", "observation.grid", "observation.note"}  # action.extra stands behind action
    assert got[0, "observation.force"] == ("float64", [], 6, 6, 1, 0, True, False, False)
    assert got[1, "observation.force"] == ("float64", [], 5, 5, 1, 0, True, True, True)
    assert got[0, "observation.grid"] == ("float64", [2, 2], 6, 24, 0, 1, True, False, False)
    assert got[1, "observation.note"] == ("string", [], 6, 0, 0, 0, False, False, False)
    lists = {r.ep: r for r in features.feature_lists(frames).collect()}
    assert lists[1].dropout_features == lists[1].length_mismatches == ["observation.force"] and lists[0].dropout_features == []
    assert lists[0].by_feature_frame_count == {"action.action": 6, "observation.state": 6, "observation.force": 6, "observation.grid": 6}
    assert lists[1].by_feature["observation.force"].asDict() == {"nan_count": 1, "inf_count": 0, "total_cells": 5}
    wide = {r.ep: (r.dropout, r.mismatched, r.cells, r.nan_cells, r.inf_cells) for r in metrics.measure(frames).collect()}
    assert wide == {0: (0, 0, 54, 1, 1), 1: (1, 1, 53, 1, 1)}


@VERSIONS
def test_broken_and_differing_files(spark, tmp_path, version):
    """A truncated file, one with broken pages, one of other types, one with a column more and one without rows: nothing ends the audit."""
    rows = {k: [frame(k, i) for i in range(20)] for k in range(12)}
    meta = [{"episode_index": k, "length": 20, "data/chunk_index": 0, "data/file_index": k // 2 * 2} for k in rows]
    path = store(tmp_path / "set", version, rows, meta)
    name = lambda k: tmp_path / "set/data/chunk-000" / (f"episode_{k:06d}.parquet" if version == "v2.1" else f"file-{k:03d}.parquet")
    own = lambda k: [k] if version == "v2.1" else [k, k + 1]
    part = lambda k, **over: [r | over for e in own(k) for r in rows[e]]
    whole = name(2).read_bytes()
    name(2).write_bytes(whole[: len(whole) // 2])
    other = pa.schema([("episode_index", pa.int32()), ("timestamp", pa.float32()), ("action", pa.list_(pa.float32())), ("observation.state", pa.list_(pa.int64()))])
    pq.write_table(pa.Table.from_pylist([{k: v for k, v in r.items() if k != "observation.images.top"} | {"observation.state": [int(x) for x in r["observation.state"]]} for r in part(4)], schema=other), name(4))
    pq.write_table(pa.Table.from_pylist(part(6, **{"observation.force": float("nan")})), name(6))
    pq.write_table(pa.Table.from_pylist(part(8)).slice(0, 0), name(8))
    pq.write_table(pa.Table.from_pylist([r | {"observation.state": [float(i), float(i * j)]} for j, r in enumerate(part(10)) for i in [j]]), name(10), compression="zstd", use_dictionary=False)
    raw = bytearray(name(10).read_bytes())
    at = pq.ParquetFile(name(10)).metadata.row_group(0).column(3)  # the second value of action and what follows
    for i in range(at.data_page_offset, at.data_page_offset + at.total_compressed_size):
        raw[i] ^= 0x5A
    name(10).write_bytes(raw)

    info, found = layouts.load_info(spark, path), files.schema_groups(spark, layouts.data_glob(path, version))
    assert len(found) == 2 and any("observation.force" in schema.names for schema, _ in found)
    broken = files.broken_files(spark, layouts.data_glob(path, version), layouts.scan_frames(spark, path, info))
    assert {(r.file.rsplit("/", 1)[1], r.reason) for r in broken.collect()} == {(name(2).name, "unreadable"), (name(10).name, "incomplete")}
    frames = layouts.read_frames(spark, path, info, broken)
    listed = layouts.episodes_meta(spark, path, version).withColumnRenamed("episode_index", "ep")
    skipped = {tuple(r) for r in layouts.skipped_episodes(frames, listed, version, broken).collect()}
    assert skipped >= {(k, "unreadable file") for k in own(2)} | {(k, "incomplete file") for k in own(10)}
    audit = {r.ep: r for r in audited(spark, path).collect()}
    assert not set(audit) & {*own(2), *own(10)}
    assert all(audit[k].frames == 20 and audit[k].jump_status == "pass" and audit[k].velocity_status == "pass" for k in (0, 1, *own(4)))
    assert all(audit[k].nan_cells == 20 and audit[k].verdict == "EXCLUDE" for k in own(6)) and audit[0].nan_cells == 0
    assert (8 in audit) == (version == "v3.0") and (version == "v2.1" or audit[8].frames == 0)  # listed, but no frame


def test_totals_of_a_dataset_that_says_none(spark, tmp_path):
    path = store(tmp_path / "set", "v3.0", {k: [frame(k, i) for i in range(5 + k)] for k in range(3)}, [{"episode_index": k} for k in (1, 0, 2)])
    info, meta = layouts.load_info(spark, path), layouts.episodes_meta(spark, path, "v3.0")
    assert tuple(layouts.dataset_info(meta, info, layouts.read_frames(spark, path, info)).first()) == (3, 18)  # the first listed has 6
    assert tuple(layouts.dataset_info(meta, {"total_episodes": 7, "total_frames": 70}).first()) == (7, 70)
    assert tuple(layouts.dataset_info(meta, {"total_episodes": 7}).first()) == (3, None)


def test_a_later_file_of_an_episode_counts(spark, tmp_path):
    path = store(tmp_path / "set", "v2.1", {0: [frame(0, i) for i in range(4)]})
    (tmp_path / "set/data/chunk-001").mkdir()
    pq.write_table(pa.Table.from_pylist([frame(0, i) for i in range(7)] + [frame(5, 0)]), tmp_path / "set/data/chunk-001/episode_000000.parquet")
    assert layouts.read_frames(spark, path, layouts.load_info(spark, path)).count() == 7
