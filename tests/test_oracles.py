import math
import os

import pytest

from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"
NAMES = ["episode_report", "episode_csv", "episode_ranks", "episode_overview", "episode_export", "issue_counts", "top_issues", "listed_episodes", "legacy_aggregates", "idle_threshold", "temporal_sufficiency", "sensor_sync_pairs", "coverage", "joint_spikes", "velocity_stats", "timestamp_validity", "missing_frames", "invalid_values", "blind_sample", "percentile_rank", "pattern_type", "export_report", "top_observations", "dt_stats", "schema_consistency", "episode_integrity", "removal_list", "audit_trend", "history_merged", "score_summary", "dataset_health_ui", "hero_metrics", "episode_diagnosis", "feature_keys"]


def tidy(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    got = registry.queries()[name](spark, DIR).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert tidy(got[cols].astype(object).itertuples(index=False)) == tidy(want[cols].astype(object).itertuples(index=False))
