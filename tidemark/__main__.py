"""``python -m tidemark``: audit a dataset, calibrate a reference, write a cleaned copy.

Exit codes: 0, 1 for a path that is no dataset, 2 for an audit that excludes an episode.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calibrate, export, metrics, report, text, verdict
from tidemark.session import build_session
from tidemark.sources import files, layouts, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tidemark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    audit = commands.add_parser("audit", help="print the summary; with --report write the reports as JSON")
    audit.add_argument("path")
    audit.add_argument("--report")
    audit.add_argument("--history", help="folder of the run history")
    audit.add_argument("--run", default="0")
    audit.add_argument("--part", help="the dataset is this part of the run: HISTORY gets its state, which merges with those of other parts")
    audit.add_argument("--name", help="the dataset's name in the history; by default the last folder of its path")
    audit.add_argument("--reference", help="a stored reference; scores go to REPORT/scores")
    audit.add_argument("--max-episodes", type=int, help="only the first episodes of the metadata")
    fit = commands.add_parser("calibrate", help="store the medians and spreads of a dataset as a reference")
    fit.add_argument("path")
    fit.add_argument("out")
    fit.add_argument("--min-episodes", type=int, default=calibrate.MIN_EPISODES)
    fit.add_argument("--include-platform", action="store_true", help="also the metrics that only compare within one platform")
    clean = commands.add_parser("clean", help="copy the episodes that stay")
    clean.add_argument("path")
    clean.add_argument("out")
    clean.add_argument("--strategy", choices=sorted(export.STRATEGIES), default="conservative")
    clean.add_argument("--remove", nargs="+", choices=verdict.VERDICTS, help="verdicts to remove instead of the strategy's")
    clean.add_argument("--decisions", help="JSON document of a user's decisions")
    advise = commands.add_parser("recommend", help="print how idle the dataset is, as pruning advice takes it")
    advise.add_argument("path")
    advise.add_argument("--policy", default="frame-wise")
    commands.add_parser("example", help="list the datasets under ./examples and show how the commands are used").add_argument("path", nargs="?", default="examples")
    return top


def examples(path: str) -> str:
    """The datasets (folders with meta/info.json) of a folder on this machine, and a command for each use."""
    found = sorted(str(p.parent.parent) for p in Path(path).glob("*/meta/info.json"))
    one = found[0] if found else "PATH"
    lines = [f"Datasets under {path}:", *[f"  {p}" for p in found]] if found else [f"No datasets under {path}."]
    uses = (f"audit {one}", f"audit {one} --report OUT", f"calibrate {one} REFERENCE", f"audit {one} --report OUT --reference REFERENCE", f"clean {one} OUT")
    return "\n".join([*lines, "", *[f"  python -m tidemark {u}" for u in uses]])


def loaded(spark: SparkSession, path: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """frames and metadata (ep) of a stored dataset: its listed episodes, without the skipped ones (``layouts.skipped_episodes``)."""
    info = layouts.load_info(spark, path)
    version = layouts.layout_version(info, spark, path)
    listed = layouts.episodes_meta(spark, path, version, most)
    pointers = [f"`{c}`" for c in ("data/chunk_index", "data/file_index") if c in listed.columns]
    meta = listed.select(F.col("episode_index").cast("long").alias("ep"), *pointers).dropDuplicates(["ep"])
    broken = files.broken_files(spark, layouts.data_glob(path, version), layouts.scan_frames(spark, path, info))
    frames = layouts.read_frames(spark, path, info, broken).join(meta, "ep", "left_semi")
    skipped = layouts.skipped_episodes(frames, meta, version, broken).select("ep").distinct()
    return frames.join(skipped, "ep", "left_anti"), meta.select("ep").join(skipped, "ep", "left_anti")


def audited(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The audit of a stored dataset; a listed episode without frames is EXCLUDE."""
    frames, meta = loaded(spark, path, most)
    return verdict.judged(verdict.with_empty(verdict.scalars(frames), meta))


def _audit(args: argparse.Namespace, spark: SparkSession, audit: DataFrame) -> int:
    print(text.summary(audit))
    if args.report:
        sinks.save_report(audit, verdict.metric_results(audit), args.report, args.path, layouts.load_info(spark, args.path))
        if args.reference:
            profile, loadings, _ = calibrate.load_profile(spark, args.reference)
            calibrate.score_against(audit, profile, loadings).write.mode("overwrite").json(f"{args.report}/scores")
    if args.history:
        name = args.name or args.path.rstrip("/").rsplit("/", 1)[-1]
        if args.part is None:
            sinks.save_snapshot(audit, name, args.run, args.history)
        else:
            sinks.save_state(audit, name, args.run, args.part, args.history)
    return 0 if audit.filter("verdict = 'EXCLUDE'").isEmpty() else 2


def _calibrate(args: argparse.Namespace, spark: SparkSession, audit: DataFrame) -> int:
    calibrate.calibrated(calibrate.score_metrics(audit), args.min_episodes)  # too few episodes are an error here
    calibrate.save_profile(*calibrate.calibrate(audit, args.min_episodes, args.include_platform), args.out)
    return 0


def _clean(args: argparse.Namespace, spark: SparkSession, audit: DataFrame) -> int:
    decisions = sinks.read_decisions(spark, args.decisions).drop("notes") if args.decisions else spark.createDataFrame([], "ep long, decision string")
    sinks.clean_dataset(spark, args.path, export.export_decisions(audit, decisions, args.strategy, remove=tuple(args.remove) if args.remove else None), args.out)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "example":
        print(examples(args.path))
        return 0
    spark = spark or build_session("tidemark")
    try:
        if args.command == "recommend":
            frames, _ = loaded(spark, args.path)
            rows = report.quantile_row(metrics.temporal_sufficiency(frames), "idle_total", "idle_prefix", "transitions", "run_p50", "run_p90", "run_max", *[f"valid_{n}" for n in metrics.WINDOWS])
            print(json.dumps({"policy": export.target_policy(args.policy), "metrics": [r.asDict() for r in rows.collect()]}, indent=1))
            return 0
        audit = audited(spark, args.path, getattr(args, "max_episodes", None)).persist()
    except (FileNotFoundError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    try:
        return {"audit": _audit, "calibrate": _calibrate, "clean": _clean}[args.command](args, spark, audit)
    finally:
        audit.unpersist()


if __name__ == "__main__":
    sys.exit(main())
