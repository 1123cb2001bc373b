"""Clean export, blind samples, comparison with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import numbered

STRATEGIES = {"conservative": ("EXCLUDE",), "aggressive": ("EXCLUDE", "REVIEW")}
# Accepted spellings of a label; names of the training policies.
LABELS = {"KEEP": "KEEP", "GOOD": "KEEP", "REVIEW": "REVIEW", "REMOVE": "REMOVE", "BAD": "REMOVE", "DROP": "REMOVE", "EXCLUDE": "REMOVE"}
POLICIES = {"frame_wise": ("frame_wise", "mlp", "bc"), "temporal": ("temporal", "act", "dp", "diffusion", "diffusion_policy", "transformer")}


def target_policy(name: str) -> str:
    """The kind of policy that a name on the command line means."""
    said = name.strip().lower().replace("-", "_")
    for policy, names in POLICIES.items():
        if said in names:
            return policy
    raise ValueError(f"unknown policy {name!r}: use one of {', '.join(POLICIES)}")


def export_decisions(audit: DataFrame, decisions: DataFrame, strategy: str = "conservative", keep_uncertain: bool = True, remove: tuple[str, ...] | None = None, stored: DataFrame | None = None) -> DataFrame:
    """ep, kept, reason: a user's decision (ep, decision) first, else the verdict against the strategy.

    ``remove`` names the verdicts to remove instead of the strategy's. ``stored`` (ep) are episodes of
    the dataset: those that no audit has count as PASS.
    """
    rows = audit.select("ep", "verdict")
    if stored is not None:
        rows = stored.select("ep").distinct().join(rows, "ep", "full_outer")
    rows = rows.join(decisions, "ep", "left")
    automatic = F.coalesce("verdict", F.lit("PASS")).isin(*(STRATEGIES[strategy] if remove is None else remove))
    user = F.upper(F.trim("decision"))
    kept = F.when(user == "REMOVE", False).when(user == "KEEP", True).when(user == "UNCERTAIN", F.lit(keep_uncertain)).otherwise(~automatic)
    reason = F.when(user == "REMOVE", "by_user").when(user == "KEEP", "kept_by_user").when(user == "UNCERTAIN", "uncertain").when(automatic & (F.col("verdict") == "REVIEW"), "by_review").when(automatic, "by_verdict").otherwise("kept")
    return rows.select("ep", kept.alias("kept"), reason.alias("reason"))


def export_report(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("reason").agg(F.count("*").alias("episodes"), F.count_if("kept").alias("kept"))


def kept_frames(frames: DataFrame, decisions: DataFrame) -> DataFrame:
    """Frames of kept episodes."""
    return frames.join(decisions.filter("kept").select("ep"), "ep", "left_semi")


def write_clean(frames: DataFrame, meta: DataFrame, decisions: DataFrame, path: str) -> None:
    """Frames and metadata of kept episodes; the schema stays when nothing is kept."""
    kept_frames(frames, decisions).write.mode("overwrite").parquet(f"{path}/data")
    kept_frames(meta, decisions).write.mode("overwrite").parquet(f"{path}/meta/episodes")


def risk_points() -> Column:
    """min(spikes / 25, 20) + max(0, 20 (0.5 - effective)) + min(acceleration spikes / 10, 10), to six digits."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    moving = F.coalesce("effective_motion_ratio", F.lit(1.0))
    return F.round(F.least(zero("spike_count") / 25, F.lit(20.0)) + F.greatest((0.5 - moving) * 20, F.lit(0.0)) + F.least(zero("acc_spikes") / 10, F.lit(10.0)), 6)


def risk_score(audit: DataFrame) -> DataFrame:
    """ep, verdict, risk."""
    return audit.select("ep", "verdict", risk_points().alias("risk"))


def stable_order(salt: str, name: str, ep: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), F.lit(name), ep.cast("string")), 256)


def stable_sample(rows: DataFrame, n: int, salt: str, name: str) -> DataFrame:
    """``n`` episodes in the order of a salted hash."""
    return rows.select("ep", stable_order(salt, name, F.col("ep")).alias("key")).orderBy("key").limit(n)


def blind_sample(rows: DataFrame, n: int, salt: str | None = None) -> DataFrame:
    """dataset, ep, sample_id: ``n`` episodes of each dataset of ``rows`` (dataset, source, ep, hard_fail, risk).

    The first hard fail, the highest and the lowest risk of the others, then by hash; ids tell nothing.
    Each pick is an aggregate by dataset; only the fill ranks a dataset's episodes by a hash of theirs.
    """
    soft = F.struct("risk", "ep")
    picks = rows.groupBy("dataset").agg(F.min(F.when(F.col("hard_fail"), F.col("ep"))).alias("a"), F.max(F.when(~F.col("hard_fail"), soft)).alias("b"), F.min(F.when(~F.col("hard_fail"), soft)).alias("c"))
    picks = picks.select("dataset", F.posexplode(F.array_compact(F.array_distinct(F.array("a", "b.ep", "c.ep")))).alias("first", "ep"))
    key = F.sha2(F.concat_ws(":", F.lit(salt) if salt is not None else F.col("dataset"), "source", F.col("ep").cast("string")), 256)
    marked = rows.join(picks, ["dataset", "ep"], "left").withColumn("key", key)
    by = Window.partitionBy("dataset").orderBy(F.col("first").asc_nulls_last(), "key")
    chosen = marked.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)
    return numbered(chosen.select("dataset", "ep"), ["dataset", "ep"]).select("dataset", "ep", F.format_string("S%04d", "rank").alias("sample_id"))


def normalise_label(label: Column) -> Column:
    """KEEP, REVIEW or REMOVE; anything else raises."""
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.upper(F.trim(label))), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))


def confusion(rows: DataFrame) -> DataFrame:
    """n of each of the nine pairs (label, verdict), zeros included."""
    cells = [(a, b) for a in ("KEEP", "REVIEW", "REMOVE") for b in ("PASS", "REVIEW", "EXCLUDE")]
    got = rows.agg(*[F.count_if((F.col("label") == a) & (F.col("verdict") == b)).alias(f"{a}:{b}") for a, b in cells])
    found = [F.struct(F.lit(a).alias("label"), F.lit(b).alias("verdict"), F.col(f"{a}:{b}").alias("n")) for a, b in cells]
    return got.select(F.explode(F.array(*found)).alias("r")).select("r.*")


def label_metrics(rows: DataFrame) -> DataFrame:
    """One row: REVIEW and EXCLUDE against labels of REVIEW and REMOVE as TP, FP, FN, TN, and the rates, null without cases.

    ``rows`` may have seconds, the time a reviewer took: then the sum and mean over those who said.
    """
    flagged, bad = F.col("verdict") != "PASS", F.col("label") != "KEEP"
    same = ((F.col("label") == "KEEP") & ~flagged) | ((F.col("label") == "REVIEW") & (F.col("verdict") == "REVIEW")) | ((F.col("label") == "REMOVE") & (F.col("verdict") == "EXCLUDE"))
    counts = {
        "tp": bad & flagged,
        "fp": ~bad & flagged,
        "fn": bad & ~flagged,
        "tn": ~bad & ~flagged,
        "agreed": same,
        "kept": ~bad,
        "kept_in_review": ~bad & (F.col("verdict") == "REVIEW"),
        "removed": F.col("label") == "REMOVE",
        "hard_fail_overlap": (F.col("label") == "REMOVE") & (F.col("verdict") == "EXCLUDE"),
    }
    time = F.col("seconds") if "seconds" in rows.columns else F.lit(None).cast("double")
    got = rows.agg(F.count("*").alias("samples"), *[F.count_if(c).alias(k) for k, c in counts.items()], F.count(time).alias("timed"), F.coalesce(F.round(F.sum(time), 3), F.lit(0.0)).alias("total_seconds"), F.round(F.avg(time), 3).alias("mean_seconds"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    rates = {"agreement": rate("agreed", "samples"), "precision": rate("tp", F.col("tp") + F.col("fp")), "recall": rate("tp", F.col("tp") + F.col("fn")), "kept_to_review_rate": rate("kept_in_review", "kept"), "exclude_overlap": rate("hard_fail_overlap", "removed")}
    return got.withColumns(rates).select("samples", "tp", "fp", "fn", "tn", *rates, "hard_fail_overlap", "timed", "total_seconds", "mean_seconds")
