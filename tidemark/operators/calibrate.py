"""Reference profiles and scores: robust z against calibrated medians, PCA, percentile ranks."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles, median_deviations
from tidemark.functions.seq import percentiles

PORTABLE = ("duration", "spike_count", "effective_motion_ratio")
PLATFORM = ("velocity_p95", "path_length", "velocity_max")
# Metrics for which a low value is the worse one.
LOWER_IS_WORSE = ("effective_motion_ratio",)
# The audit metric that a portable figure belongs to.
METRIC_OF = {"duration": "distribution", "spike_count": "action_discontinuity", "effective_motion_ratio": "idle_ratio"}
MIN_EPISODES = 30


def score_metrics(audit: DataFrame) -> DataFrame:
    """ep and the six score metrics; what cannot be computed is 0."""
    return audit.select("ep", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (*PORTABLE, *PLATFORM)])


def reference_profile(scores: DataFrame) -> DataFrame:
    """metric, n, median, mad and percentiles. No metric column or no episode: no rows.

    Exact percentiles: the closing task holds the distinct figures of all episodes, a number for each.
    """
    names = [c for c in scores.columns if c != "ep"]
    long = scores.unpivot("ep", names, "metric", "x")
    mid = long.groupBy("metric").agg(F.median("x").alias("median"))  # a row a metric
    got = long.join(F.broadcast(mid), "metric").groupBy("metric").agg(F.count("*").alias("n"), F.first("median").alias("median"), F.median(F.abs(F.col("x") - F.col("median"))).alias("mad"), percentiles("x", 0.05, 0.25, 0.75, 0.95).alias("p"))
    return got.select("metric", "n", "median", "mad", *[F.col("p")[i].alias(k) for i, k in enumerate(("p05", "p25", "p75", "p95"))])


def refined_profile(scores: DataFrame, **how: int) -> DataFrame:
    """``reference_profile`` for more episodes than one task should hold: by refinement (``functions.quantiles``), ``scores`` read several times."""
    names = tuple(c for c in scores.columns if c != "ep")
    anchors = exact_quantiles(scores, names, (0.5, 0.05, 0.25, 0.75, 0.95), **how)
    mads = median_deviations(scores, {c: ps[0] for c, (_, ps) in anchors.items()}, **how)
    rows = [(c, n, mid, mads[c], *ps) for c, (n, (mid, *ps)) in anchors.items() if n]
    return scores.sparkSession.createDataFrame(rows, "metric string, n long, median double, mad double, p05 double, p25 double, p75 double, p95 double")


def calibrated(scores: DataFrame, min_episodes: int = MIN_EPISODES) -> DataFrame:
    """``reference_profile``, but an error for fewer than ``min_episodes`` episodes: too few to be a reference."""
    n = scores.count()
    if n < min_episodes:
        raise ValueError(f"{n} episodes are too few for a reference; it takes {min_episodes}")
    return reference_profile(scores)


def bad_z(scores: DataFrame, profile: DataFrame) -> DataFrame:
    """ep, metric, z with the sign turned where low is worse; 0 where mad is 0."""
    long = scores.unpivot("ep", [c for c in scores.columns if c != "ep"], "metric", "x").join(F.broadcast(profile), "metric")
    z = F.when(F.col("mad") == 0, 0.0).otherwise(F.try_divide(F.lit(0.6745) * (F.col("x") - F.col("median")), F.col("mad")))
    return long.select("ep", "metric", F.when(F.col("metric").isin(*LOWER_IS_WORSE), -z).otherwise(z).alias("z"), percentile_rank(F.col("x")).alias("rank"))


def percentile_rank(x: Column) -> Column:
    """Linear between the profile's five anchors, clamped to [0.05, 0.95]."""
    anchors = [("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)]
    out = F.lit(0.95)
    for (lo, a), (hi, b) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        inside = F.lit(a) + F.coalesce(F.try_divide(x - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0)) * (b - a)
        out = F.when(x < F.col(hi), inside).otherwise(out)
    return F.when(F.col("mad") == 0, 0.5).when(x <= F.col("p05"), 0.05).otherwise(F.least(F.greatest(out, F.lit(0.05)), F.lit(0.95)))


def rms_scores(z: DataFrame) -> DataFrame:
    """Root mean square of z over the portable, the platform and all metrics."""
    part = lambda names: F.sqrt(F.avg(F.when(F.col("metric").isin(*names), F.col("z") * F.col("z"))))
    return z.groupBy("ep").agg(part(PORTABLE).alias("portable_score"), part(PLATFORM).alias("platform_score"), F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("combined_rms"))


def approx_percentile(z: DataFrame) -> DataFrame:
    """ep, percentile: how far out an episode lies, as the largest max(rank, 1 - rank) of its portable metrics."""
    far = F.max(F.when(F.col("metric").isin(*PORTABLE), F.greatest("rank", 1 - F.col("rank"))))
    return z.groupBy("ep").agg(F.coalesce(far, F.lit(0.5)).alias("percentile"))


def inject(results: DataFrame, z: DataFrame) -> DataFrame:
    """The long metric table with z and percentile of the three metrics that a portable figure belongs to.

    z is the plain robust z (not turned where low is worse); all other metrics have nulls.
    """
    name = F.create_map(*[F.lit(x) for pair in METRIC_OF.items() for x in pair])
    turned = F.when(F.col("metric").isin(*LOWER_IS_WORSE), -F.col("z")).otherwise(F.col("z"))
    own = z.filter(F.col("metric").isin(*METRIC_OF)).select("ep", F.element_at(name, F.col("metric")).alias("metric"), turned.alias("z"), F.col("rank").alias("percentile"))
    return results.join(own, ["ep", "metric"], "left")


def pca_covariance(z: DataFrame, names: tuple[str, ...] | None = (*PORTABLE, *PLATFORM)) -> DataFrame:
    """one, two, cov (population) of each pair of ``names``, from one aggregate over the episodes; None: those that ``z`` has."""
    wide_names = {r.metric for r in z.select("metric").distinct().collect()} if names is None else set(names)
    names = sorted(wide_names)
    wide = z.groupBy("ep").agg(*[F.max(F.when(F.col("metric") == k, F.col("z"))).alias(k) for k in names])
    pairs = [(a, b) for a in names for b in names]
    got = wide.agg(*[F.covar_pop(a, b).alias(f"{a}:{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), F.col(f"{a}:{b}").alias("cov")) for a, b in pairs]
    return got.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("cov is not null")


def components(covariance: list, k: int = 2) -> tuple[list[dict[str, float]], list[float]]:
    """The leading components of a covariance given as (one, two, cov), largest loading positive, and their shares of all variance."""
    names = sorted({r["one"] for r in covariance})
    table = np.zeros((len(names), len(names)))
    for r in covariance:
        table[names.index(r["one"]), names.index(r["two"])] = r["cov"]
    values, vectors = np.linalg.eigh(table) if names else (np.zeros(0), np.zeros((0, 0)))
    total, loadings, shares = np.maximum(values, 0).sum(), [], []
    for i in np.argsort(-values)[:k]:
        if values[i] <= 1e-12 * max(total, 1e-300):
            break
        v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
        loadings.append(dict(zip(names, map(float, v), strict=True)))
        shares.append(float(values[i] / total))
    return loadings, shares


def pca_loadings(z: DataFrame, k: int = 2) -> tuple[list[dict[str, float]], list[float]]:
    """``components`` of the metrics' covariance (at most 6 by 6, so it comes to the driver)."""
    return components(pca_covariance(z, None).collect(), k)


def _composite(names: tuple[str, ...], loadings: list[dict[str, float]]) -> Column:
    """A score over the metrics ``names``, by episode: from the components if theirs are all among them, else their root mean square."""
    if loadings and loadings[0] and set(loadings[0]) <= set(names):
        parts = []
        for loading in loadings:
            weights = F.create_map(*[F.lit(x) for pair in loading.items() for x in pair])
            parts.append(F.coalesce(F.sum(F.col("z") * F.coalesce(F.try_element_at(weights, F.col("metric")), F.lit(0.0))), F.lit(0.0)))
        return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    return F.sqrt(F.avg(F.when(F.col("metric").isin(*names), F.col("z") * F.col("z"))))


def deviation_scores(z: DataFrame, loadings: list[dict[str, float]] | None = None, min_episodes: int = MIN_EPISODES, score_type: str | None = None) -> DataFrame:
    """portable_score, platform_score, combined_score and the method of the last; with ``score_type`` that score as deviation_score, and its method.

    A score takes components only if their metrics are all among its own. Without platform metrics in
    the reference the platform score is 0 and the combined score is the portable one. Without
    ``loadings`` they come from ``z`` itself if it has enough episodes.
    """
    if score_type not in (None, "portable", "platform", "combined"):
        raise ValueError(f"no such score: {score_type}")
    if loadings is None:
        enough = z.select("ep").distinct().count() >= min_episodes
        loadings = pca_loadings(z)[0] if enough else []
    sets = {"portable": PORTABLE, "platform": PLATFORM, "combined": (*PORTABLE, *PLATFORM)}
    got = z.groupBy("ep").agg(*[_composite(names, loadings).alias(f"{k}_own") for k, names in sets.items()], F.bool_or(F.col("metric").isin(*PLATFORM)).alias("wide"))
    got = got.withColumns({"portable_score": F.coalesce("portable_own", F.lit(0.0)), "platform_score": F.when(F.col("wide"), F.col("platform_own")).otherwise(0.0)})
    got = got.withColumn("combined_score", F.when(F.col("wide"), F.col("combined_own")).otherwise(F.col("portable_score")))
    fits = lambda k: "pca" if loadings and loadings[0] and set(loadings[0]) <= set(sets[k]) else "rms"
    method = F.lit(fits(score_type)) if score_type in ("portable", "platform") else F.when(F.col("wide"), fits("combined")).otherwise(fits("portable"))
    chosen = [F.col(f"{score_type}_score").alias("deviation_score")] if score_type else []
    return got.select("ep", "portable_score", "platform_score", "combined_score", *chosen, method.alias("method"))


def calibrate(audit: DataFrame, min_episodes: int = MIN_EPISODES, include_platform: bool = False) -> tuple[DataFrame, list[dict[str, float]], list[float]]:
    """profile, components and their shares of variance over the portable metrics, or with ``include_platform`` over all six.

    The portable ones alone compare across platforms and are the default. Fewer than ``min_episodes``
    episodes: the profile without components.
    """
    names = (*PORTABLE, *PLATFORM) if include_platform else PORTABLE
    scores = score_metrics(audit).select("ep", *names)
    profile = reference_profile(scores)
    few = scores.limit(min_episodes).count() < min_episodes
    return (profile, [], []) if few else (profile, *pca_loadings(bad_z(scores, profile)))


def score_against(audit: DataFrame, profile: DataFrame, loadings: list[dict[str, float]], score_type: str | None = None) -> DataFrame:
    """The three scores and the percentile of every audited episode against a stored reference."""
    z = bad_z(score_metrics(audit), profile)
    return deviation_scores(z, loadings, score_type=score_type).join(approx_percentile(z), "ep")


def save_profile(profile: DataFrame, loadings: list[dict[str, float]], shares: list[float], path: str) -> None:
    """One JSON row, written by Spark: the metrics' figures, the components and their shares of variance."""
    spark = profile.sparkSession
    record = {"metrics": [r.asDict() for r in profile.collect()], "components": loadings, "explained": shares}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_profile(spark, path: str) -> tuple[DataFrame, list[dict[str, float]], list[float]]:
    """profile, loadings, explained shares as ``save_profile`` wrote them."""
    got = json.loads("".join(r[0] for r in spark.read.text(path).collect()))  # one document of six metrics
    return spark.createDataFrame(got["metrics"], "metric string, n long, median double, mad double, p05 double, p25 double, p75 double, p95 double"), got["components"], got.get("explained", [])


def score_summary(scores: DataFrame) -> DataFrame:
    """median, p95, mean and max of each score over the episodes that have it."""
    names = ("portable_score", "platform_score", "combined_rms")
    got = scores.agg(*[F.struct(F.lit(c).alias("score"), F.median(c).alias("median"), F.percentile(c, F.lit(0.95)).alias("p95"), F.avg(c).alias("mean"), F.max(c).alias("largest")).alias(c) for c in names])
    return got.select(F.explode(F.array(*names)).alias("r")).select("r.*")
