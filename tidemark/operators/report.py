"""Dataset-level answers over the audited episodes (one wide row per episode, see ``verdict.judged``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import numbered
from tidemark.functions.seq import percentiles
from tidemark.operators.verdict import CRITICAL, METRICS, VERDICTS, effective_points, spike_points

# Issue codes by metric; weights and grades of the health index; names of patterns.
ISSUE_CODES = {"missing_dropout": "INT-01", "invalid_values": "INT-02", "schema_consistency": "INT-03", "timestamp_validity": "INT-04", "joint_limit": "INT-05", "sensor_synchronization": "TMP-03", "sampling_jitter": "TMP-03", "action_discontinuity": "MOT-01", "velocity_acceleration": "MOT-02", "idle_ratio": "MOT-03", "distribution": "DIS-01", "coverage": "DIS-03"}
HEALTH_WEIGHTS = {"integrity": 0.4, "temporal": 0.2, "motion": 0.2, "consistency": 0.2}
GRADES = ((90, "Excellent"), (75, "Good"), (60, "Fair"))
READY = ((0.05, 0.15, "Ready"), (0.1, 0.3, "Conditionally Ready"))
BEHAVIOUR = ("action_discontinuity", "idle_ratio")
SIGNIFICANCE = ("high", "medium", "low", "info")
HISTORY_PATTERNS = ("Stuck", "Frozen", "Jittery", "Inefficient", "Unusual")
PATTERNS = ("STUCK_LIKE", "FROZEN_LIKE", "JITTERY_LIKE", "INEFFICIENT", "UNUSUAL")


def quantile_row(audit: DataFrame, *columns: str, shares: tuple[float, ...] = (0.05, 0.5, 0.95), totals: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """metric, available, p05, p50, p95 of each column over the episodes that have it; with ``totals`` also total and touched of some.

    Exact: the closing task holds the distinct figures of all episodes, a number for each. For more
    episodes than that allows see ``functions.quantiles``.
    """
    names = [f"p{round(100 * s):02d}" for s in shares]
    more = lambda c: [(totals or {}).get(c, (F.lit(None), F.lit(None)))[i].cast("long").alias(k) for i, k in enumerate(("total", "touched"))] if totals else []
    got = audit.agg(*[F.struct(F.count(c).alias("n"), percentiles(c, *shares).alias("p"), *more(c)).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("metric"), F.col(c)["n"].alias("available"), *[F.get(F.col(c)["p"], F.lit(i)).alias(n) for i, n in enumerate(names)], *[F.col(c)[k].alias(k) for k in (("total", "touched") if totals else ())]) for c in columns]
    return got.select(F.inline(F.array(*rows)))


TEMPORAL_MOTION = ("dt_p50", "worst_p95", "velocity_p95", "spike_count", "idle_total", "idle_prefix_ratio", "run_p50", "run_p90", "run_max", "transitions", "valid_5", "valid_10", "valid_20")
UTILITY = ("idle_ratio", "effective_motion_ratio", "occupancy_rate", "duration", "path_length")


def temporal_motion_summary(audit: DataFrame) -> DataFrame:
    """Percentiles of time steps, sensor offsets, velocity, spikes and idle structure; total is set for spikes, touched counts episodes above 0."""
    rows = audit.withColumn("idle_prefix_ratio", F.try_divide("idle_prefix", "frames"))
    extra = {"spike_count": (F.coalesce(F.sum("spike_count"), F.lit(0).cast("long")), F.count_if(F.col("spike_count") > 0))}
    return quantile_row(rows, *TEMPORAL_MOTION, shares=(0.05, 0.5, 0.95, 0.99), totals=extra)


def utility_summary(audit: DataFrame) -> DataFrame:
    """Percentiles of idle and effective shares, occupied cells, duration and path length."""
    return quantile_row(audit, *UTILITY)


def integrity_summary(results: DataFrame) -> DataFrame:
    """available, passed, failed, na and pass_rate of each metric."""
    on = F.col("availability") == "available"
    got = results.groupBy("metric").agg(F.count_if(on).alias("available"), F.count_if(on & F.col("passed")).alias("passed"), F.count_if(on & ~F.col("passed")).alias("failed"), F.count_if(~on).alias("na"))
    return got.withColumn("pass_rate", F.coalesce(F.try_divide("passed", "available"), F.lit(0.0)))


def score_distribution(results: DataFrame) -> DataFrame:
    """Median, range and percentiles of each metric's score, unavailable ones at 0 included."""
    got = results.groupBy("metric").agg(F.min("score").alias("lo"), percentiles("score", 0.05, 0.5, 0.95).alias("p"), F.max("score").alias("hi"))
    return got.select("metric", "lo", F.col("p")[0].alias("p05"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95"), "hi")


def deviation_stats(results: DataFrame) -> DataFrame:
    """Mean and median over episodes of 100 (1 - mean available score)."""
    per = results.filter("availability = 'available'").groupBy("ep").agg((100 * (1 - F.avg("score"))).alias("d"))
    return per.agg(F.avg("d").alias("mean_deviation"), F.median("d").alias("median_deviation"))


def failing_metrics(results: DataFrame) -> DataFrame:
    return results.filter("availability = 'available' and not passed").groupBy("metric").agg(F.count("*").alias("episodes"))


def issue_codes(results: DataFrame) -> DataFrame:
    """ep, code of each metric that did not pass; an unknown metric is UNK-00."""
    code = F.create_map(*[F.lit(x) for pair in ISSUE_CODES.items() for x in pair])
    return results.filter("availability = 'available' and not passed").select("ep", "metric", F.coalesce(F.try_element_at(code, F.col("metric")), F.lit("UNK-00")).alias("code"))


def evidence() -> Column:
    """HARD_FAIL before RISK_SIGNAL before UNVERIFIABLE before NO_FINDING, from the results of an episode's row."""
    some = lambda test: F.exists("results", test)
    hard = some(lambda r: (r["availability"] == "available") & ~r["passed"] & r["metric"].isin(*CRITICAL))
    risk = some(lambda r: (r["availability"] == "available") & (r["status"] == "review") & r["metric"].isin(*BEHAVIOUR))
    off = some(lambda r: r["availability"] == "not_available")
    return F.when(hard, "HARD_FAIL").when(risk, "RISK_SIGNAL").when(off, "UNVERIFIABLE").otherwise("NO_FINDING")


def evidence_level(results: DataFrame) -> DataFrame:
    """HARD_FAIL before RISK_SIGNAL before UNVERIFIABLE before NO_FINDING, by episode.

    Hard: an integrity metric failed. Risk: a behavioural finding. The rest depends on metrics that are not available.
    """
    on = F.col("availability") == "available"
    hard, risk = on & ~F.col("passed") & F.col("metric").isin(*CRITICAL), on & (F.col("status") == "review") & F.col("metric").isin(*BEHAVIOUR)
    got = results.groupBy("ep").agg(F.bool_or(hard).alias("h"), F.bool_or(risk).alias("r"), F.bool_or(F.col("availability") == "not_available").alias("u"))
    return got.select("ep", F.when(F.col("h"), "HARD_FAIL").when(F.col("r"), "RISK_SIGNAL").when(F.col("u"), "UNVERIFIABLE").otherwise("NO_FINDING").alias("evidence"))


def evidence_summary(results: DataFrame) -> DataFrame:
    """evidence, metric, episodes: how many failed hard or show a risk (metric null), and for how many each metric is not available."""
    on = F.col("availability") == "available"
    hard, risk = on & ~F.col("passed") & F.col("metric").isin(*CRITICAL), on & (F.col("status") == "review") & F.col("metric").isin(*BEHAVIOUR)
    per = results.groupBy("ep").agg(F.bool_or(hard).alias("h"), F.bool_or(risk).alias("r")).agg(F.count_if("h").alias("h"), F.count_if("r").alias("r"))
    row = lambda name, c: F.struct(F.lit(name).alias("evidence"), F.lit(None).cast("string").alias("metric"), F.col(c).alias("episodes"))
    both = per.select(F.explode(F.array(row("HARD_FAIL", "h"), row("RISK_SIGNAL", "r"))).alias("x")).select("x.*")
    off = results.filter("availability = 'not_available'").groupBy("metric").agg(F.count("*").alias("episodes"))
    return both.unionByName(off.select(F.lit("UNVERIFIABLE").alias("evidence"), "metric", "episodes"))


def _figure(column: str, metric: str | None = None) -> Column:
    """A figure that counts as 0 where it, or the metric that it belongs to, is missing."""
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    return value if metric is None else F.when(_state(metric, "availability") == "available", value).otherwise(0.0)


def reasons() -> dict[str, Column]:
    """duration, spikes, low_motion, velocity, path of an audited episode; what is not available is 0."""
    low = F.when(_state("idle_ratio", "availability") == "available", 1 - F.coalesce("effective_motion_ratio", F.lit(1.0))).otherwise(0.0)
    return {"duration": _figure("duration", "distribution"), "spikes": _figure("spike_count", "action_discontinuity"), "low_motion": low, "velocity": _figure("velocity_p95", "velocity_acceleration"), "path": _figure("path_length", "distribution")}


def patterns() -> Column:
    """score, order, pattern of every behaviour pattern that applies to an audited episode, strongest first; none: empty."""
    r = reasons()
    dur, low, spikes, path = r["duration"], r["low_motion"], r["spikes"], r["path"]
    one = lambda i, when, score: F.struct(F.when(when, score.cast("double")).alias("score"), F.lit(-i).alias("order"), F.lit(PATTERNS[i]).alias("pattern"))
    rows = F.array(
        one(0, (dur > 0) & (low > 0.5) & (spikes < 5), dur * low),
        one(1, (low > 0.8) & (spikes < 2), low * 10),
        one(2, spikes > 10, spikes),
        one(3, (dur > 0) & (path > 0) & (low < 0.3), dur + path / 100),
    )
    found = F.reverse(F.array_sort(F.filter(rows, lambda x: x["score"].isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.array(one(4, dur > 0, dur * 0.1)), lambda x: x["score"].isNotNull()))


def pattern_types(audit: DataFrame) -> DataFrame:
    """ep, pattern, score, place of every behaviour pattern that applies, strongest first."""
    return audit.select("ep", F.posexplode(patterns()).alias("place", "r")).select("ep", F.col("r.pattern").alias("pattern"), F.col("r.score").alias("score"), F.col("place").cast("long").alias("place"))


def pattern_distribution(audit: DataFrame) -> DataFrame:
    """Episodes by primary pattern, all five with zeros."""
    counts = pattern_types(audit).filter("place = 0").agg(*[F.count_if(F.col("pattern") == p).alias(p) for p in PATTERNS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(p).alias("episodes")) for p in PATTERNS])).alias("r")).select("r.*")


def history_pattern() -> Column:
    effective, shaky = F.coalesce("effective_motion_ratio", F.lit(1.0)), F.coalesce("spike_count", F.lit(0)) > 20
    low = effective < 0.3
    return F.when(low & shaky, "Stuck").when(low, "Frozen").when(shaky, "Jittery").when(effective < 0.5, "Inefficient").otherwise("Unusual")


def available_deviation() -> Column:
    """100 (1 - mean score of the available results), null without any."""
    off = F.filter("results", lambda r: r["availability"] == "available")
    return 100 * (1 - F.try_divide(F.aggregate(off, F.lit(0.0), lambda a, r: a + r["score"]), F.size(off)))


def deviation() -> Column:
    """``available_deviation``, 0 without any available result."""
    return F.coalesce(available_deviation(), F.lit(0.0))


def pattern_history(audit: DataFrame) -> DataFrame:
    """The simpler ladder that the run history uses."""
    return audit.select("ep", history_pattern().alias("pattern"))


def _state(name: str, field: str) -> Column:
    """A field of one metric's result."""
    return F.get("results", F.lit(METRICS.index(name)))[field]


def _integrity_counts() -> list[Column]:
    on = lambda k: _state(k, "availability") == "available"
    return [sum((F.count_if(on(k)) for k in CRITICAL), F.lit(0)).alias("available"), sum((F.count_if(on(k) & _state(k, "passed")) for k in CRITICAL), F.lit(0)).alias("passed")]


def _dimension_counts() -> list[Column]:
    available = F.when(_state("distribution", "availability") == "available", F.col("duration"))
    return [
        *_integrity_counts(),
        F.count("*").alias("n"),
        F.count_if(_state("timestamp_validity", "passed")).alias("timed"),
        F.median("effective_motion_ratio").alias("moving"),
        F.percentile(available, F.array(F.lit(0.5), F.lit(0.95))).alias("d"),
    ]


def _dimensions(counts: DataFrame) -> DataFrame:
    mid, high = F.col("d")[0], F.col("d")[1]
    spread = F.when((mid > 0) & (high > 0), 100 * (1 - F.least(F.try_divide(high, mid) - 1, F.lit(1.0))))
    dims = {
        "integrity": F.coalesce(100 * F.try_divide("passed", "available"), F.lit(100.0)),
        "temporal": 50 + 50 * F.coalesce(F.try_divide("timed", "n"), F.lit(1.0)),
        "motion": F.coalesce(100 * F.col("moving"), F.lit(75.0)),
        "consistency": F.greatest(F.coalesce(spread, F.lit(70.0)), F.lit(0.0)),
    }
    return counts.withColumns({k: F.bround(c, 1) for k, c in dims.items()})


def quality_dimensions(audit: DataFrame) -> DataFrame:
    """integrity, temporal, motion and consistency, 0 to 100, to one digit (halves to even).

    Integrity: passed of the available results of the five integrity metrics. Consistency: durations of
    the episodes that have an action or a state; an episode without frames has neither. What cannot be
    computed takes 100, 100, 75 and 70.
    """
    return _dimensions(audit.agg(*_dimension_counts())).select(*HEALTH_WEIGHTS)


def dataset_health(audit: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """The weighted index as a whole number, its grade, training readiness and the index after a clean-up; one aggregate.

    Ready: fewer than 5 % excluded and 15 % in review; conditionally: 10 % and 30 %. integrity_passed is
    the integrity results that passed, divided by the five metrics and rounded down, as reports show it.
    ``more``: further aggregates, which become columns.
    """
    verdicts = [F.count_if(F.col("verdict") == v).alias(k) for v, k in zip(VERDICTS, ("passes", "review", "excluded"), strict=True)]
    counts = audit.agg(*verdicts, *_dimension_counts(), *[c.alias(k) for k, c in (more or {}).items()])
    both = _dimensions(counts.withColumn("integrity_passed", F.floor(F.col("passed") / len(CRITICAL))))
    both = both.withColumn("health", F.bround(sum((F.col(k) * F.lit(w) for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0)), 0).cast("long"))
    grade, ready = F.lit("Poor"), F.lit("Not Ready")
    for bound, name in reversed(GRADES):
        grade = F.when(F.col("health") >= bound, name).otherwise(grade)
    x, r = F.coalesce(F.try_divide("excluded", "n"), F.lit(0.0)), F.coalesce(F.try_divide("review", "n"), F.lit(0.0))
    for most_x, most_r, name in reversed(READY):
        ready = F.when((x < most_x) & (r < most_r), name).otherwise(ready)
    after = F.least(F.lit(100.0), F.col("health") + F.least(F.lit(20.0), 30 * x)).cast("long")
    return both.select("n", "passes", "review", "excluded", *HEALTH_WEIGHTS, "health", grade.alias("grade"), ready.alias("readiness"), "integrity_passed", (F.col("n") - F.col("integrity_passed")).alias("integrity_failed"), after.alias("after_cleanup"), *(more or {}))


def health_by_verdict(audit: DataFrame) -> DataFrame:
    """The second index, shown to people: means over episodes instead of medians, consistency from the verdicts.

    The term for steady time steps is fixed at 85: the audit gives no deviation of the steps by metric.
    No episodes: nulls and a grade of Poor.
    """
    share = lambda v: F.count_if(F.col("verdict") == v) / F.count("*")
    smooth = F.greatest(100 - 2 * F.col("spike_count"), F.lit(0)).cast("double")
    got = audit.agg(
        F.count("*").alias("n"),
        (100 * F.count_if(~F.col("hard_fail")) / F.count("*")).alias("integrity"),
        (70 * F.count_if(F.col("time_status") == "pass") / F.count("*") + 0.3 * 85).alias("temporal"),
        (F.coalesce(F.avg(100 * F.col("effective_motion_ratio")), F.lit(90.0)) / 2 + F.coalesce(F.avg(F.when(F.col("jump_status") != "na", smooth)), F.lit(95.0)) / 2).alias("motion"),
        *[share(v).alias(k) for v, k in zip(VERDICTS, ("p", "r", "x"), strict=True)],
    )
    got = got.withColumn("consistency", 100 * F.col("p") + 50 * F.col("r"))
    got = got.withColumn("health", sum((F.col(k) * F.lit(w) for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0)))
    grade = F.when(F.col("health") >= 90, "Excellent").when(F.col("health") >= 75, "Good").when(F.col("health") >= 60, "Fair").otherwise("Poor")
    ready = F.when((F.col("x") < 0.05) & (F.col("r") < 0.15), "Ready").when((F.col("x") < 0.1) & (F.col("r") < 0.3), "Conditionally Ready").otherwise("Not Ready")
    clean = F.least(60 * F.try_divide(F.col("p") + 0.7 * F.col("r"), 1 - F.col("x")) + 0.4 * F.col("integrity"), F.lit(100.0))
    after = F.when(F.col("x") < 1, clean).otherwise(F.col("health"))
    return got.select("n", "integrity", "temporal", "motion", "consistency", "health", grade.alias("grade"), ready.alias("readiness"), after.alias("after_cleanup"))


def hero_metrics(audit: DataFrame, sync: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: sensor offsets (ep, worst_p95), spikes and occupied cells (ep, occupancy_rate), with their bands."""
    offset, rate = F.col("sync_median"), F.col("occupancy_median")
    a = sync.agg(F.count("worst_p95").alias("sync_episodes"), F.median("worst_p95").alias("sync_median"))
    b = audit.agg(F.coalesce(F.sum("spike_count"), F.lit(0)).alias("total_spikes"), F.count_if(F.col("spike_count") > 0).alias("spiky_episodes"))
    c = cells.agg(F.median("occupancy_rate").alias("occupancy_median"))
    one = lambda df: df.withColumn("one", F.lit(1))
    row = one(a).join(F.broadcast(one(b)), "one").join(F.broadcast(one(c)), "one").drop("one")
    band = F.when(offset.isNull(), "na").when(offset < 5, "excellent").when(offset < 20, "acceptable").when(offset < 50, "needs_check").otherwise("severe")
    filled = F.when(rate > 0.5, "good").when(rate > 0.2, "moderate").otherwise("low")
    return row.withColumn("sync_band", band).withColumn("occupancy_band", filled)


def reason_vector(audit: DataFrame) -> DataFrame:
    """duration, spikes, 1 - effective share (0 where not available), and their sum."""
    r = reasons()
    return audit.select("ep", r["duration"].alias("duration"), r["spikes"].cast("long").alias("spikes"), r["low_motion"].alias("low_motion"), (r["duration"] + r["spikes"] + r["low_motion"]).alias("deviation"))


def top_observations(audit: DataFrame, n: int = 5, occupancy: bool = False) -> DataFrame:
    """The dataset's ranked findings: graver first, then by the share of episodes they touch, then in the order listed here.

    A row for each integrity metric that failed; sensor offsets (info where no episode has them);
    spikes, high from a tenth of the episodes on; spikes of acceleration; with ``occupancy`` the
    occupied cells, medium below a median of a tenth; idle shares of a median above 0.3.
    """
    total = F.count("*")
    one = lambda name, level, hits: F.struct(level.cast("int").alias("level"), hits.alias("episodes"), F.lit(name).alias("observation"))
    on = lambda k: F.count_if(_state(k, "availability") == "available")
    found = [one(k, F.when(bad > 0, 0), bad) for k in CRITICAL for bad in [F.count_if((_state(k, "availability") == "available") & ~_state(k, "passed"))]]
    sync, spiky, rough = on("sensor_synchronization"), F.count_if(F.col("spike_count") > 0), F.count_if(F.col("acc_spikes") > 0)
    found.append(one("sensor_synchronization", F.when(sync > 0, 1).otherwise(3), sync))
    found.append(one("action_discontinuity", F.when(spiky > 0, F.when(spiky / total < 0.1, 1).otherwise(0)), spiky))
    found.append(one("velocity_acceleration", F.when(rough > 0, 2), rough))
    if occupancy:
        found.append(one("state_space_occupancy", F.when(on("coverage") > 0, F.when(F.median("occupancy_rate") < 0.1, 1).otherwise(2)), on("coverage")))
    found.append(one("idle_ratio", F.when(F.median("idle_ratio") > 0.3, 1), on("idle_ratio")))
    rows = audit.agg(total.alias("n"), F.array(*found).alias("r")).filter("n > 0")
    rows = rows.select("n", F.transform("r", lambda x, i: F.struct(x["level"].alias("level"), (-x["episodes"]).alias("less"), i.alias("place"), x["observation"].alias("observation"), x["episodes"].alias("episodes"))).alias("r"))
    ranked = rows.select("n", F.posexplode(F.array_sort(F.filter("r", lambda x: x["level"].isNotNull()))).alias("rank", "r")).filter(F.col("rank") < n)
    level = F.element_at(F.array(*map(F.lit, SIGNIFICANCE)), F.col("r.level") + 1)
    return ranked.select((F.col("rank") + 1).cast("long").alias("rank"), "r.observation", level.alias("significance"), "r.episodes", (F.col("r.episodes") / F.col("n")).alias("ratio"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Counts and pass rate."""
    return audit.agg(F.count("*").alias("episodes"), F.count_if(F.expr("verdict = 'PASS'")).alias("passed"), F.count_if(F.expr("verdict = 'REVIEW'")).alias("review"), F.count_if(F.expr("verdict = 'EXCLUDE'")).alias("excluded"), (F.count_if(F.expr("verdict = 'PASS'")) / F.count("*")).alias("pass_rate"))


def episode_report(audit: DataFrame) -> DataFrame:
    """Each episode's report: verdict, evidence, codes, patterns, reasons, figures, what could not be judged, and the dataset's medians.

    All but the medians are columns of the episode's own row.
    """
    medians = audit.agg(F.median("duration").alias("median_duration"), F.median("spike_count").alias("median_spikes"), F.median("velocity_p95").alias("median_velocity")).withColumn("one", F.lit(1))
    code = F.create_map(*[F.lit(x) for pair in ISSUE_CODES.items() for x in pair])
    failed = lambda r: (r["availability"] == "available") & ~r["passed"]
    issue = lambda r: F.coalesce(F.try_element_at(code, r["metric"]), F.lit("UNK-00"))
    named = lambda test, what=lambda r: r["metric"]: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("results", test), what))), ",")
    r = reasons()
    rows = audit.withColumn("found", patterns()).select(
        "ep", "verdict", "severity", "frames", "duration", "spike_count", "effective_motion_ratio", "velocity_p95", "path_length",
        evidence().alias("evidence"),
        named(failed, issue).alias("issues"),
        named(lambda r: failed(r) & r["metric"].isin(*CRITICAL), issue).alias("hard_fail_issues"),
        named(lambda r: (r["availability"] == "available") & (r["status"] == "review") & r["metric"].isin(*BEHAVIOUR)).alias("risk_signals"),
        named(lambda r: r["availability"] == "not_available").alias("unverifiable"),
        F.get("found", F.lit(0))["pattern"].alias("pattern"),
        F.get("found", F.lit(1))["pattern"].alias("second_pattern"),
        r["low_motion"].alias("low_motion"),
        (r["duration"] + r["spikes"] + r["low_motion"]).alias("deviation"),
    )
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(medians), "one").drop("one")  # medians: one row


def anonymized(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.concat(F.lit("redacted:"), F.substring(F.sha2(F.col(column), 256), 1, 16)))


def spike_regions(spikes: DataFrame) -> DataFrame:
    """ep, start, end of max(1, T // 100) frames round each spike (ep, fi, frames), inside the episode."""
    pad = F.greatest(F.lit(1).cast("long"), F.floor(F.col("frames") / 100))
    return spikes.select("ep", "fi", F.greatest(F.col("fi") - pad, F.lit(0)).alias("start"), F.least(F.col("fi") + pad, F.col("frames") - 1).alias("end"))


def _class() -> Column:
    return F.when(F.col("verdict") == "EXCLUDE", 0).when(F.col("verdict") == "REVIEW", 1).otherwise(2)


def episode_table(audit: DataFrame) -> DataFrame:
    """One row per episode with its deviation (``deviation``) and place: EXCLUDE, REVIEW, PASS, then by deviation."""
    rows = audit.select("ep", "verdict", _class().alias("class"), deviation().alias("deviation"), "severity")
    return rows.select("ep", "verdict", "class", "deviation", F.greatest("deviation", F.col("severity").cast("double")).alias("issue_severity"))


def episode_ranks(audit: DataFrame) -> DataFrame:
    """ep, verdict, deviation, rank over the whole dataset: EXCLUDE, REVIEW, PASS, the larger deviation first, then by number.

    The deviation is 100 (1 - mean score of the available results), to two digits; 0 without any.
    """
    rows = audit.select("ep", "verdict", _class().alias("class"), F.round(deviation(), 2).alias("deviation"))
    return numbered(rows, [F.asc("class"), F.desc("deviation"), F.asc("ep")]).select("ep", "verdict", "deviation", "rank")


def findings(audit: DataFrame) -> DataFrame:
    """Behavioural findings with their points: medium from 20 on, else low."""
    rows = F.array(F.struct(F.lit("action_discontinuity").alias("metric"), spike_points(F.coalesce("spike_count", F.lit(0))).alias("points")), F.struct(F.lit("idle_ratio").alias("metric"), effective_points(F.coalesce("effective_motion_ratio", F.lit(1.0))).alias("points")))
    got = audit.select("ep", F.explode(rows).alias("r")).select("ep", "r.*").filter("points > 0")
    return got.withColumn("level", F.when(F.col("points") >= 20, "medium").otherwise("low"))


def trend(snapshots: DataFrame, key: str) -> DataFrame:
    """name, run, value, change of each run in order of time: a rate, a count or any column of the snapshots, to four digits."""
    share = lambda c: F.coalesce(F.try_divide(c, "episodes"), F.lit(0.0))
    known = {"pass_rate": share("passes"), "review_rate": share("review"), "exclude_rate": share("excluded"), "exclude_count": F.col("excluded").cast("double"), "total_episodes": F.col("episodes").cast("double")}
    value = known[key] if key in known else F.coalesce(F.col(key).cast("double"), F.lit(0.0)) if key in snapshots.columns else F.lit(0.0)
    rows = snapshots.select("name", "run", F.round(value, 4).alias("value"))
    return rows.withColumn("change", F.col("value") - F.lag("value").over(Window.partitionBy("name").orderBy("run")))


def integrity_pass_rate(results: DataFrame) -> DataFrame:
    """Share of episodes without an available critical metric that failed."""
    bad = F.bool_or((F.col("availability") == "available") & ~F.col("passed") & F.col("metric").isin(*CRITICAL))
    return results.groupBy("ep").agg(bad.alias("bad")).agg(F.round(F.count_if(~F.col("bad")) / F.count("*"), 4).alias("integrity_pass_rate"))


def episode_integrity(results: DataFrame) -> DataFrame:
    """ep, passed, codes: the codes of the critical metrics that failed, comma-joined."""
    code = F.create_map(*[F.lit(x) for pair in ISSUE_CODES.items() for x in pair])
    failed = (F.col("availability") == "available") & ~F.col("passed") & F.col("metric").isin(*CRITICAL)
    codes = F.sort_array(F.collect_set(F.when(failed, F.try_element_at(code, F.col("metric")))))
    return results.groupBy("ep").agg((F.size(codes) == 0).alias("passed"), F.concat_ws(",", codes).alias("codes"))


def reference_medians(audit: DataFrame) -> DataFrame:
    """The dataset's median duration, spikes and velocity p95."""
    return audit.agg(F.median("duration").alias("duration"), F.median("spike_count").alias("spikes"), F.median("velocity_p95").alias("velocity_p95"))


def validation_records(rows: DataFrame) -> DataFrame:
    """ep, verdict, frames of the rows with frames and a known verdict."""
    return rows.filter((F.col("frames") > 0) & F.col("verdict").isin(*VERDICTS)).select("ep", "verdict", "frames")


def episode_csv(audit: DataFrame, *verdicts: str) -> DataFrame:
    """A flat table of all episodes, or of those with one of ``verdicts``; ``overview.export_rows`` has the columns of the user's export."""
    rows = audit.filter(F.col("verdict").isin(*verdicts)) if verdicts else audit
    return rows.select("ep", "frames", "duration", "verdict", "spike_count", "idle_ratio", F.greatest(deviation(), F.col("severity").cast("double")).alias("issue_severity"))


def removal_list(table: DataFrame, decisions: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` removed episodes of the largest issue severity; uncertain ones are in no list."""
    removed = decisions.filter(~F.col("kept") & (F.col("reason") != "uncertain")).select("ep", "reason")
    return table.join(removed, "ep").orderBy(F.desc("issue_severity"), "ep").limit(n).select("ep", "reason", "issue_severity")


def snapshots(audit: DataFrame, name: Column, run: Column) -> DataFrame:
    """One row per dataset and run, as the run history keeps them: verdict counts, integrity, deviations, patterns and headline figures."""
    rows = audit.withColumns({"name": name, "run": run})
    rows = rows.withColumns({"off": available_deviation(), "pattern": history_pattern()})
    return rows.groupBy("name", "run").agg(
        F.count("*").alias("episodes"),
        *[F.count_if(F.col("verdict") == v).alias(k) for v, k in zip(VERDICTS, ("passes", "review", "excluded"), strict=True)],
        F.round(F.count_if(~F.col("hard_fail")) / F.count("*"), 4).alias("integrity_pass_rate"),
        F.avg("off").alias("mean_deviation_score"),
        F.median("off").alias("median_deviation_score"),
        *[F.count_if(F.col("pattern") == p).alias(f"n_{p.lower()}") for p in HISTORY_PATTERNS],
        F.median("worst_p95").alias("sync_median"),
        F.coalesce(F.sum("spike_count"), F.lit(0).cast("long")).alias("total_spikes"),
        F.median("occupancy_rate").alias("occupancy_median"),
    )
