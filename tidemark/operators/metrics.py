"""The episode metrics over frames (ep, fi, t, action, state), one row per episode.

``measure`` works out every figure in one plan: frames are distributed by episode once, differences,
medians and thresholds are windows on that distribution, and one aggregate closes it. The other
functions pick columns from it, and what they do not pick is pruned from the plan. An episode is one
window partition, sorted and, if need be, spilled by one task, unless ``measure`` is asked for blocks.

``status`` columns: 'na' where a metric cannot be computed, 'exclude' for values that are not finite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.seq import BINS, WHOLE, Cut, by_frame, difference, edge_bin, finite, norm, percentiles, valley_threshold, whole
from tidemark.sources.features import NUMBERS, STATE, keys

SPIKE_Z = 5.0
IDLE_FLOOR = 1e-6
WINDOWS = (5, 10, 20)
DEFAULT_HZ = 30.0
GRID_DIMS, RESOLUTION, THIN = 3, 10, 0.1
# Where the number of bins is a parameter, histograms have so many; it may be at most this.
MOST_BINS = 100
FEATURES = ("action", "state")


# What may differ by dataset or platform: a column of this name in the frames (``with_parameters``) goes before the default.
PARAMETERS = {"spike_z": SPIKE_Z, "idle_multiple": 3.0, "idle_floor": IDLE_FLOOR, "bins": BINS, "resolution": RESOLUTION, "default_hz": DEFAULT_HZ}


def with_parameters(frames: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``frames`` with the parameters of their ``key`` (a dataset, a platform): ``table`` has a row for each key and some of ``PARAMETERS`` as columns.

    Keys that ``table`` lacks and nulls take the defaults. One plan so audits many datasets, each with its own thresholds.
    """
    own = [c for c in PARAMETERS if c in table.columns]
    named = table.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in own])
    rows = frames.join(named, F.col(key) == F.col("_key"), "left").drop("_key")
    return rows.withColumns({c: F.coalesce(F.col(f"_{c}"), F.lit(PARAMETERS[c])) for c in own}).drop(*[f"_{c}" for c in own])


def _parameter(rows: DataFrame, name: str, default: float | None = None) -> Column:
    return F.col(name) if name in rows.columns else F.lit(PARAMETERS[name] if default is None else default)


def steps(frames: DataFrame) -> DataFrame:
    """Frames with d1, motion (norm of d1), d2 and jump (norm of d2) of the action."""
    out = frames.withColumn("d1", difference("action")).withColumn("d2", difference("d1"))
    return out.withColumn("motion", norm("d1")).withColumn("jump", norm("d2"))


def _stepped(frames: DataFrame, cut: Cut = WHOLE) -> DataFrame:
    """``steps`` with the time step and the state's step, speed and change of speed."""
    by = cut.by_frame()
    out = frames.withColumns({"dt": F.col("t") - F.lag("t").over(by), "first": cut.first(), "d1": difference("action", by), "ds": difference("state", by)})
    safe = F.when(F.col("dt") == 0, 1e-9).otherwise(F.coalesce("dt", F.lit(1.0)))
    out = out.withColumn("vel", F.transform("ds", lambda x: x / safe))
    out = out.withColumns({"d2": difference("d1", by), "acc": difference("vel", by)})
    return out.withColumns({"motion": norm("d1"), "jump": norm("d2"), "sn": norm("ds"), "speed": norm("vel"), "change": norm("acc"), "delta_ok": F.coalesce(finite("d1"), F.lit(True))})


def _cells(columns: tuple[str, ...] = FEATURES) -> dict[str, Column]:
    values = F.concat(*[F.coalesce(c, F.array().cast("array<double>")) for c in columns])
    count = lambda test: F.size(F.filter(values, test)).cast("long")
    return {"cells": F.size(values).cast("long"), "nan_cells": count(F.isnan), "inf_cells": count(lambda x: F.abs(x) == float("inf"))}


def _idle(rows: DataFrame, cut: Cut = WHOLE) -> DataFrame:
    """Adds n, top, bin, motion_mad, thr, method, idle and active (null on an episode's first frame)."""
    bins, most, floor, times = _parameter(rows, "bins"), BINS if "bins" not in rows.columns else MOST_BINS, _parameter(rows, "idle_floor"), _parameter(rows, "idle_multiple")
    rows = cut.know(rows, {"n": F.count("motion"), "top": F.max("motion"), "motion_med": F.median("motion")})
    place = F.when(F.col("top") > 0, edge_bin(F.col("motion"), F.col("top"), bins)).otherwise(0)
    rows = rows.withColumn("bin", F.when(F.col("motion").isNotNull(), place))
    spread = F.median(F.abs(F.col("motion") - F.col("motion_med")))
    if cut.block is None:
        hist = F.array(*[F.count_if(F.col("bin") == i).over(whole()) for i in range(most)])
        rows = rows.withColumns({"motion_mad": spread.over(whole()), "hist": hist})
        rows = rows.withColumn("valley", F.when(F.col("first"), valley_threshold(F.col("hist"), F.col("n"), F.col("top"), bins)))  # once an episode
        rows = rows.withColumn("valley", F.max("valley").over(whole()))
    else:
        hist = F.array(*[F.count_if(F.col("bin") == i) for i in range(most)])
        valley = valley_threshold(F.col("hist"), F.col("_n"), F.col("_top"), F.col("_bins"))
        rows = cut.know(rows, {"motion_mad": spread, "hist": hist, "_n": F.max("n"), "_top": F.max("top"), "_bins": F.max(bins)}, {"valley": valley}).drop("_n", "_top", "_bins")
    method = F.when(F.col("valley").isNotNull(), "bimodal_gap").when(times * F.col("motion_mad") < floor, "floor").otherwise("mad")
    rows = rows.withColumns({"method": method, "thr": F.greatest(F.coalesce("valley", times * F.col("motion_mad")), floor)})
    idle = F.col("motion") < F.col("thr")
    return rows.withColumns({"idle": idle, "active": (~idle).cast("int")})


def _runs(rows: DataFrame, cut: Cut = WHOLE) -> DataFrame:
    """Adds step (from 0), moves (an active step after none), run (frames of a run, at its last step) and the full windows."""
    by = cut.by_frame()
    rows = rows.withColumn("step", F.row_number().over(by) - 2 if cut.block is None else F.col("fi") - 1)
    full = {f"w{n}": F.sum("active").over(by.rowsBetween(-(n - 2), 0)) == n - 1 for n in WINDOWS}
    rows = rows.withColumns({"was": F.lag("active").over(by), "then": F.lead("active").over(by), **full})
    rows = cut.highest_before(rows, "paused", F.when(F.col("idle"), F.col("step")))
    on = F.col("active") == 1
    run = F.when(on & (F.coalesce("then", F.lit(0)) == 0), F.col("step") - F.coalesce("paused", F.lit(-1)) + 1)
    return rows.withColumns({"moves": on & (F.coalesce("was", F.lit(0)) == 0), "run": run.cast("long")})


def _grid(rows: DataFrame, cut: Cut = WHOLE) -> DataFrame:
    """Adds cell, the code of the frame's cell over the first (at most three) state dimensions."""
    resolution = _parameter(rows, "resolution")
    for d in range(GRID_DIMS):
        rows = rows.withColumn(f"x{d}", F.get("state", F.lit(d)))
    rows, cell = cut.know(rows, {f"{k}{d}": f(f"x{d}") for d in range(GRID_DIMS) for k, f in (("lo", F.min), ("hi", F.max))}), F.lit(0)
    for d in range(GRID_DIMS):
        lo, hi = F.col(f"lo{d}"), F.col(f"hi{d}")
        low, high = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
        cell = cell * resolution + F.coalesce(edge_bin(F.col(f"x{d}") - low, high - low, resolution), F.lit(0))
    return rows.withColumn("cell", F.when(F.coalesce(finite("state"), F.lit(False)), cell))


def measure(frames: DataFrame, default_hz: float = DEFAULT_HZ, spike_z: float = SPIKE_Z, block: int | None = None) -> DataFrame:
    """Every figure of every episode, from one distribution of the frames.

    ``frames`` may also have number (the stored frame number: missing ones are counted), cells,
    nan_cells, inf_cells (counts over features that are not in action and state) and features (what is
    counted of each feature, see ``sources.features``; else action and state are the features), and any
    of ``PARAMETERS``, which must be the same in all frames of an episode.
    With ``block`` an episode is dealt in blocks of so many frames (``functions.seq.Cut``), so one long
    episode is many tasks; the figures are the same. Its medians and percentiles meet as counts of
    distinct values in the task that closes the episode.
    """
    cut = Cut.of(frames, block)
    rows = _stepped(cut.deal(frames), cut)
    for name, count in _cells().items():
        rows = rows.withColumn(name, count + F.coalesce(name, F.lit(0).cast("long")) if name in frames.columns else count)
    rows = _grid(_runs(_idle(rows, cut), cut), cut)
    rows = cut.know(rows, {f"{c}_med": F.median(c) for c in ("jump", "change")})
    rows = cut.know(rows, {f"{c}_mad": F.median(F.abs(F.col(c) - F.col(f"{c}_med"))) for c in ("jump", "change")})
    rows = cut.own(rows)
    hz, bound, resolution = _parameter(rows, "default_hz", default_hz), _parameter(rows, "spike_z", spike_z), _parameter(rows, "resolution")
    spike = lambda c: (F.col(f"{c}_mad") > 0) & (F.abs(F.try_divide(F.lit(0.6745) * (F.col(c) - F.col(f"{c}_med")), F.col(f"{c}_mad"))) > bound)
    ms, count = 1000 * F.col("dt"), F.count("*")
    pace = F.when(F.col("dt").isNull(), F.col("sn") * hz).otherwise(F.try_divide("sn", F.when(F.col("dt") <= 0, 1e-9).otherwise(F.col("dt"))))
    missing = F.lit(0).cast("long")
    if "number" in frames.columns:
        rows = rows.withColumn("inside", F.when((F.col("number") >= 0) & (F.col("number") < F.count("*").over(whole())), F.col("number")))
        missing = count - F.size(F.collect_set("inside")).cast("long")
    names = keys(frames)
    counts, n_of, n_any = [], {"action": F.col("n_action"), STATE: F.col("n_state")}, [F.col("n_action"), F.col("n_state")]
    if names:  # no two columns of the same count: the optimizer would say every constraint of the plan in both names
        counts = [F.count(F.col("features").getField(k)).alias(f"_n{i}") for i, k in enumerate(names)]
        counts += [F.max(F.col("features").getField(k).getField("dtype")).isin(*NUMBERS.values()).alias(f"_number{i}") for i, k in enumerate(names)]
        n_any = [F.col(f"_n{i}") for i in range(len(names))]
        n_of = {k: F.when(F.col(f"_number{i}"), n_any[i]).otherwise(F.lit(0).cast("long")) for i, k in enumerate(names)}
    first = F.min(F.when(F.col("active") == 1, F.col("step")))
    n_steps = F.count("motion")
    got = rows.groupBy("ep").agg(
        count.alias("frames"),
        *[F.count(c).alias(f"n_{c}") for c in FEATURES],
        *counts,
        F.count("t").alias("n_t"),
        F.every(F.coalesce(finite("action"), F.lit(True))).alias("action_ok"),
        F.every("delta_ok").alias("delta_ok"),
        F.every(F.coalesce(finite("state"), F.lit(True))).alias("state_ok"),
        F.max(F.size("state")).alias("width"),
        F.max(resolution).alias("grid"),
        F.size(F.collect_set("cell")).cast("long").alias("occupied"),
        *[F.sum(c).alias(c) for c in ("cells", "nan_cells", "inf_cells")],
        missing.alias("missing"),
        F.count_if(spike("jump")).alias("spike_count"),
        percentiles("jump", 0.95, 0.99).alias("jump_p"),
        F.max("jump").alias("jump_max"),
        percentiles("motion", 0.95, 0.99).alias("delta_p"),
        F.max("motion").alias("delta_max"),
        n_steps.alias("n"),
        F.first("method").alias("method"),
        F.first("thr").alias("thr"),
        F.first("motion_mad").alias("motion_mad"),
        F.count_if("idle").alias("idle_steps"),
        F.when(first > 0, first + 1).when(first == 0, 0).otherwise(n_steps + 1).cast("long").alias("idle_prefix"),
        F.count_if("moves").alias("transitions"),
        *[F.when(n_steps + 1 < k, 0.0).otherwise(F.try_divide(F.count_if(f"w{k}"), n_steps + 2 - k)).alias(f"valid_{k}") for k in WINDOWS],
        percentiles("run", 0.5, 0.9).alias("run_p"),
        F.coalesce(F.max("run"), F.lit(0).cast("long")).alias("run_max"),
        F.count_if((F.col("dt") < 0) | F.isnan("dt")).alias("backward"),
        F.count_if(F.col("dt") == 0).alias("duplicates"),
        F.percentile(F.abs(ms), F.array(*map(F.lit, (0.5, 0.95, 0.99)))).alias("dt_p"),
        F.max(F.abs(ms)).alias("dt_max"),
        F.avg(ms).alias("dt_mean"),
        F.stddev_pop(ms).alias("dt_std"),
        percentiles("speed", 0.5, 0.95, 0.99).alias("speed_p"),
        F.max("speed").alias("velocity_max"),
        F.count_if(spike("change")).alias("acc_spikes"),
        F.when(F.count("t") == count, F.max_by("t", "fi") - F.min_by("t", "fi")).otherwise((count - 1) / F.max(hz)).alias("duration"),
        F.coalesce(F.sum("sn"), F.lit(0.0)).alias("path_length"),
        F.max_by("state", "fi").alias("end_state"),
        F.avg(pace).alias("pace_mean"),
        F.stddev_pop(pace).alias("pace_std"),
        F.percentile(pace, F.lit(0.95)).alias("pace_p95"),
    )
    some_action, some_state = F.col("n_action") > 0, F.col("n_state") > 0
    jump = F.when(~some_action, "na").when(~F.col("action_ok"), "exclude").when(F.col("frames") < 3, "na").otherwise("pass")
    idle = F.when(~some_action | (F.col("frames") < 2), "na").when(~F.col("delta_ok"), "exclude").otherwise("pass")
    speed = F.when(~some_state, "na").when(~F.col("state_ok"), "exclude").when(F.col("frames") < 3, "na").otherwise("pass")
    got = got.withColumns({"jump_status": jump, "idle_status": idle, "velocity_status": speed, "time_status": F.when(F.col("backward") > 0, "exclude").otherwise("pass")})
    got = got.withColumns(
        {
            "distribution_status": F.when(some_action | some_state, "pass").otherwise("na"),
            "coverage_status": F.when(some_state & F.col("state_ok"), "pass").otherwise("na"),
            "sufficiency_status": F.when(idle == "pass", "pass").otherwise("na"),
            "jitter_status": F.when(F.col("n_t") < 2, "na").otherwise("pass"),
        }
    )
    use = lambda status, c: F.when(F.col(status) == "pass", c)
    most = F.greatest(*n_of.values(), F.lit(0).cast("long"))
    want = F.when(n_of[STATE] > 0, n_of[STATE]).otherwise(most) if STATE in n_of else most
    off = lambda columns, right: sum((((n > 0) & (n != right)).cast("long") for n in columns), F.lit(0).cast("long"))
    ratio = use("idle_status", F.try_divide("idle_steps", "n"))
    late = F.greatest(1 - F.try_divide("duplicates", "frames"), F.lit(0.0))
    plain = ("frames", "missing", "cells", "nan_cells", "inf_cells", "backward", "duplicates", "duration", "path_length", "end_state", "pace_mean", "pace_std", "pace_p95", "dt_max", "dt_mean", "dt_std")
    states = [c for c in got.columns if c.endswith("_status")]
    return got.select(
        "ep",
        *plain,
        *states,
        off(n_of.values(), want).alias("dropout"),
        off(n_any, F.col("frames")).alias("mismatched"),
        F.when(F.col("backward") > 0, 0.0).otherwise(F.coalesce(late, F.lit(1.0))).alias("time_score"),
        *[F.col("dt_p")[i].alias(f"dt_p{k}") for i, k in enumerate((50, 95, 99))],
        F.when(F.col("dt_mean") > 0, F.try_divide("dt_std", "dt_mean")).otherwise(0.0).alias("cv"),
        *[use("jump_status", c).alias(k) for k, c in {"spike_count": F.col("spike_count"), "spike_rate": F.col("spike_count") / F.greatest(F.col("frames") - 2, F.lit(1)), "jump_p95": F.col("jump_p")[0], "jump_p99": F.col("jump_p")[1], "jump_max": F.col("jump_max"), "delta_p95": F.col("delta_p")[0], "delta_p99": F.col("delta_p")[1], "delta_max": F.col("delta_max")}.items()],
        "n",
        *[use("idle_status", F.col(c)).alias(c) for c in ("method", "thr", "motion_mad")],
        ratio.alias("idle_ratio"),
        (1 - ratio).alias("effective_motion_ratio"),
        *[use("sufficiency_status", c).alias(k) for k, c in {"idle_total": ratio, **{k: F.col(k) for k in ("idle_prefix", "transitions", *[f"valid_{k}" for k in WINDOWS])}, "run_p50": F.coalesce(F.col("run_p")[0], F.lit(0.0)), "run_p90": F.coalesce(F.col("run_p")[1], F.lit(0.0)), "run_max": F.col("run_max")}.items()],
        *[use("velocity_status", c).alias(k) for k, c in {**{f"velocity_p{k}": F.col("speed_p")[i] for i, k in enumerate((50, 95, 99))}, "velocity_max": F.col("velocity_max"), "acc_spikes": F.col("acc_spikes"), "acc_spike_rate": F.col("acc_spikes") / F.col("frames")}.items()],
        use("coverage_status", F.col("occupied")).alias("occupied"),
        use("coverage_status", F.col("occupied") / F.pow(F.col("grid").cast("double"), F.least("width", F.lit(GRID_DIMS)))).alias("occupancy_rate"),
    )


def action_discontinuity(frames: DataFrame) -> DataFrame:
    """Spikes (robust z above 5) of the second difference's norm: count, rate over T - 2, p95, p99, max."""
    return measure(frames).select("ep", F.col("jump_status").alias("status"), "spike_count", "spike_rate", "jump_p95", "jump_p99", "jump_max")


def joint_spikes(frames: DataFrame) -> DataFrame:
    """Spikes of each joint's absolute second difference, for all joints."""
    rows = steps(frames).select("ep", "fi", F.posexplode("d2").alias("joint", "x")).withColumn("x", F.abs("x"))
    by = Window.partitionBy("ep", "joint")
    rows = rows.withColumn("med", F.median("x").over(by)).withColumn("mad", F.median(F.abs(F.col("x") - F.col("med"))).over(by))
    spike = (F.col("mad") > 0) & (F.abs(F.lit(0.6745) * (F.col("x") - F.col("med"))) > SPIKE_Z * F.col("mad"))
    return rows.groupBy("ep", "joint").agg(F.count_if(spike).alias("spikes"))


def affected_joints(frames: DataFrame) -> DataFrame:
    """ep, joints: the joints with a spike, in order; none: an empty list."""
    hit = F.collect_list(F.when(F.col("spikes") > 0, F.col("joint").cast("long")))
    return joint_spikes(frames).groupBy("ep").agg(F.sort_array(hit).alias("joints"))


def motion_bins(frames: DataFrame) -> DataFrame:
    """Each step's motion with n, top and bin of its episode's histogram."""
    return _idle(_stepped(frames)).filter("motion is not null").select("ep", "fi", "motion", "n", "top", "bin")


def idle_threshold(frames: DataFrame) -> DataFrame:
    """ep, n, method (bimodal_gap, mad, floor), thr and motion's mad."""
    return measure(frames).filter("n > 0").select("ep", "n", "method", "thr", F.col("motion_mad").alias("mad"))


def idle_mask(frames: DataFrame) -> DataFrame:
    """ep, fi, motion, idle: motion below the episode's threshold."""
    return _idle(_stepped(frames)).filter("motion is not null").select("ep", "fi", "motion", "n", "method", "thr", "idle")


def idle_ratio(frames: DataFrame) -> DataFrame:
    """Share of idle steps, its complement, the threshold and how it was found.

    Fewer than two frames or no action: 'na'; a difference that is not finite: 'exclude'.
    """
    return measure(frames).select("ep", F.col("idle_status").alias("status"), "method", "thr", "idle_ratio", "effective_motion_ratio", "motion_mad")


def active_runs(frames: DataFrame) -> DataFrame:
    """ep, start, frames of each run of active steps (k steps are k + 1 frames)."""
    rows = _runs(_idle(_stepped(frames))).filter("run is not null")
    return rows.select("ep", (F.col("fi") - F.col("run") + 2).cast("int").alias("start"), F.col("run").alias("frames"))


def temporal_sufficiency(frames: DataFrame) -> DataFrame:
    """Idle share and prefix, run lengths, transitions, share of fully active windows of 5, 10 and 20 frames.

    Not available (status 'na') without an action, with fewer than two frames or values that are not finite.
    """
    return measure(frames).select("ep", F.col("sufficiency_status").alias("status"), "idle_total", "idle_prefix", "transitions", *[f"valid_{n}" for n in WINDOWS], "run_p50", "run_p90", "run_max")


def timestamp_validity(frames: DataFrame) -> DataFrame:
    """Backward or NaN steps exclude; equal time stamps only lower the score."""
    return measure(frames).select("ep", "frames", "backward", "duplicates", F.col("time_status").alias("status"), F.col("time_score").alias("score"))


def dt_stats(frames: DataFrame) -> DataFrame:
    """Percentiles and maximum of |dt|, mean and deviation of signed dt, in milliseconds; cv = std / mean."""
    return measure(frames).filter("jitter_status = 'pass'").select("ep", "dt_p50", "dt_p95", "dt_p99", "dt_max", "dt_mean", "dt_std", "cv")


def velocity_stats(frames: DataFrame) -> DataFrame:
    """Norms of the state's velocity and of its change (not divided by time); spikes of the latter over T."""
    return measure(frames).select("ep", F.col("velocity_status").alias("status"), *[f"velocity_p{k}" for k in (50, 95, 99)], "velocity_max", "acc_spikes", "acc_spike_rate")


def trajectory_stats(frames: DataFrame, default_hz: float = DEFAULT_HZ) -> DataFrame:
    """Duration (frames over ``default_hz`` where time is missing), path length, velocity and end point of the state."""
    return measure(frames, default_hz).select("ep", "frames", F.col("distribution_status").alias("status"), "duration", "path_length", "end_state", *[F.col(f"pace_{k}").alias(f"velocity_{k}") for k in ("mean", "std", "p95")])


def missing_dropout(frames: DataFrame) -> DataFrame:
    """Stored frame numbers (``number``) that are missing and features shorter than the state; either asks for exclusion."""
    bad = (F.col("missing") > 0) | (F.col("dropout") > 0)
    return measure(frames).select("ep", "frames", "missing", "dropout", F.when(bad, "review").otherwise("pass").alias("status"))


def invalid_values(frames: DataFrame) -> DataFrame:
    """NaN and infinite cells over action and state; any excludes."""
    bad = F.col("nan_cells") + F.col("inf_cells") > 0
    return measure(frames).select("ep", "cells", "nan_cells", "inf_cells", F.when(bad, "exclude").otherwise("pass").alias("status"))


def coverage_bins(frames: DataFrame, dims: int = GRID_DIMS, resolution: int = RESOLUTION) -> DataFrame:
    """ep, fi, total, b0 ...: each frame's cell over the first ``dims`` state dimensions, edges by comparison, last edge closed.

    A state of fewer dimensions has a grid of as many: the others' columns are null, total is the
    number of its cells. Episodes with a state that is not finite have no grid and no rows.
    """
    rows = frames.filter("state is not null").withColumns({"ok": F.every(F.coalesce(finite("state"), F.lit(False))).over(whole()), "width": F.least(F.max(F.size("state")).over(whole()), F.lit(dims))})
    out = rows.filter("ok and width > 0").select("ep", "fi", F.pow(F.lit(float(resolution)), "width").cast("long").alias("total"), *[F.get("state", F.lit(d)).alias(f"x{d}") for d in range(dims)])
    for d in range(dims):
        x = F.col(f"x{d}")
        lo, hi = F.min(x).over(whole()), F.max(x).over(whole())
        out = out.withColumn("lo", F.when(lo == hi, lo - 0.5).otherwise(lo)).withColumn("hi", F.when(lo == hi, hi + 0.5).otherwise(hi))
        out = out.withColumn(f"b{d}", F.when(x.isNotNull(), edge_bin(x - F.col("lo"), F.col("hi") - F.col("lo"), resolution)))
    return out.drop("lo", "hi")


def coverage(frames: DataFrame, dims: int = GRID_DIMS, resolution: int = RESOLUTION, thin: float = THIN) -> DataFrame:
    """Occupied cells, their share, and cells with less than ``thin`` of an even share of frames; without a grid no row."""
    cells = coverage_bins(frames, dims, resolution).groupBy("ep", "total", *[f"b{d}" for d in range(dims)]).agg(F.count("*").alias("n"))
    even = cells.withColumn("frames", F.sum("n").over(whole()))
    got = even.groupBy("ep", "total").agg(F.sum("n").alias("frames"), F.count("*").alias("occupied"), F.count_if(F.col("n") < thin * F.col("frames") / F.col("total")).alias("thin"))
    return got.select("ep", "frames", "occupied", (F.col("occupied") / F.col("total")).alias("occupancy_rate"), (F.col("thin") + F.col("total") - F.col("occupied")).alias("underrepresented"))


def underrepresented_cells(frames: DataFrame, dims: int = GRID_DIMS, resolution: int = RESOLUTION, thin: float = THIN) -> DataFrame:
    """Cells of the full grid, empty ones included, with less than ``thin`` of an even share of the episode's frames."""
    names = [f"b{d}" for d in range(dims)]
    cells = coverage_bins(frames, dims, resolution).groupBy("ep", "total", *names).agg(F.count("*").alias("n"))
    code = F.aggregate(F.array(*names), F.lit(0).cast("long"), lambda a, b: F.when(b.isNull(), a).otherwise(a * resolution + b))
    cells = cells.withColumn("cell", code)
    grid = cells.groupBy("ep", "total").agg(F.sum("n").alias("frames")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)))
    got = grid.join(cells.select("ep", "cell", "n"), ["ep", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    got = got.filter(F.col("n") < thin * F.col("frames") / F.col("total")).withColumn("width", F.round(F.log10("total") / F.log10(F.lit(resolution))))
    place = lambda d: F.when(F.col("width") > d, F.pmod(F.floor(F.col("cell") / F.pow(F.lit(float(resolution)), F.col("width") - 1 - d)), F.lit(resolution)).cast("int"))
    return got.select("ep", *[place(d).alias(k) for d, k in enumerate(names)], "n")


def missing_frames(frames: DataFrame, number: str = "number") -> DataFrame:
    """Of the frame numbers 0 .. T-1, how many are not there."""
    return frames.groupBy("ep").agg(F.count("*").alias("frames"), (F.count("*") - F.count_distinct(F.when((F.col(number) >= 0), F.col(number)))).alias("holes"), F.sort_array(F.collect_set(number)).alias("have")).select(
        "ep", "frames", F.size(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1), "have")).cast("long").alias("missing")
    )


def schema_consistency(frames: DataFrame, *features: str) -> DataFrame:
    """Features with fewer values than the episode has frames; any such excludes it."""
    got = frames.groupBy("ep").agg(F.count("*").alias("frames"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(features)])
    short = sum(((F.col(f"n_{i}") != F.col("frames")).cast("int") for i in range(len(features))), F.lit(0))
    return got.select("ep", "frames", short.alias("short"), F.when(short > 0, "exclude").otherwise("pass").alias("status"))


def frame_totals(frames: DataFrame) -> DataFrame:
    """Episodes and frames of a dataset whose metadata does not say."""
    return frames.groupBy("ep").agg(F.count("*").alias("n")).agg(F.count("*").alias("episodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames"))


def joint_limit(frames: DataFrame, limits: DataFrame) -> DataFrame:
    """Cells of state outside ``limits`` (joint, lo, hi), by joint; joints without a limit are left out."""
    rows = frames.select("ep", F.posexplode("state").alias("joint", "x")).join(limits, "joint")
    return rows.groupBy("ep", "joint").agg(F.count_if((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))).alias("violations"))


def action_dim_stats(frames: DataFrame, dims: int) -> DataFrame:
    """Mean, population deviation, percentiles and range of each action dimension."""
    rows = frames.select("ep", F.posexplode(F.slice("action", 1, dims)).alias("dim", "x"))
    got = rows.groupBy("ep", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), percentiles("x", 0.05, 0.5, 0.95).alias("p"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return got.select("ep", "dim", "mean", "std", F.col("p")[0].alias("p05"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95"), "lo", "hi")


def _pair_sides(streams: DataFrame) -> DataFrame:
    """Each pair (one, two) of an episode's streams with every row of both; query marks those of the smaller stream."""
    sizes = streams.groupBy("ep", "stream").agg(F.count("*").alias("n"))
    a, b = sizes.alias("a"), sizes.alias("b")
    pairs = a.join(b, (F.col("a.ep") == F.col("b.ep")) & (F.col("a.stream") < F.col("b.stream")))
    swap = F.col("a.n") > F.col("b.n")
    pairs = pairs.select(F.col("a.ep").alias("ep"), F.col("a.stream").alias("one"), F.col("b.stream").alias("two"), F.when(swap, F.col("b.stream")).otherwise(F.col("a.stream")).alias("base"))
    sides = pairs.select("ep", "one", "two", "base", F.explode(F.array("one", "two")).alias("stream"))
    return streams.join(sides, ["ep", "stream"]).withColumn("query", F.col("stream") == F.col("base"))


def sensor_offsets(streams: DataFrame, bucket: float | None = None) -> DataFrame:
    """Signed offset (ms) from each time of the smaller stream to the nearest of the other, ties to the earlier.

    Every pair of an episode's streams; two running windows over the union of both. With ``bucket``
    (seconds) a pair is dealt by time buckets, so that a long stream is many tasks: the last time of
    the other stream before a bucket and the first after it come from a table of a row a bucket.
    """
    rows, pair = _pair_sides(streams), ["ep", "one", "two"]
    other = F.when(~F.col("query"), F.col("t"))
    if bucket is None:
        keys, rows = pair, rows.withColumns({"before": F.lit(None).cast("double"), "after": F.lit(None).cast("double")})
    else:
        keys, rows = [*pair, "slot"], rows.withColumn("slot", F.floor(F.col("t") / bucket))
        ends = rows.groupBy(*keys).agg(F.min(other).alias("least"), F.max(other).alias("most"))
        along = Window.partitionBy(*pair).orderBy("slot")
        ends = ends.select(*keys, F.max("most").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("least").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
        rows = rows.join(ends, keys)
    upto = lambda order: Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    back, ahead = F.max(other).over(upto(F.asc("t"))), F.min(other).over(upto(F.desc("t")))  # both run once over the stream
    rows = rows.withColumn("back", back).withColumn("ahead", ahead).filter("query")
    rows = rows.withColumns({"back": F.coalesce("back", "before"), "ahead": F.coalesce("ahead", "after")})
    near = F.when(F.col("back").isNull(), F.col("ahead")).when(F.col("ahead").isNull() | (F.col("t") - F.col("back") <= F.col("ahead") - F.col("t")), F.col("back")).otherwise(F.col("ahead"))
    return rows.select("ep", "one", "two", "t", ((near - F.col("t")) * 1000).alias("offset"))


def sensor_sync_pairs(streams: DataFrame, bucket: float | None = None) -> DataFrame:
    """Offsets of every pair of an episode's streams, in milliseconds; ``bucket`` as in ``sensor_offsets``."""
    rows = sensor_offsets(streams, bucket).withColumn("size", F.abs("offset"))
    got = rows.groupBy("ep", "one", "two").agg(F.count("*").alias("n"), F.avg("offset").alias("offset_mean"), F.stddev_pop("offset").alias("offset_std"), percentiles("size", 0.5, 0.95, 0.99).alias("p"), F.max("size").alias("offset_max"), F.median("offset").alias("signed_median"))
    return got.select("ep", "one", "two", "n", "offset_mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "offset_max", "offset_std", "signed_median")


def sensor_sync(streams: DataFrame) -> DataFrame:
    """The worst pair of each episode; an episode with one stream has no row: not available."""
    return sensor_sync_pairs(streams).groupBy("ep").agg(F.count("*").alias("pairs"), F.max("p95").alias("worst_p95"), F.max("offset_max").alias("worst_max"))
