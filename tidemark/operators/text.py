"""Words for people: what was seen in an episode, why it may be, what to do next; the dataset's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.report import audit_summary, dataset_health, patterns, reasons, top_observations

# pattern: (why, next). Findings are signals of statistics and never labels.
ADVICE = {
    "STUCK_LIKE": ("Long and with little motion: a signal, no proof of a blockage.", "Look at the trajectory and see if the still part is expected."),
    "FROZEN_LIKE": ("Almost no motion: waiting and failure look the same in the figures.", "Review by hand; do not leave it out for this alone."),
    "JITTERY_LIKE": ("Many jumps of the action: control, noise or a sharp but valid move.", "Check how smooth the actions are and how the controller is set."),
    "INEFFICIENT": ("A long way to the end: it may be a valid variant of the task.", "Compare the path with the task before recording it anew."),
    "UNUSUAL": ("An unusual course: rare but maybe valid.", "Look at the trajectory and confirm that it is valid."),
}
NOTHING = ("No pattern stands out.", "Weigh what is known before deciding.")


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.concat(F.bround(100 * share, 0).cast("long").cast("string"), F.lit("%"))


def said(duration: Column, spikes: Column, low_motion: Column, pattern: Column) -> tuple[Column, Column, Column]:
    """what was seen, why it may be and what to do next, by an episode's strongest pattern."""
    parts = F.concat_ws(
        ", ",
        F.when(duration > 0, F.format_string("duration = %.2fs", duration)),
        F.when(spikes > 0, F.format_string("%d action spikes", spikes.cast("long"))),
        F.concat(F.lit("effective motion = "), percent(1 - low_motion)),
    )

    def advice(place: int) -> Column:
        table = F.create_map(*[F.lit(x) for name, words in ADVICE.items() for x in (name, words[place])])
        return F.coalesce(F.try_element_at(table, pattern), F.lit(NOTHING[place]))

    return F.concat(F.lit("Episode "), parts, F.lit(".")), advice(0), advice(1)


def diagnosis(audit: DataFrame) -> DataFrame:
    """ep, what, why, next of each episode, by its strongest pattern."""
    r = reasons()
    what, why, following = said(r["duration"], r["spikes"], r["low_motion"], F.col("pattern"))
    rows = audit.withColumn("pattern", F.get(patterns(), F.lit(0))["pattern"])
    return rows.select("ep", what.alias("what"), why.alias("why"), following.alias("next"))


def described(audit: DataFrame, n: int = 5, occupancy: bool = False) -> DataFrame:
    """``report.top_observations`` with a sentence for each; one more pass gives the figures that sentences name.

    A metric without a sentence of its own tells how many episodes it touches.
    """
    figures = audit.agg(
        F.count("*").alias("n"),
        F.median("worst_p95").alias("sync"),
        F.coalesce(F.sum("spike_count"), F.lit(0)).cast("long").alias("spikes"),
        F.median("occupancy_rate").alias("occupied"),
        F.median("idle_ratio").alias("idle"),
        F.lit(1).alias("one"),
    )
    share = percent(F.col("ratio"))
    of = F.format_string("in %d of %d episode(s)", "episodes", "n")
    words = {
        "missing_dropout": F.concat(F.lit("Frames or features are missing "), of),
        "invalid_values": F.concat(F.lit("Values that are NaN or infinite "), of),
        "schema_consistency": F.concat(F.lit("Features of another length or shape "), of),
        "timestamp_validity": F.concat(F.lit("Time runs backward "), of),
        "joint_limit": F.concat(F.lit("Joints beyond their limits "), of),
        "sensor_synchronization": F.when(F.col("episodes") == 0, "Sensor offsets: no episode has time stamps by stream").otherwise(F.concat(F.format_string("Sensor offsets: the median of the p95 is %.1f ms, known ", "sync"), of)),
        "action_discontinuity": F.concat(F.format_string("%d jump(s) of the action ", "spikes"), of, F.lit(": a signal of statistics, no proof of damage")),
        "state_space_occupancy": F.format_string("A median of %.1f%% of the state cells is occupied", 100 * F.col("occupied")),
        "idle_ratio": F.format_string("A median of %.1f%% of the steps is idle", 100 * F.col("idle")),
    }
    sentence = F.concat("observation", F.lit(": "), of, F.lit(" ("), share, F.lit(")"))
    for name, said_of_it in words.items():
        sentence = F.when(F.col("observation") == name, said_of_it).otherwise(sentence)
    rows = top_observations(audit, n, occupancy).withColumn("one", F.lit(1)).join(F.broadcast(figures), "one")  # figures: one row
    return rows.select("rank", "observation", "significance", sentence.alias("description"))


def summary(audit: DataFrame) -> str:
    """The dataset's report as text. Only single rows and the five top findings come to the driver."""
    counts, health = audit_summary(audit).first(), dataset_health(audit).first()
    if not counts["episodes"]:
        return "No episodes."
    lines = [f"Episodes: {counts['episodes']}", f"PASS {counts['passed']}  REVIEW {counts['review']}  EXCLUDE {counts['excluded']}  (pass rate {counts['pass_rate']:.1%})"]
    lines.append(f"Health: {health['health']} ({health['grade']}), {health['readiness']}; after a clean-up {health['after_cleanup']}")
    lines += [f"{r['rank']}. {r['observation']} ({r['significance']}): {r['episodes']} episodes ({r['ratio']:.1%})" for r in top_observations(audit).orderBy("rank").collect()]
    return "\n".join(lines)
