"""The user's own metrics, and thresholds other than the built-in ones.

A metric is anything with a ``name`` and a ``compute`` that takes frames and gives ep, availability,
status and score; ``passed``, ``review``, ``exclude``, ``not_available`` and ``error`` make such results as
columns, all five with the same fields, so that ``F.when`` can choose among them. ``PythonMetric`` wraps a function of one episode's pandas frame; an episode for
which it raises has availability 'error', which no verdict counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import verdict

COLUMNS = ("ep", "metric", "availability", "status", "score")


class Metric(Protocol):
    name: str

    def compute(self, frames: DataFrame) -> DataFrame:
        """ep, availability (available, not_available, error), status (pass, review, exclude, na), score of each episode."""


def _made(name: str, availability: str, status: str, measurement: Column | None, severity: str | None, reason: str | Column, message: str | Column, otherwise: float) -> Column:
    figures = F.create_map().cast("map<string,double>") if measurement is None else measurement.cast("map<string,double>")
    words = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(
        F.lit(name).alias("metric"),
        F.lit(availability).alias("availability"),
        F.lit(status).alias("status"),
        F.lit(severity).cast("string").alias("severity"),
        words(reason).alias("reason"),
        words(message).alias("message"),
        figures.alias("measurement"),
        F.lit(status == "pass").alias("passed"),
        F.lit(status in ("review", "exclude")).alias("has_finding"),
        F.coalesce(F.try_element_at(figures, F.lit("score_compat")), F.lit(otherwise)).alias("score"),
    )


def passed(name: str, measurement: Column | None = None, message: str | Column = "", severity: str | None = None) -> Column:
    """A result, as a column of an episode's row, that is fine: score 1, or the measurement's score_compat."""
    return _made(name, "available", "pass", measurement, severity, F.lit(None).cast("string"), message, 1.0)


def review(name: str, measurement: Column | None = None, reason: str | Column = "", message: str | Column = "", severity: str = "medium") -> Column:
    """A finding that asks for review: score 0.5, or the measurement's score_compat."""
    return _made(name, "available", "review", measurement, severity, reason, message, 0.5)


def exclude(name: str, reason: str | Column = "", message: str | Column = "") -> Column:
    """A certain error: a finding without measurement, of high severity and score 0."""
    return _made(name, "available", "exclude", None, "high", reason, message, 0.0)


def not_available(name: str, reason: str | Column = "", message: str | Column = "") -> Column:
    """No data to judge by: no finding, score 0."""
    return _made(name, "not_available", "na", None, None, reason, message, 0.0)


def error(name: str, reason: str | Column = "", message: str | Column = "") -> Column:
    """The computation failed: skipped, of high severity, no finding, score 0."""
    return _made(name, "error", "skipped", None, "high", reason, message, 0.0)


@dataclass(frozen=True)
class PythonMetric:
    """``function`` gets the frames of an episode in order and returns (status, score), or None where it cannot tell."""

    name: str
    function: Callable[[pd.DataFrame], tuple[str, float] | None]

    def compute(self, frames: DataFrame) -> DataFrame:
        function = self.function

        def judge(episode: pd.DataFrame) -> pd.DataFrame:
            try:
                got = function(episode.sort_values("fi"))
                answer = ("available", *got) if got is not None else ("not_available", "na", 0.0)
            except Exception:  # one episode's failure must not end the audit
                answer = ("error", "na", 0.0)
            return pd.DataFrame([(int(episode["ep"].iloc[0]), *answer)], columns=["ep", "availability", "status", "score"])

        return frames.groupBy("ep").applyInPandas(judge, "ep long, availability string, status string, score double")


def compute_all(frames: DataFrame, own: Iterable[Metric]) -> DataFrame:
    """The results of all ``own`` metrics, as ``verdict.judged`` takes them."""
    parts = [m.compute(frames).withColumn("metric", F.lit(m.name)).select(*COLUMNS) for m in own]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def audit(frames: DataFrame, own: Iterable[Metric] = (), critical: tuple[str, ...] = verdict.CRITICAL, review: tuple[str, ...] = verdict.REVIEW, **side: DataFrame) -> DataFrame:
    """The audit with the user's metrics beside the built-in ones; ``critical`` and ``review`` say which decide. ``side``: streams, limits."""
    own = list(own)
    return verdict.judged(verdict.scalars(frames, **side), compute_all(frames, own) if own else None, critical, review)
