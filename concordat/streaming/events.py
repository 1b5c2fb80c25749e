"""Stage events as a stream: running outcomes, and windows (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat import schema
from concordat.operators import metrics


def worst_outcomes(events: DataFrame, key: str = "run_id") -> DataFrame:
    """The gravest outcome of each run so far; state is one number per run. Batch or stream."""
    rank = {n: i for i, n in enumerate(schema.OUTCOMES)}
    per = events.groupBy(key).agg(F.max(metrics.severity(rank, "outcome")).alias("rank"), F.count("*").alias("events"))
    return per.select(key, metrics.outcome_of("rank", schema.OUTCOMES).alias("outcome"), "events")


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts per key and window; events later than `late` behind the newest are dropped and
    closed windows leave the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide or size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with no gap longer than `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
