"""Report aggregates over segments, hours and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymill.functions import text as T
from daymill.functions.timefmt import last_seen_text
from daymill.operators.ordered import GROUP, top_k


def time_by_task(segments: DataFrame, k: int = 3, by: Sequence[str] = GROUP) -> DataFrame:
    """Seconds per task title (a model's title, else the label), the top ``k``."""
    title = F.col("label")
    if "task_title" in segments.columns:
        title = F.coalesce(F.nullif(F.trim(T.text_of(F.col("task_title"))), F.lit("")), F.col("label"))
    sums = segments.groupBy(*by, title.alias("title")).agg(
        F.sum("duration_sec").alias("duration_sec"), F.min("segment_id").alias("_first"))
    return top_k(sums, by, [F.desc("duration_sec"), F.col("_first")], k).drop("_first")


def time_by_app(segments: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Seconds and captures per app and per (app, label) in one pass; ``*`` marks app totals."""
    sets = [[*by, "active_app"], [*by, "active_app", "label"]]
    out = segments.groupingSets([[F.col(c) for c in s] for s in sets], *by, "active_app", "label").agg(
        F.sum("duration_sec").alias("duration_sec"), F.sum("captures").alias("captures"),
        F.grouping("label").alias("_total"))
    return out.withColumn("label", F.when(F.col("_total") == 1, "*").otherwise(F.col("label"))).drop("_total")


def time_by_domain(segments: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    return segments.groupBy(*by, "domain").agg(
        F.sum("duration_sec").alias("duration_sec"), F.sum("captures").alias("captures"))


def capture_counts(events: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """A row can count as excluded and as failed at once."""
    off = F.coalesce(F.col("excluded"), F.lit(False))
    err = F.coalesce(F.col("has_error"), F.lit(False))
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~off & ~err).alias("valid"),
        F.count_if(off).alias("excluded"), F.count_if(err).alias("errors"))


def record_period(events: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    first, last = F.min("ts"), F.max("ts")
    return events.groupBy(*by).agg(
        first.alias("first_ts"), last.alias("last_ts"),
        F.floor((F.unix_micros(last) - F.unix_micros(first)) / 1000000).alias("wall_sec"))


def capture_stats(events: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Number of captures and the time of the last line of the log."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("captures"), last_seen_text(F.max_by("local_ts", "ingest_seq")).alias("last_seen"))


def day_totals(segments: DataFrame, hours: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Seconds of valid segments next to seconds of all events."""
    valid = segments.groupBy(*by).agg(F.sum("duration_sec").alias("valid_sec"))
    full = hours.groupBy(*by).agg(F.sum("active_sec_est").alias("all_sec"))
    return full.join(valid, list(by), "left").withColumn("valid_sec", F.coalesce("valid_sec", F.lit(0)))
