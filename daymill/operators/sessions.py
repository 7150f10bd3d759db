"""Sessionization: segments of one context per source and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions import text as T
from daymill.functions.timefmt import effective_interval
from daymill.operators.filters import valid_events
from daymill.operators.ordered import GROUP, SLICE_SEC, number_runs


def default_interval(events: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """The day's default: the interval of the last line in log order, else 300."""
    last = F.max_by(F.col("interval_sec").try_cast("int"), "ingest_seq")
    return events.groupBy(*group).agg(
        F.coalesce(F.nullif(last, F.lit(0)), F.lit(K.DEFAULT_INTERVAL_SEC)).alias("default_interval_sec")
    )


def with_effective_interval(events: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Adds ``default_interval_sec`` and ``duration_sec`` to every event."""
    return events.join(default_interval(events, group), list(group)).withColumn(
        "duration_sec", effective_interval(F.col("interval_sec"), F.col("default_interval_sec")).cast("long")
    )


def gap_limit(default_sec: Column) -> Column:
    return F.greatest(F.lit(K.MIN_GAP_SEC), F.floor(default_sec * K.GAP_FACTOR))


def with_context(events: DataFrame) -> DataFrame:
    """Adds ``segment_key`` (app, domain, whole title) and ``segment_label`` (with the title shortened)."""
    app = T.strip_ws(T.text_of(F.col("active_app")))
    domain = T.strip_ws(T.text_of(F.col("browser.domain")))
    title = T.collapse(F.col("window_title"))
    return (
        events.withColumn("_app", app).withColumn("_dom", domain).withColumn("_title", title)
        .withColumn("segment_key", F.struct(F.col("_app").alias("app"), F.col("_dom").alias("domain"), F.col("_title").alias("title")))
        .withColumn("segment_label", T.context_label(F.col("_app"), F.col("_dom"), T.shorten(F.col("_title"))))
        .drop("_app", "_dom", "_title")
    )


def sessionize(events: DataFrame, group: Sequence[str] = GROUP, slice_sec: int = SLICE_SEC) -> DataFrame:
    """Valid events with ``segment_id`` (0-based per group), key, label and duration.

    A segment ends when the key changes or the time since the previous event exceeds
    ``max(120, 2.5 * default interval)``.
    """
    return sessionize_timed(with_effective_interval(events, group), group, slice_sec)


def sessionize_timed(timed: DataFrame, group: Sequence[str] = GROUP, slice_sec: int = SLICE_SEC) -> DataFrame:
    """:func:`sessionize` for events that have their durations."""
    ready = with_context(valid_events(timed))
    return number_runs(
        ready, F.col("segment_key"), gap_limit(F.col("default_interval_sec")), group=group, slice_sec=slice_sec
    )


def segment_table(sessions: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """One row per segment; the end is the last event plus that event's interval."""
    at = F.struct("ts", "ingest_seq")
    last = F.max_by(F.struct("ts", "duration_sec"), at)
    seg = sessions.groupBy(*group, "segment_id").agg(
        F.min("ts").alias("start_ts"), last.alias("_last"), F.sum("duration_sec").alias("duration_sec"),
        F.count(F.lit(1)).alias("captures"), F.first("segment_key").alias("_key"),
        F.first("segment_label").alias("label"),
    )
    end = F.col("_last.ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_last.duration_sec").cast("decimal(18,6)"))
    app = F.when(F.col("_key.app") == "", K.UNKNOWN_LABEL).otherwise(F.col("_key.app"))
    return seg.select(
        *group, "segment_id", "start_ts", end.alias("end_ts"), "duration_sec", "captures",
        app.alias("active_app"), F.col("_key.domain").alias("domain"), F.col("_key.title").alias("window_title"), "label",
    )


def trace_events(sessions: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Events with the segment their id resolves to.

    A blank id resolves to nothing; a repeated id resolves to the last segment holding
    it.  Only ids seen in more than one segment travel to the join.
    """
    by = [*group, "id"]
    named = F.coalesce(F.col("id"), F.lit("")) != ""
    moved = (
        sessions.filter(named).groupBy(*by)
        .agg(F.max_by(F.struct("segment_id", "segment_label"), "segment_id").alias("_to"), F.min("segment_id").alias("_lo"))
        .filter(F.col("_to.segment_id") > F.col("_lo")).drop("_lo")
    )
    return (
        sessions.join(moved, by, "left")
        .withColumn("segment_id", F.when(named, F.coalesce("_to.segment_id", "segment_id")))
        .withColumn("segment_label", F.when(named, F.coalesce("_to.segment_label", "segment_label")).otherwise(F.lit("")))
        .drop("_to")
    )
