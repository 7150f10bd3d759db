"""Sessionization, hour activity and per-segment aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymill.functions.text import sentence_norm
from daymill.operators import hours as H
from daymill.operators import sessions as S
from daymill.operators import stats as ST
from daymill.operators.filters import eligible_hours
from daymill.plans.catalog.base import TS, query
from daymill.plans.day import DayJob
from daymill.sources import samples as A


def job(spark, sf):
    return DayJob(A.events(spark, sf))


_JOBS: dict[tuple[str, str], DayJob] = {}


def text_job(spark, sf):
    """The day job with text; its stage tables serve every query of one session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _JOBS:
        _JOBS[key] = DayJob(A.events_with_text(spark, sf), lookup=A.text_lookup(spark, sf))
    return _JOBS[key]


@query("d1_sessionize", f"""
SELECT source_id, CAST(day AS VARCHAR) AS day, seq AS ingest_seq, strftime(ts, {TS}) AS ts, seg AS segment_id, dur AS duration_sec FROM ses""")
def d1(spark, sf):
    return job(spark, sf).sessions.select("source_id", "day", "ingest_seq", "ts", "segment_id", "duration_sec")


@query("d2_segments", f"""
SELECT source_id, CAST(day AS VARCHAR) AS day, seg AS segment_id, strftime(start_ts, {TS}) AS start_ts, strftime(end_ts, {TS}) AS end_ts,
  duration_sec, captures, app AS active_app, dom AS domain, '' AS window_title, label FROM segt""")
def d2(spark, sf):
    return job(spark, sf).segments


@query("d3_trace_events", """
SELECT source_id, CAST(day AS VARCHAR) AS day, seq AS ingest_seq, id, seg AS segment_id, label AS segment_label FROM tr""")
def d3(spark, sf):
    return job(spark, sf).trace.select("source_id", "day", "ingest_seq", "id", "segment_id", "segment_label")


@query("d4_default_interval", "SELECT source_id, CAST(day AS VARCHAR) AS day, CAST(d AS BIGINT) AS default_interval_sec FROM dflt")
def d4(spark, sf):
    return S.default_interval(A.events(spark, sf))


@query("d5_effective_interval", """
SELECT source_id, CAST(day AS VARCHAR) AS day, seq AS ingest_seq, dur AS duration_sec FROM tm""")
def d5(spark, sf):
    return job(spark, sf).timed.select("source_id", "day", "ingest_seq", "duration_sec")


@query("d1_single_log", f"""
WITH a AS (SELECT CAST(ts AS DATE) AS day, (event_id * 7919) % 100003 AS seq, ts, event_type AS app FROM events WHERE event_type <> 'error'),
b AS (SELECT *, CASE WHEN lag(app) OVER w IS NULL OR lag(app) OVER w <> app
   OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 750000000 THEN 1 ELSE 0 END AS brk
   FROM a WINDOW w AS (PARTITION BY day ORDER BY ts, seq))
SELECT CAST(day AS VARCHAR) AS day, strftime(ts, {TS}) AS ts,
  CAST(sum(brk) OVER (PARTITION BY day ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment_id FROM b""")
def d1_single(spark, sf):
    """One log holding every row: the shape of the worst hot key."""
    ev = (
        A.events(spark, sf).withColumn("source_id", F.lit("all")).withColumn("interval_sec", F.lit(300))
        .withColumn("ingest_seq", (F.col("ingest_seq") * 7919) % 100003).withColumn("excluded", F.lit(False))
        .withColumn("browser", F.when(F.lit(False), F.col("browser")))
    )
    return S.sessionize(ev).select("day", "ts", "segment_id")


@query("g1_running_segment_id", """
SELECT source_id, CAST(day AS VARCHAR) AS day, count(*) AS segments, max(seg) AS last_segment_id, min(seg) AS first_segment_id
FROM segt GROUP BY ALL""")
def g1(spark, sf):
    return job(spark, sf).sessions.groupBy("source_id", "day").agg(
        F.count_distinct("segment_id").alias("segments"), F.max("segment_id").alias("last_segment_id"),
        F.min("segment_id").alias("first_segment_id"))


@query("e5_hourly_active", """
SELECT source_id, CAST(day AS VARCHAR) AS day, strftime(hr, '%Y-%m-%dT%H:00:00') || '+00:00' AS hour_start_ts,
  strftime(hr, '%Y-%m-%dT%H:59:59') || '+00:00' AS hour_end_ts, active_sec AS active_sec_est FROM hours""")
def e5(spark, sf):
    return job(spark, sf).hours.drop("hour_key")


@query("e9_time_by_task", """
SELECT source_id, CAST(day AS VARCHAR) AS day, title, sec AS duration_sec, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY source_id, day ORDER BY sec DESC, first_seg) AS rank FROM (
  SELECT source_id, day, label AS title, CAST(sum(duration_sec) AS BIGINT) AS sec, min(seg) AS first_seg FROM segt GROUP BY ALL)) WHERE rank <= 3""")
def e9(spark, sf):
    return ST.time_by_task(job(spark, sf).segments)


@query("e10_time_by_app", """
SELECT source_id, CAST(day AS VARCHAR) AS day, app AS active_app, CASE WHEN grouping(label) = 1 THEN '*' ELSE label END AS label,
  CAST(sum(duration_sec) AS BIGINT) AS duration_sec, CAST(sum(captures) AS BIGINT) AS captures
FROM segt GROUP BY GROUPING SETS ((source_id, day, app), (source_id, day, app, label))""")
def e10(spark, sf):
    return ST.time_by_app(job(spark, sf).segments)


@query("e11_time_by_domain", """
SELECT source_id, CAST(day AS VARCHAR) AS day, dom AS domain, CAST(sum(duration_sec) AS BIGINT) AS duration_sec,
 CAST(sum(captures) AS BIGINT) AS captures FROM segt GROUP BY ALL""")
def e11(spark, sf):
    return ST.time_by_domain(job(spark, sf).segments)


@query("e12_capture_counts", """
SELECT source_id, CAST(day AS VARCHAR) AS day, count(*) AS total, count(*) FILTER (WHERE NOT excl AND NOT err) AS valid,
 count(*) FILTER (WHERE excl) AS excluded, count(*) FILTER (WHERE err) AS errors FROM ev GROUP BY ALL""")
def e12(spark, sf):
    return ST.capture_counts(A.events(spark, sf))


@query("e13_record_period", f"""
SELECT source_id, CAST(day AS VARCHAR) AS day, strftime(min(ts), {TS}) AS first_ts, strftime(max(ts), {TS}) AS last_ts,
 CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS wall_sec FROM ev GROUP BY ALL""")
def e13(spark, sf):
    return ST.record_period(A.events(spark, sf))


@query("e14_capture_stats", f"""
SELECT source_id, CAST(day AS VARCHAR) AS day, count(*) AS captures, strftime(arg_max(ts, seq), '%y/%m/%d ') ||
 CAST(extract(hour FROM arg_max(ts, seq)) AS VARCHAR) || strftime(arg_max(ts, seq), ':%M') AS last_seen FROM ev GROUP BY ALL""")
def e14(spark, sf):
    return ST.capture_stats(A.events(spark, sf))


@query("e15_day_totals", """
SELECT h.source_id, CAST(h.day AS VARCHAR) AS day, h.a AS all_sec, COALESCE(s.v, 0) AS valid_sec FROM
 (SELECT source_id, day, CAST(sum(active_sec) AS BIGINT) AS a FROM hours GROUP BY ALL) h LEFT JOIN
 (SELECT source_id, day, CAST(sum(duration_sec) AS BIGINT) AS v FROM segt GROUP BY ALL) s
 ON h.source_id = s.source_id AND h.day = s.day""")
def e15(spark, sf):
    j = job(spark, sf)
    return ST.day_totals(j.segments, j.hours)


@query("b6_eligible_hours", """
SELECT source_id, CAST(day AS VARCHAR) AS day, strftime(hr, '%H') AS hour, active_sec AS active_sec_est FROM (
 SELECT *, row_number() OVER (PARTITION BY source_id, day ORDER BY active_sec DESC, hr) AS rn FROM hours WHERE active_sec >= 800)""")
def b6(spark, sf):
    kept = eligible_hours(job(spark, sf).hours, ["source_id", "day"], min_sec=800)
    return kept.select("source_id", "day", F.substring("hour_start_ts", 12, 2).alias("hour"), "active_sec_est")


@query("g2_top_k_per_group", """
SELECT source_id, CAST(day AS VARCHAR) AS day, seg AS segment_id, duration_sec, rank FROM (SELECT *, row_number() OVER
 (PARTITION BY source_id, day ORDER BY duration_sec DESC, seg) AS rank FROM segt) WHERE rank <= 5""")
def g2(spark, sf):
    from daymill.operators.ordered import top_k

    return top_k(job(spark, sf).segments, ["source_id", "day"], [F.desc("duration_sec"), F.col("segment_id")], 5).select(
        "source_id", "day", "segment_id", "duration_sec", "rank")


# ---- text stages -----------------------------------------------------------

@query("e1_sentence_counts", """
SELECT source_id, CAST(day AS VARCHAR) AS day, seg AS segment_id, display, md5(norm) AS norm_md5, entries, md5(sent) AS first_md5 FROM cnt""")
def e1(spark, sf):
    return text_job(spark, sf).counts.select(
        "source_id", "day", "segment_id", F.col("display").cast("int").alias("display"),
        F.md5(sentence_norm(F.col("text"))).alias("norm_md5"), "entries", F.md5("text").alias("first_md5"))


@query("e2_segment_common_texts", """
SELECT source_id, CAST(day AS VARCHAR) AS day, seg AS segment_id, display, rank, sent AS text, entries FROM common""")
def e2(spark, sf):
    return text_job(spark, sf).common_texts


@query("e3_segment_new_texts", """
SELECT source_id, CAST(day AS VARCHAR) AS day, seg AS segment_id, display, seq AS ingest_seq, id, active AS is_active_display,
 md5(txt) AS text_md5, length(txt) AS text_chars FROM newt""")
def e3(spark, sf):
    return text_job(spark, sf).new_texts.select(
        "source_id", "day", "segment_id", "display", "ingest_seq", "id", "is_active_display",
        F.md5("ocr_text").alias("text_md5"), F.length("ocr_text").alias("text_chars"))


@query("e4_segment_span", f"""
SELECT source_id, CAST(day AS VARCHAR) AS day, seg AS segment_id, strftime(min(ts), {TS}) AS first_ts, strftime(max(ts), {TS}) AS last_ts,
 count(*) AS events FROM tr WHERE seg IS NOT NULL GROUP BY ALL""")
def e4(spark, sf):
    from daymill.operators.texts import segment_span

    return segment_span(job(spark, sf).trace)


@query("e6_hour_common_texts", """
SELECT source_id, CAST(day AS VARCHAR) AS day, strftime(hr, '%H') AS hour, rank, txt AS text, places FROM hcom""")
def e6(spark, sf):
    return text_job(spark, sf).hour_common.select(
        "source_id", "day", F.date_format("hour_key", "HH").alias("hour"), "rank", "text", "places")


@query("e7_hour_clusters", """
SELECT source_id, CAST(day AS VARCHAR) AS day, strftime(hr, '%H') AS hour, rank, label, active_sec,
 array_to_string(segs, '|') AS segment_ids FROM clu""")
def e7(spark, sf):
    return text_job(spark, sf).clusters.select(
        "source_id", "day", F.date_format("hour_key", "HH").alias("hour"), "rank", "label", "active_sec", "segment_ids")


@query("e8_active_timeline", f"""
SELECT source_id, CAST(day AS VARCHAR) AS day, strftime(hr, '%H') AS hour, rank, id, seg AS segment_id, strftime(ts, {TS}) AS ts,
 md5(trim(txt)) AS text_md5 FROM tl""")
def e8(spark, sf):
    return text_job(spark, sf).timeline.select(
        "source_id", "day", F.date_format("hour_key", "HH").alias("hour"), "rank", "id", "segment_id", "ts",
        F.md5("ocr_text").alias("text_md5"))


@query("f3_active_interval_by_id", """
SELECT a.source_id, CAST(a.day AS VARCHAR) AS day, a.seq AS ingest_seq, a.id, CAST(COALESCE(i.id_sec, a.d) AS BIGINT) AS id_sec
FROM val a LEFT JOIN ivlid i ON a.source_id = i.source_id AND a.day = i.day AND a.id = i.id""")
def f3(spark, sf):
    j = job(spark, sf)
    from daymill.operators.filters import valid_events

    return valid_events(j.timed).join(H.interval_by_id(j.timed), ["source_id", "day", "id"], "left").select(
        "source_id", "day", "ingest_seq", "id", F.coalesce("id_sec", F.col("default_interval_sec").cast("long")).alias("id_sec"))
