"""Hour packs: activity, shared texts, main contexts and their timelines per hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions import text as T
from daymill.functions.timefmt import hour_end_text, hour_key, hour_start, iso_text
from daymill.operators.ordered import GROUP, top_k
from daymill.session import dealt

HOUR = [*GROUP, "hour_key"]
HOUR_ORDER = ["hour_key"]


def with_hour(df: DataFrame) -> DataFrame:
    """Adds ``hour_key``: the local hour's start as an instant."""
    return df.withColumn("hour_key", hour_key(F.col("local_ts"), F.col("tz_offset_sec")))


def hourly_active_seconds(timed: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Seconds per hour over all readable events, excluded and failed ones too.

    The label of an hour is the local hour of the first event seen in it.
    """
    label = iso_text(hour_start(F.col("local_ts")), F.col("tz_offset_sec"))
    rows = with_hour(timed.filter(F.col("ts").isNotNull())).withColumn("_label", label)
    out = rows.groupBy(*group, "hour_key").agg(
        F.sum("duration_sec").cast("long").alias("active_sec_est"), F.min_by("_label", "ingest_seq").alias("hour_start_ts"))
    return out.withColumn("hour_end_ts", hour_end_text(F.col("hour_start_ts")))


def hour_common_texts(new_texts: DataFrame, common: DataFrame, limit: int | None = None) -> DataFrame:
    """Texts common to the segments active in an hour, by number of (segment, display).

    ``new_texts`` tells in which hours a (segment, display) puts something out.
    """
    place = [*GROUP, "segment_id", "display"]
    live = (
        with_hour(new_texts).groupBy(*HOUR, "segment_id", "display")
        .agg(F.min(F.struct("ts", "ingest_seq")).alias("_at"))
    )
    # keys of fixed size: two hashes of the normal form, which is made again from the text where it orders the result
    norm = T.common_text_norm(F.col("text"))
    norms = (
        common.withColumn("norm", norm).filter(F.col("norm") != "")
        .groupBy(*place, F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))
        .agg(F.min(F.struct("rank", "text")).alias("_t"))
    )
    seen = F.struct("segment_id", "display", F.col("_t.rank").alias("rank"), F.col("_t.text").alias("text"))
    counted = live.join(norms, place).groupBy(*HOUR, "h1", "h2").agg(
        F.count(F.lit(1)).alias("places"), F.min(seen).alias("_first"))
    counted = counted.withColumn("norm", T.common_text_norm(F.col("_first.text")))
    ranked = top_k(
        counted, HOUR,
        [F.desc("places"), F.desc(F.length("_first.text")), F.col("_first"), F.col("norm")], limit,
    )
    return ranked.select(*HOUR, "rank", F.col("_first.text").alias("text"), "places")


def interval_by_id(timed: DataFrame) -> DataFrame:
    """Interval of an event id; the last row holding it wins."""
    named = timed.filter(F.coalesce(F.col("id"), F.lit("")) != "")
    return named.groupBy(*GROUP, "id").agg(F.max_by("duration_sec", "ingest_seq").alias("id_sec"))


def active_events(new_texts: DataFrame) -> DataFrame:
    return with_hour(new_texts.filter(F.col("is_active_display")))


def hour_clusters(new_texts: DataFrame, intervals: DataFrame, limit: int | None = None) -> DataFrame:
    """Contexts of an hour by the seconds of their distinct active-display events."""
    seg = (
        active_events(new_texts).groupBy(*HOUR, "segment_key", "id")
        .agg(F.collect_set("segment_id").alias("_ids"))
        .join(intervals, [*GROUP, "id"], "left")
        .groupBy(*HOUR, "segment_key")
        .agg(F.sum("id_sec").cast("long").alias("active_sec"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_set("_ids")))).alias("segment_ids"))
        .withColumn("label", T.key_label(F.col("segment_key")))
    )
    return top_k(seg, HOUR, [F.desc("active_sec"), F.col("label"), F.col("segment_key")], limit)


def _cluster_events(new_texts: DataFrame, clusters: DataFrame) -> DataFrame:
    return active_events(new_texts).join(clusters.select(*HOUR, "segment_key", "rank"), [*HOUR, "segment_key"])


def active_timeline(new_texts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Events of the kept contexts in time order, one per id, blank text left out."""
    return timeline_rows(_one_per_id(_cluster_events(new_texts, clusters)))


def _one_per_id(rows: DataFrame) -> DataFrame:
    return top_k(rows, [*HOUR, "segment_key", "id"], [F.col("ts"), F.col("ingest_seq")], 1, "_n")


def first_shown(places: DataFrame, clusters: DataFrame) -> DataFrame:
    """The events that :func:`active_timeline` shows, chosen without their text, and the rows that ``ties`` at their place (above one
    where events repeat)."""
    by = Window.partitionBy(*HOUR, "segment_key", "id")
    order = by.orderBy("ts", "ingest_seq")
    tied = _cluster_events(places, clusters).withColumn("_n", F.rank().over(order)).filter("_n = 1")
    return tied.withColumn("ties", F.count(F.lit(1)).over(by)).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def timeline_of_shown(once: DataFrame, tied: DataFrame) -> DataFrame:
    """:func:`active_timeline` of the events of :func:`first_shown` with their text; only those that tie are shuffled again."""
    return timeline_rows(with_hour(once)).unionByName(timeline_rows(_one_per_id(with_hour(tied))))


def timeline_rows(first: DataFrame) -> DataFrame:
    return first.filter(F.trim("ocr_text") != "").select(
        *HOUR, "segment_key", "rank", "ts", "id", "segment_id", F.trim("ocr_text").alias("ocr_text"),
        iso_text(F.col("local_ts"), F.col("tz_offset_sec")).alias("event_ts"),
    )


def cluster_timelines(clusters: DataFrame, timeline: DataFrame) -> DataFrame:
    """Kept contexts with a nested timeline; a context without one is dropped."""
    per = timeline.groupBy(*HOUR, "segment_key").agg(F.array_sort(F.collect_list(F.struct(
        "ts", "id", F.col("event_ts"), "segment_id", "ocr_text"))).alias("_t"))
    return clusters.join(per, [*HOUR, "segment_key"]).withColumn("active_timeline", _shown_lines(F.col("_t"))).drop("_t")


def _shown_lines(lines: Column) -> Column:
    return F.transform(lines, lambda t: F.struct(
        t["event_ts"].alias("ts"), t["segment_id"].alias("segment_id"), t["ocr_text"].alias("ocr_text")))


def hour_packs(hours: DataFrame, commons: DataFrame, clusters: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row per hour with its common texts and contexts.

    Timelines stay rows; a pack carries the first text of each context only, and a
    context without a timeline is dropped.
    """
    texts = commons.groupBy(*HOUR).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_c"))
    first = timeline.groupBy(*HOUR, "segment_key").agg(F.min_by("ocr_text", F.struct("ts", "id")).alias("_first"))
    kept = clusters.join(first, [*HOUR, "segment_key"]).groupBy(*HOUR).agg(F.array_sort(F.collect_list(F.struct(
        "rank", "label", "segment_key", "segment_ids", "_first"))).alias("_k"))
    none = F.array().cast("array<string>")
    return (
        hours.join(texts, HOUR, "left").join(kept, HOUR, "left")
        .withColumn("hour_common_texts", F.coalesce(F.transform("_c", lambda c: c["text"]), none))
        .withColumn("cluster_labels", F.coalesce(F.array_distinct(F.transform("_k", lambda c: c["label"])), none))
        .withColumn("clusters", F.transform("_k", lambda c: F.struct(
            _key_array(c["segment_key"]).alias("segment_key"), c["segment_ids"].alias("segment_ids"))))
        .withColumn("observation", hour_observation(F.transform("_k", lambda c: c["_first"]), F.col("hour_common_texts")))
        .drop("_c", "_k")
    )


def _key_array(key: Column) -> Column:
    return F.array(key["app"], key["domain"], key["title"])


def hour_observation(shown: Column, common: Column) -> Column:
    """First text on screen by context order, else the first common text, shortened."""
    texts = F.concat(F.coalesce(shown, F.array().cast("array<string>")), common)
    some = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != "")
    return T.shorten(F.get(some, F.lit(0)))


def latest_by_key(labels: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """One row per key, the newest version."""
    return top_k(labels, keys, [F.desc(version)], 1, "_v").drop("_v")


def with_labels(packs: DataFrame, labels: DataFrame, enrich: DataFrame | None = None) -> DataFrame:
    """Hours with their label and, when given, their enrichment; blanks where missing."""
    cols = ["hour_title", "hour_summary", "confidence"]
    out = packs.join(latest_by_key(labels, HOUR).select(*HOUR, *cols), HOUR, "left")
    if enrich is not None:
        out = out.join(
            latest_by_key(enrich, HOUR).select(*HOUR, "hour_title_enriched", "hour_summary_enriched"), HOUR, "left")
    else:
        out = out.withColumn("hour_title_enriched", F.lit(None).cast("string")).withColumn(
            "hour_summary_enriched", F.lit(None).cast("string"))
    blank = {c: F.trim(T.text_of(F.col(c))) for c in [
        "hour_title", "hour_summary", "hour_title_enriched", "hour_summary_enriched"]}
    return out.withColumns({**blank, "confidence": F.coalesce("confidence", F.lit(0.0))})


def first_label(labels: Column) -> Column:
    return F.coalesce(F.get(labels, F.lit(0)), F.lit(""))


def hours_overview(labelled: DataFrame) -> DataFrame:
    """Title (else the first context) and a short summary; hours with neither are left out."""
    title = F.coalesce(F.nullif("hour_title", F.lit("")), first_label(F.col("cluster_labels")))
    out = labelled.withColumn("_t", title).filter((F.col("_t") != "") | (F.col("hour_summary") != ""))
    return out.select(
        *HOUR, "hour_start_ts", "hour_end_ts", F.col("_t").alias("hour_title"),
        T.shorten(F.col("hour_summary"), 120).alias("hour_summary"))


def daily_inputs(labelled: DataFrame) -> DataFrame:
    """As the overview, but an observation fills what is missing."""
    first = F.when(F.size("cluster_labels") > 0, first_label(F.col("cluster_labels"))).otherwise(F.col("observation"))
    title = F.coalesce(F.nullif("hour_title", F.lit("")), first)
    summary = F.coalesce(F.nullif("hour_summary", F.lit("")), F.col("observation"))
    out = labelled.withColumn("_t", title).withColumn("_s", summary).filter((F.col("_t") != "") | (F.col("_s") != ""))
    return out.select(
        *HOUR, "hour_start_ts", "hour_end_ts", F.floor(F.col("active_sec_est") / 60).cast("long").alias("active_min_est"),
        F.col("_t").alias("hour_title"), T.shorten(F.col("_s"), 240).alias("hour_summary"))


def hourly_model_input(packs: DataFrame, clusters: DataFrame, timeline: DataFrame) -> DataFrame:
    """The payload of a model call per hour; hours with nothing to show are left out.

    Timelines are nested here and only for the hours asked for: one hour is one payload.
    """
    some = F.coalesce(F.size("clusters") > 0, F.lit(False)) | (F.size("hour_common_texts") > 0)
    want = packs.filter(some).select(*HOUR, "active_sec_est", "hour_start_ts", "hour_end_ts", "hour_common_texts")
    line = F.struct("ts", "id", "event_ts", "segment_id", "ocr_text").alias("_t")
    texts = timeline.join(want.select(*HOUR), HOUR, "left_semi").select(*HOUR, "segment_key", line)
    held = clusters.join(want.select(*HOUR), HOUR, "left_semi").select(*HOUR, "segment_key", F.struct("rank", "segment_ids").alias("_k"))
    # contexts and their texts meet in the hour's part, so the text is shuffled once
    nested = dealt(texts.unionByName(held, allowMissingColumns=True), *HOUR).groupBy(*HOUR, "segment_key").agg(
        F.max("_k").alias("_k"), F.array_sort(F.collect_list("_t")).alias("_t")).filter(
        F.col("segment_key").isNotNull() & F.col("_k").isNotNull() & (F.size("_t") > 0))
    nested = nested.select(*HOUR, F.struct(
        "_k.rank", _key_array(F.col("segment_key")).alias("segment_key"), "_k.segment_ids", _shown_lines(F.col("_t")).alias("active_timeline")).alias("_c"))
    per_hour = nested.groupBy(*HOUR).agg(F.transform(
        F.array_sort(F.collect_list("_c")), lambda c: c.dropFields("rank")).alias("clusters"))
    empty = F.array().cast(per_hour.schema["clusters"].dataType)
    # the payloads stay in their parts: without the hint they may be taken for small and sent to the driver
    return want.join(per_hour.hint("merge"), HOUR, "left").select(
        *HOUR, "active_sec_est",
        F.to_json(F.struct(
            "hour_start_ts", "hour_end_ts", "hour_common_texts", F.coalesce("clusters", empty).alias("clusters"))).alias("payload"))


def snapshot_hours(labelled: DataFrame) -> DataFrame:
    """Final hour rows; an hour with no label and no activity is dropped."""
    keep = (F.col("hour_title") != "") | (F.col("hour_summary") != "") | (F.col("active_sec_est") > 0)
    return labelled.filter(keep).select(
        *HOUR, "hour_start_ts", "hour_end_ts", "active_sec_est", "hour_title", "hour_summary",
        "hour_title_enriched", "hour_summary_enriched", "cluster_labels", "confidence")


def hour_timeline_rows(labelled: DataFrame) -> DataFrame:
    """What a report shows per hour; an intent too close to the summary is hidden."""
    from daymill.functions.similarity import with_near_duplicate

    title = F.coalesce(
        F.nullif("hour_title", F.lit("")), F.nullif(first_label(F.col("cluster_labels")), F.lit("")), F.lit(K.UNKNOWN_HOUR))
    summary = F.coalesce(F.nullif("hour_summary", F.lit("")), F.col("observation"))
    rows = labelled.withColumn("display_title", title).withColumn("display_summary", summary).withColumn(
        "screens", F.array_join("cluster_labels", ", "))
    judged = with_near_duplicate(rows, "display_summary", "hour_summary_enriched", "_near")
    intent = (
        F.when(F.col("hour_summary_enriched") == "", F.lit(""))
        .when(F.col("_near"), F.lit(K.INTENT_HIDDEN))
        .otherwise(F.col("hour_summary_enriched"))
    )
    return judged.select(
        *HOUR, "hour_start_ts", "hour_end_ts", F.floor(F.col("active_sec_est") / 60).cast("long").alias("active_min"),
        "display_title", "display_summary", "screens", intent.alias("intent"))
