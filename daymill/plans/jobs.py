"""The day job and the week job end to end: logs to day snapshots, snapshots to week reports.

Both keep their tables in one folder.  What a model answered is appended by (source, day) or week with a growing version,
and the newest version of a key counts, so a job that stops half-way asks only for what is missing; days
and weeks that are complete stay as they are.  A day is at most its hours and a week seven days, so arrays over them are bounded.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.operators import enrich as M
from daymill.operators import filters as B
from daymill.operators import hours as H
from daymill.operators import ledger as L
from daymill.operators import stats as ST
from daymill.operators import usage as U
from daymill.operators import weekly as W
from daymill.operators.ordered import GROUP, top_k
from daymill.plans import report as R
from daymill.plans.day import DayJob
from daymill.session import staged
from daymill.sources import logs

DAY = list(GROUP)
HOUR_KEY = "source_id string, day date, hour_key timestamp_ntz, "
SNAPSHOT_HOUR = (
    "struct<hour_key:timestamp_ntz,hour_start_ts:string,hour_end_ts:string,active_sec_est:bigint,hour_title:string,hour_summary:string,"
    "hour_title_enriched:string,hour_summary_enriched:string,cluster_labels:array<string>,confidence:double>")
DAILY = "daily_title string, daily_summary string, daily_detail string, highlights array<string>, confidence double, evidence array<string>"
TABLES = {
    "hour_labels": HOUR_KEY + "hour_title string, hour_summary string, confidence double, version bigint",
    "daily": f"source_id string, day date, {DAILY}, version bigint",
    "hour_enrich": HOUR_KEY + "hour_title_enriched string, hour_summary_enriched string, version bigint",
    "calls": "source_id string, day date, stage string, model string, input_tokens bigint, cached_tokens bigint, output_tokens bigint, failed boolean, version bigint",
    "lost": "source_id string, day date, stage string, hour_key timestamp_ntz, reason string, version bigint",
    "snapshots": "source_id string, day date, version bigint, status string, incomplete_reason string, total_active_sec_est bigint, daily_status string, "
                 f"hour_enrich_status string, daily struct<{DAILY.replace(' ', ':').replace(',:', ',')}>, hours array<{SNAPSHOT_HOUR}>",
    "week_calls": "source_id string, week_start date, stage string, model string, input_tokens bigint, cached_tokens bigint, output_tokens bigint, failed boolean, version bigint",
    "week_attempts": "source_id string, week_start date, stage string, error_kind string, error string, ok boolean, ts timestamp, seq bigint",
    "week_reports": "source_id string, week_start date, report string, total_active_sec_est bigint, snapshot_status string, strategy string, summary_source string, version bigint",
}


@dataclass(frozen=True)
class Models:
    """One function per stage; the defaults are rules without a model."""

    hour: M.ModelFn = M.rule_hour_model
    day: M.ModelFn = M.rule_day_model
    enrich: M.ModelFn = M.rule_enrich_model
    cluster: M.ModelFn = W.rule_cluster_model
    week: M.ModelFn = W.rule_week_model


@dataclass(frozen=True)
class Store:
    """The tables of a job under ``base``; a table that is not there yet is empty."""

    spark: SparkSession
    base: str
    version: int = field(default_factory=lambda: time.time_ns() // 1000)

    def read(self, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        if logs.children(self.spark, path) is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def _rows(self, name: str, df: DataFrame, by: list[str]) -> DataFrame:
        columns = [c for c in self.spark.createDataFrame([], TABLES[name]).columns]
        known = df.withColumn("version", F.lit(self.version).cast("long")) if "version" in columns else df
        return known.select(*columns).repartition(*by)

    def add(self, name: str, df: DataFrame, by: list[str]) -> None:
        self._rows(name, df, by).write.mode("append").partitionBy(*by).parquet(f"{self.base}/{name}")

    def replace(self, name: str, df: DataFrame, by: list[str]) -> None:
        """Overwrite the keys that ``df`` holds and leave the others."""
        rows = staged(self._rows(name, df, by), name)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.base}/{name}")

    def note(self, p: M.ModelPass, stage: str) -> None:
        """Keep the calls of a day stage and what it lost."""
        keys = [] if "hour_key" in p.lost.columns else [F.lit(None).cast("timestamp_ntz").alias("hour_key")]
        self.add("calls", p.calls, DAY)
        self.add("lost", p.lost.select("*", *keys, F.lit(stage).alias("stage")), DAY)


# ---- day -----------------------------------------------------------------------------

def complete_days(store: Store) -> DataFrame:
    return store.read("snapshots").filter("status = 'complete'").select(*DAY)


def build_day_snapshots(
    job: DayJob, store: Store, models: Models | None = None, days: DataFrame | None = None,
    min_sec: int = K.HOUR_MIN_SEC, max_hours: int | None = None,
) -> DataFrame:
    """Label, summarise and enrich the days of ``job``, write their snapshots and return them.

    Hours labelled before are not asked for again; a day is summarised and its hours enriched when it has
    new labels or no summary yet.  A day is complete when every eligible hour has a label; ``days`` may name days that have a snapshot even without
    a log, which are complete and empty.
    """
    m = models or Models()
    packs = job.packs
    p = M.label_hours_pass(packs, job.clusters, job.timeline, store.read("hour_labels"), m.hour, DAY, min_sec, max_hours, store.version)
    fresh = staged(p.answers, "fresh_labels")
    store.add("hour_labels", fresh, DAY)
    store.note(p, "hour")
    labels = store.read("hour_labels")
    labelled = staged(H.with_labels(packs, labels), "labelled_hours")

    held = store.read("daily").select(*DAY).distinct().join(fresh.select(*DAY).distinct(), DAY, "left_anti")
    held = staged(held, "held_days")
    d = M.summarize_day_pass(H.daily_inputs(labelled).join(held, DAY, "left_anti"), m.day)
    store.add("daily", d.answers, DAY)
    store.note(d, "daily")
    daily = H.latest_by_key(store.read("daily"), DAY)

    before = store.read("hour_enrich").join(held, DAY, "left_semi")
    e = M.enrich_hours_pass(H.hours_overview(labelled), daily, before, m.enrich, DAY, store.version)
    store.add("hour_enrich", e.answers, DAY)
    store.note(e, "hour-enrich")

    asked = job.timed.select(*DAY).distinct()
    asked = asked if days is None else asked.unionByName(days.select(*DAY)).distinct()
    wanted = B.eligible_hours(packs, DAY, min_sec, max_hours)
    store.replace("snapshots", snapshot_rows(asked, full_hours(job, store), wanted, labels, daily), DAY)
    return store.read("snapshots").join(asked, DAY, "left_semi")


def full_hours(job: DayJob, store: Store) -> DataFrame:
    """Hours with the newest label and enrichment of the store."""
    return H.with_labels(job.packs, store.read("hour_labels"), store.read("hour_enrich"))


def snapshot_rows(asked: DataFrame, hours: DataFrame, wanted: DataFrame, labels: DataFrame, daily: DataFrame) -> DataFrame:
    """One row per day with its hours, status and the reason where it is incomplete."""
    rows = H.snapshot_hours(hours)
    item = F.struct(*[c for c in rows.columns if c not in DAY])
    rich = (F.col("hour_title_enriched") != "") | (F.col("hour_summary_enriched") != "")
    per = rows.groupBy(*DAY).agg(
        F.sum("active_sec_est").cast("long").alias("_sec"), F.array_sort(F.collect_list(item)).alias("hours"), F.max(rich).alias("_rich"))
    has = F.max(F.col("_has").isNotNull()).alias("_any")
    known = labels.select(*H.HOUR).distinct().withColumn("_has", F.lit(True))
    gaps = wanted.select(*H.HOUR).join(known, list(H.HOUR), "left").groupBy(*DAY).agg(F.count_if(F.col("_has").isNull()).alias("_missing"), has)
    text = [c for c in daily.columns if c not in {*DAY, "version"}]
    told = daily.select(*DAY, F.struct(*text).alias("daily"))
    gap = F.coalesce("_missing", F.lit(0))
    said = [F.trim(F.coalesce(F.col(f"daily.{c}"), F.lit(""))) != "" for c in ("daily_title", "daily_summary", "daily_detail")]
    return asked.join(per, DAY, "left").join(gaps, DAY, "left").join(told, DAY, "left").select(
        *DAY, F.when(gap > 0, "incomplete").otherwise("complete").alias("status"),
        F.when(gap == 0, "").when(F.col("_any"), F.concat(F.lit(K.HOURS_MISSING), gap.cast("string"))).otherwise(K.HOURS_UNAVAILABLE).alias("incomplete_reason"),
        F.coalesce("_sec", F.lit(0)).alias("total_active_sec_est"),
        F.when(said[0] | said[1] | said[2], "complete").otherwise("missing").alias("daily_status"),
        F.when(F.col("_rich"), "complete").otherwise("missing").alias("hour_enrich_status"),
        "daily", F.coalesce("hours", F.array().cast(f"array<{SNAPSHOT_HOUR}>")).alias("hours"))


def snapshot_logs(
    spark: SparkSession, log_path: str, base: str, where: Column | None = None, models: Models | None = None,
    force: bool = False, days: DataFrame | None = None, min_sec: int = K.HOUR_MIN_SEC,
) -> Store:
    """Logs to snapshots in one job; ``where`` names sources and days, whose folders alone are opened.

    Days with a complete snapshot are left alone unless ``force`` is set.
    """
    store = Store(spark, base)
    events, _ = logs.read_events(spark, log_path, where)
    if not force:
        done = staged(complete_days(store), "complete_days")
        events = events.join(done, DAY, "left_anti")
        days = days if days is None else days.join(done, DAY, "left_anti")
    build_day_snapshots(DayJob(events), store, models, days, min_sec)
    return store


def day_usage(store: Store, prices: DataFrame | None = None) -> DataFrame:
    """``source_id, day, usage``: usage per stage over all calls for a day."""
    return U.usage_map(store.read("calls"), U.price_table(store.spark) if prices is None else prices, DAY)


def day_reports(job: DayJob, store: Store, prices: DataFrame | None = None) -> DataFrame:
    """The report of each day of ``job`` from what the store holds, usage lines included."""
    lab = staged(full_hours(job, store), "report_hours")
    rows = H.hour_timeline_rows(lab).join(lab.select(*H.HOUR, "hour_summary"), list(H.HOUR))
    lines = R.daily_report_lines(
        ST.capture_counts(job.events), ST.record_period(job.events), ST.day_totals(job.segments, job.hours), rows,
        H.latest_by_key(store.read("daily"), DAY), day_usage(store, prices))
    return R.as_document(lines, DAY)


# ---- week ----------------------------------------------------------------------------

def whole_weeks(snapshots: DataFrame) -> DataFrame:
    """The snapshots of every week that has one, and complete empty ones for its other days."""
    weeks = W.with_week(snapshots).select(*W.WEEK).distinct()
    spine = weeks.select("source_id", F.explode(F.sequence("week_start", F.date_add("week_start", 6))).alias("day"))
    none = F.array().cast(snapshots.schema["hours"].dataType)
    return spine.join(snapshots.withColumn("_has", F.lit(True)), DAY, "left").withColumns({
        "status": F.when(F.col("_has"), F.col("status")).otherwise("complete"),
        "incomplete_reason": F.when(F.col("_has"), F.col("incomplete_reason")).otherwise(""),
        "total_active_sec_est": F.when(F.col("_has"), F.col("total_active_sec_est")).otherwise(0),
        "hours": F.when(F.col("_has"), F.col("hours")).otherwise(none)}).drop("_has")


def pending_weeks(store: Store) -> DataFrame:
    """Weeks to try again, with retries, the time of the next one and what went wrong last."""
    tries = store.read("week_attempts")
    last = top_k(tries, W.WEEK, [F.desc("ts"), F.desc("seq")], 1, "_n").select(*W.WEEK, "stage", "error")
    return L.retry_ledger(tries, W.WEEK).join(last, W.WEEK)


def build_week_reports(snapshots: DataFrame, store: Store, models: Models | None = None, force: bool = False, prices: DataFrame | None = None) -> DataFrame:
    """Write the report of every week of ``snapshots`` and return the rows of those weeks.

    A week with a report that is not pending stays as it is unless ``force`` is set.  A week with a day that is not
    usable gets no report.  Every try is a row of ``week_attempts``: a report over incomplete days or with clusters by rule is written, but stays pending.
    """
    m = models or Models()
    rates = U.price_table(store.spark) if prices is None else prices
    full = whole_weeks(snapshots)
    if not force:
        done = store.read("week_reports").select(*W.WEEK).join(pending_weeks(store).select(*W.WEEK), W.WEEK, "left_anti")
        full = W.with_week(full).join(done, W.WEEK, "left_anti").drop("week_start")
    full = staged(B.snapshot_usable(full), "week_days")
    why = F.coalesce(F.nullif("incomplete_reason", F.lit("")), F.lit("snapshot_missing"))
    bad = W.with_week(full).filter("not usable").groupBy(*W.WEEK).agg(F.min_by(why, "day").alias("error"))
    bad = staged(bad, "weeks_without_days")
    good = W.with_week(full).join(bad, W.WEEK, "left_anti").drop("week_start", "usable")
    meta, notes, items = staged(W.week_meta(good), "week_meta"), staged(W.day_notes(good), "week_notes"), staged(W.task_items(good), "week_items")

    c = W.cluster_week_tasks_pass(items, m.cluster)
    clusters, lost = staged(c.answers, "week_clusters"), staged(c.lost, "weeks_by_rule")
    s = W.summarize_week_pass(notes, m.week)
    store.add("week_calls", c.calls.unionByName(s.calls), W.WEEK)
    summary = staged(s.answers, "week_summary")
    usage = U.usage_map(store.read("week_calls"), rates, W.WEEK)
    report = R.as_document(R.weekly_report_lines(meta, notes, summary, usage), W.WEEK)
    strategy = clusters.groupBy(*W.WEEK).agg(F.min("strategy").alias("strategy"))
    rows = report.join(meta.select(*W.WEEK, "total_active_sec_est", "snapshot_status"), W.WEEK).join(strategy, W.WEEK, "left").join(
        summary.select(*W.WEEK, F.col("source").alias("summary_source")), W.WEEK, "left")
    store.replace("week_reports", rows, W.WEEK)

    tries = meta.join(lost, W.WEEK, "left").select(
        *W.WEEK, F.when(F.col("snapshot_status") != "complete", F.struct(
            F.lit("snapshot_generation").alias("stage"), F.lit("snapshot_missing").alias("error_kind"),
            F.concat(F.lit(K.WEEK_ERRORS["partial"]), F.lit(" ("), F.array_join("incomplete_notes", ", "), F.lit(")")).alias("error")))
        .when(F.col("reason").isNotNull(), F.struct(
            F.lit("task_clustering").alias("stage"), F.lit("llm_invalid_json").alias("error_kind"),
            F.concat(F.lit(K.WEEK_ERRORS["fallback"]), F.lit(" ("), F.col("reason"), F.lit(")")).alias("error"))).alias("_e"))
    tries = tries.select(*W.WEEK, "_e.stage", "_e.error_kind", "_e.error").unionByName(bad.select(
        *W.WEEK, F.lit("snapshot_generation").alias("stage"), F.lit("snapshot_missing").alias("error_kind"), "error"))
    at = F.timestamp_micros(F.lit(store.version).cast("long"))
    store.add("week_attempts", tries.select("*", F.col("stage").isNull().alias("ok"), at.alias("ts"), F.lit(0).cast("long").alias("seq")), W.WEEK)
    return store.read("week_reports").join(W.with_week(snapshots).select(*W.WEEK).distinct(), W.WEEK, "left_semi")
