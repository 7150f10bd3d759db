"""Weeks: task items, day notes, clusters, themes and summaries.

A week of one source is seven rows, so arrays over a week are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions import text as T
from daymill.functions.timefmt import duration_text, week_end, week_start, weekday_name
from daymill.operators.enrich import ModelPass, model_pass
from daymill.operators.ordered import distinct_texts, top_k

WEEK = ["source_id", "week_start"]


def clean(c: Column) -> Column:
    return T.collapse(c)


def with_week(df: DataFrame, day: str = "day") -> DataFrame:
    return df.withColumn("week_start", week_start(F.col(day)))


# ---- items and notes ---------------------------------------------------------

def task_items(snapshots: DataFrame, prefer_enriched: bool = False) -> DataFrame:
    """Hours of day snapshots as items ``day:idx``."""
    h = with_week(snapshots).select("source_id", "week_start", "day", F.posexplode("hours").alias("idx", "h"))

    def best(name: str) -> Column:
        plain = F.trim(T.text_of(F.col(f"h.{name}")))
        rich = F.trim(T.text_of(F.col(f"h.{name}_enriched")))
        return F.coalesce(F.nullif(rich, F.lit("")), plain) if prefer_enriched else plain

    return h.select(
        *WEEK, "day", "idx", F.concat_ws(":", F.col("day").cast("string"), F.col("idx").cast("string")).alias("id"),
        F.col("h.hour_start_ts").alias("hour_start_ts"), F.col("h.hour_end_ts").alias("hour_end_ts"),
        best("hour_title").alias("hour_title"), best("hour_summary").alias("hour_summary"),
        F.col("h.cluster_labels").alias("cluster_labels"),
        F.coalesce("h.active_sec_est", F.lit(0)).cast("long").alias("active_sec_est"))


def _hour_texts(name: str) -> Column:
    return F.transform("hours", lambda h: h[name])


def _first(texts: Column) -> Column:
    return F.coalesce(F.get(texts, F.lit(0)), F.lit(""))


def _note_columns(df: DataFrame) -> DataFrame:
    return with_week(df).select(
        *WEEK, "day", weekday_name(F.col("day")).alias("weekday"), "title", "overview", "detail", "highlights",
        F.col("_titles").alias("hour_titles"), F.col("_notes").alias("hour_narratives"),
        F.coalesce(F.nullif(F.trim(T.text_of(F.col("status"))), F.lit("")), F.lit("incomplete")).alias("status"),
        clean(F.col("incomplete_reason")).alias("incomplete_reason"),
        F.coalesce("total_active_sec_est", F.lit(0)).cast("long").alias("total_active_sec_est"))


def _lead_title(titles: Column) -> Column:
    return T.let(_first(titles), lambda t: F.when(T.is_toolish(t), F.lit("")).otherwise(t))


def day_notes(snapshots: DataFrame, rich: bool = False) -> DataFrame:
    """Title, overview and detail of each day.

    The default reads hour titles and summaries only; ``rich`` starts from the day
    summary and the enriched hours and falls back step by step.
    """
    if not rich:
        base = snapshots.withColumn("_titles", distinct_texts(_hour_texts("hour_title"))).withColumn(
            "_notes", distinct_texts(_hour_texts("hour_summary")))
        return _note_columns(
            base.withColumn("title", _lead_title(F.col("_titles"))).withColumn("overview", _first(F.col("_notes")))
            .withColumn("detail", F.when(F.size("_notes") >= 2, F.array_join(F.slice("_notes", F.lit(2), F.size("_notes")), " ")).otherwise(""))
            .withColumn("highlights", F.array().cast("array<string>")))

    def either(rich_name: str, name: str) -> Column:
        return F.transform("hours", lambda h: T.let(clean(h[rich_name]), lambda r: F.when(r != "", r).otherwise(clean(h[name]))))

    def daily(n: str) -> Column:
        return clean(F.col(f"daily.{n}"))

    hl = F.col("highlights")
    pre, sep, end = K.NOTE_TEXTS["points"]
    key_pre, key_end = K.NOTE_TEXTS["keys"]
    top = F.array_join(hl, sep)
    base = (
        snapshots.withColumn("_titles", distinct_texts(either("hour_title_enriched", "hour_title")))
        .withColumn("_notes", distinct_texts(either("hour_summary_enriched", "hour_summary")))
        .withColumn("highlights", distinct_texts(F.coalesce("daily.highlights", F.array().cast("array<string>"))))
        .withColumn("_dt", daily("daily_title")).withColumn("_ds", daily("daily_summary")).withColumn("_dd", daily("daily_detail"))
        .withColumn("title", F.when(F.col("_dt") != "", F.col("_dt")).otherwise(_lead_title(F.col("_titles"))))
        .withColumn("overview", F.when(F.col("_ds") != "", F.col("_ds")).when(F.col("_dd") != "", F.col("_dd")).otherwise(_first(F.col("_notes"))))
        .withColumn("detail", F.when((F.col("_dd") != "") & (F.col("_dd") != F.col("overview")), F.col("_dd"))
                    .when(F.size("_notes") >= 2, F.array_join(F.slice("_notes", F.lit(2), F.size("_notes")), " "))
                    .when(F.size(hl) > 0, F.concat(F.lit(pre), top, F.lit(end))).otherwise(""))
        .withColumn("overview", F.when((F.col("overview") == "") & (F.col("title") != ""), F.concat("title", F.lit(K.NOTE_TEXTS["overview"]))).otherwise(F.col("overview")))
        .withColumn("detail", F.when((F.col("detail") == "") & (F.size(hl) >= 2), F.concat(F.lit(key_pre), top, F.lit(key_end))).otherwise(F.col("detail")))
    )
    return _note_columns(base)


def week_calendar(notes: DataFrame, weeks: DataFrame | None = None) -> DataFrame:
    """Seven rows per source and week; days without a note are marked missing."""
    spine = (weeks if weeks is not None else notes.select(*WEEK).distinct()).select(
        *WEEK, F.explode(F.sequence("week_start", F.date_add("week_start", 6))).alias("day"))
    out = spine.join(notes.withColumn("_has", F.lit(True)), [*WEEK, "day"], "left")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("title", "overview", "detail")}
    return out.withColumns({
        **blank, "weekday": weekday_name(F.col("day")),
        "highlights": F.coalesce("highlights", F.array().cast("array<string>")),
        "status": F.coalesce("status", F.lit("incomplete")),
        "incomplete_reason": F.when(F.col("_has"), F.col("incomplete_reason")).otherwise("snapshot_missing"),
        "total_active_sec_est": F.coalesce("total_active_sec_est", F.lit(0)),
    }).drop("_has")


def incomplete_days(snapshots: DataFrame) -> DataFrame:
    """Days of a week that are not complete, with reason, hours and seconds."""
    status = F.trim(T.text_of(F.col("status")))
    return with_week(snapshots).filter(status != "complete").select(
        *WEEK, "day", F.coalesce(F.nullif(status, F.lit("")), F.lit("incomplete")).alias("status"),
        F.trim(T.text_of(F.col("incomplete_reason"))).alias("incomplete_reason"),
        F.coalesce(F.size("hours"), F.lit(0)).cast("long").alias("hour_count"),
        F.coalesce("total_active_sec_est", F.lit(0)).cast("long").alias("total_active_sec_est"))


def week_meta(snapshots: DataFrame) -> DataFrame:
    """Totals, status and the incomplete days of every week."""
    bad = F.trim(T.text_of(F.col("status"))) != "complete"
    note = F.when(bad, F.struct("day", F.concat_ws(": ", F.col("day").cast("string"), F.coalesce(
        F.nullif(F.trim(T.text_of(F.col("incomplete_reason"))), F.lit("")), F.lit("incomplete"))).alias("note")))
    return with_week(snapshots).groupBy(*WEEK).agg(
        F.sum("total_active_sec_est").cast("long").alias("total_active_sec_est"), F.count(F.lit(1)).alias("source_days"),
        F.when(F.count_if(bad) > 0, "incomplete").otherwise("complete").alias("snapshot_status"),
        F.transform(F.array_sort(F.collect_list(note)), lambda n: n["note"]).alias("incomplete_notes"))


# ---- clusters ------------------------------------------------------------------

def cluster_name(items: DataFrame, shown: int | None = 40) -> Column:
    labels = F.filter(F.transform("cluster_labels", lambda x: F.trim(x)), lambda x: x != "")
    summary = F.trim(F.col("hour_summary"))
    cut = summary if shown is None else F.when(F.length(summary) > shown, F.concat(F.substring(summary, 1, shown), F.lit("…"))).otherwise(summary)
    return (
        F.when(F.size(labels) > 0, F.array_join(labels, " / "))
        .when(F.trim("hour_title") != "", F.trim("hour_title"))
        .when(summary != "", cut).otherwise(K.UNNAMED_TASK)
    )


def fallback_task_clusters(items: DataFrame, by: Sequence[str] = WEEK) -> DataFrame:
    """Items grouped by their whole name in any case; largest first, ``fallback-n`` ids.  A name made of a summary is shown shortened."""
    named = items.filter(F.trim("id") != "").withColumns({"_name": cluster_name(items), "_whole": cluster_name(items, None)})
    key = F.coalesce(F.nullif(F.lower(T.collapse(F.col("_whole"))), F.lit("")), F.col("id"))
    at = F.struct("day", "idx")
    groups = named.groupBy(*by, key.alias("_key")).agg(
        F.min_by("_name", at).alias("canonical_task_name"), F.sum("active_sec_est").cast("long").alias("total_active_sec_est"),
        F.transform(F.array_sort(F.collect_list(F.struct("day", "idx", "id"))), lambda x: x["id"]).alias("item_ids"))
    w = Window.partitionBy(*by).orderBy(F.desc("total_active_sec_est"), "canonical_task_name", "_key")
    return groups.withColumn("rank", F.row_number().over(w)).select(
        *by, F.concat(F.lit("fallback-"), F.col("rank")).alias("cluster_id"), "canonical_task_name", "item_ids",
        "total_active_sec_est", F.lit(0.2).alias("confidence"))


def cluster_items(clusters: DataFrame, items: DataFrame, by: Sequence[str] = WEEK) -> DataFrame:
    """Cluster members with their item; ids that match nothing fall away."""
    ids = clusters.select(*by, "cluster_id", "canonical_task_name", F.explode("item_ids").alias("id"))
    return ids.join(items, [*by, "id"])


def daily_top_tasks(clusters: DataFrame, items: DataFrame, k: int = 5, by: Sequence[str] = WEEK) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("canonical_task_name"), F.lit("")), F.lit(K.UNNAMED_TASK))
    sums = cluster_items(clusters, items, by).groupBy(*by, "day", name.alias("task")).agg(
        F.sum("active_sec_est").cast("long").alias("active_sec_est"))
    top = top_k(sums, [*by, "day"], [F.desc("active_sec_est"), F.col("task")], k)
    return top.withColumn("line", F.concat(F.col("task"), F.lit("（"), duration_text(F.col("active_sec_est")), F.lit("）")))


def validate_clusters(items: DataFrame, clusters: DataFrame, by: Sequence[str] = WEEK) -> DataFrame:
    """Problems as rows ``by, problem, id``: unassigned, duplicate, unknown, empty."""
    ids = items.filter(F.trim("id") != "").select(*by, "id").distinct()
    used = clusters.select(*by, F.explode("item_ids").alias("id")).filter(F.trim("id") != "")
    counts = used.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("n"))
    key = [*by, "id"]
    parts = [
        ("unassigned", ids.join(counts, key, "left_anti")),
        ("duplicate", counts.filter("n > 1").select(*key)),
        ("unknown", counts.join(ids, key, "left_anti").select(*key)),
        ("empty", clusters.filter(F.size(F.filter("item_ids", lambda x: F.trim(x) != "")) == 0).select(*by, F.col("cluster_id").alias("id"))),
    ]
    out = None
    for name, df in parts:
        rows = df.select(*by, F.lit(name).alias("problem"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def cluster_week_tasks_pass(
    items: DataFrame, model_fn: Callable[[list[dict]], list[dict]], by: Sequence[str] = WEEK
) -> ModelPass:
    """Model clusters per week where they validate, rule-based clusters elsewhere; ``lost`` tells why a week fell back."""
    item = F.struct("day", "idx", F.to_json(F.struct("id", "hour_title", "hour_summary", "cluster_labels", "active_sec_est")).alias("j"))
    weeks = items.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]).alias("items"))
    calls = weeks.select(*by, F.lit(0).alias("batch"), F.array(F.to_json(F.struct("items"))).alias("items"))
    got = model_pass(calls, by, lambda part: model_fn(_week_items(part)), "week_clusters", "weekly-clustering")
    model = got.answers.drop("batch")
    flaws = validate_clusters(items, model, by).select(*by, F.col("problem").alias("reason"), F.lit(1).alias("_at"))
    why = got.lost.select(*by, "reason", F.lit(0).alias("_at")).unionByName(flaws)
    bad = why.groupBy(*by).agg(F.min_by("reason", F.struct("_at", "reason")).alias("reason"))
    fine = model.join(bad, list(by), "left_anti").withColumn("strategy", F.lit("model"))
    rest = items.join(bad, list(by), "left_semi")
    rule = fallback_task_clusters(rest, by).withColumn("strategy", F.lit("fallback"))
    cols = [*by, "cluster_id", "canonical_task_name", "item_ids", "confidence", "strategy"]
    return ModelPass(fine.select(*cols).unionByName(rule.select(*cols)), bad, got.calls)


def cluster_week_tasks(
    items: DataFrame, model_fn: Callable[[list[dict]], list[dict]], by: Sequence[str] = WEEK
) -> DataFrame:
    """The clusters of :func:`cluster_week_tasks_pass`."""
    return cluster_week_tasks_pass(items, model_fn, by).answers


def _week_items(part: list[dict]) -> list[dict]:
    import json

    return [json.loads(x) for week in part for x in week["items"]]


def rule_cluster_model(items: list[dict]) -> list[dict]:
    """Items of one week grouped by hour title."""
    groups: dict[str, list[str]] = {}
    for it in items:
        groups.setdefault(it["hour_title"], []).append(it["id"])
    return [{"cluster_id": f"c{i}", "canonical_task_name": name, "item_ids": ids, "confidence": 0.5}
            for i, (name, ids) in enumerate(groups.items(), 1)]


# ---- themes and summary ----------------------------------------------------------

def _note_texts(notes: Column) -> Column:
    """Titles and highlights in day order, those that look like tool output left out."""
    def of(n: Column) -> Column:
        title = F.transform(
            F.filter(F.array(clean(n["title"])), lambda t: (t != "") & ~T.is_toolish(t)),
            lambda t: F.regexp_replace(t, K.DAY_SUFFIX + "$", ""))
        points = F.filter(F.transform(n["highlights"], clean), lambda t: (t != "") & ~T.is_toolish(t))
        return F.concat(title, points)

    return F.flatten(F.transform(notes, of))


def _weeks_of_notes(notes: DataFrame) -> DataFrame:
    row = F.struct("day", "weekday", "title", "overview", "detail", "highlights", "status", "total_active_sec_est")
    return notes.groupBy(*WEEK).agg(F.array_sort(F.collect_list(row)).alias("_notes"))


def week_themes(notes: DataFrame, limit: int | None = None) -> DataFrame:
    return _weeks_of_notes(notes).select(*WEEK, distinct_texts(_note_texts(F.col("_notes")), limit).alias("themes"))


def week_summary_fallback(notes: DataFrame) -> DataFrame:
    """A rule-based week summary from themes and active days."""
    t = K.WEEK_TEXTS
    live = F.filter("_notes", lambda n: (clean(n["overview"]) != "") | (clean(n["detail"]) != "") | (clean(n["title"]) != ""))
    themes, act, lead = F.col("_themes"), F.col("_act"), F.col("_lead")
    seed = F.array_join(themes, t["title_join"])
    title = F.when(F.size(themes) > 0, F.concat(
        F.when(F.length(seed) <= t["title_limit"], seed).otherwise(lead), F.lit(t["title_end"]))).otherwise(
        F.concat(F.col("week_start").cast("string"), F.lit(" - "), week_end(F.col("week_start")).cast("string"), F.lit(t["title_plain"])))
    axis = F.when(F.size(themes) > 0, F.concat(F.lit(t["axis"][0]), lead, F.lit(t["axis"][1])))
    days = F.when(F.size(act) >= 2, F.concat(F.size(act).cast("string"), F.lit(t["many"]))).when(F.size(act) == 1, F.lit(t["few"]))
    summary = F.concat_ws(" ", axis, days)

    def day_text(n: Column) -> Column:
        over, detail = clean(n["overview"]), clean(n["detail"])
        body = F.when((over != "") & ~T.is_toolish(over), over).when((detail != "") & ~T.is_toolish(detail), detail)
        coherent = (F.size(n["highlights"]) > 0) | ((F.trim(n["status"]) == "complete") & (clean(n["title"]) != ""))
        return F.when(coherent, F.concat(n["day"].cast("string"), F.lit("（"), n["weekday"], F.lit("）は"), body))

    per_day = F.filter(F.transform(act, day_text), lambda x: x.isNotNull())
    whole = F.when(F.size(themes) > 0, F.concat(F.lit(t["whole"][0]), lead, F.lit(t["whole"][1])))
    detail = F.concat_ws(" ", per_day, whole, F.when(F.size(act) > 0, F.lit(t["next"])))
    some = lambda c, spare: F.when(c == "", F.lit(spare)).otherwise(c)
    return (
        _weeks_of_notes(notes).withColumn("_themes", distinct_texts(_note_texts(F.col("_notes"))))
        .withColumn("_act", live).withColumn("_lead", _first(F.col("_themes")))
        .select(
            *WEEK, title.alias("weekly_title"), some(summary, t["summary_none"]).alias("weekly_summary"),
            some(detail, t["detail_none"]).alias("weekly_detail"),
            distinct_texts(_note_texts(act)).alias("highlights"),
            F.lit(0.0).alias("confidence"), F.lit("fallback").alias("source"))
    )


def merge_week_summary(primary: DataFrame, fallback: DataFrame, by: Sequence[str] = WEEK) -> DataFrame:
    """Model summaries field by field over the fallback; blanks fall back."""
    p = primary.select(*by, F.struct(*[c for c in primary.columns if c not in by]).alias("_p"))
    texts = {
        c: F.coalesce(F.nullif(clean(F.col(f"_p.{c}")), F.lit("")), F.col(c))
        for c in ("weekly_title", "weekly_summary", "weekly_detail")}
    hl = distinct_texts(F.coalesce("_p.highlights", F.array().cast("array<string>")))
    return fallback.join(p, list(by), "left").withColumns({
        **texts, "highlights": F.when(F.size(hl) > 0, hl).otherwise(F.col("highlights")),
        "confidence": F.coalesce("_p.confidence", "confidence"),
        "source": F.when(F.col("_p").isNotNull(), F.coalesce(F.nullif(F.trim("_p.source"), F.lit("")), F.lit("fallback"))).otherwise(F.col("source")),
    }).drop("_p")


def summarize_week_pass(notes: DataFrame, model_fn: Callable[[list[dict]], list[dict]]) -> ModelPass:
    """Week summaries: the model over usable notes where it answers, else the fallback; ``lost`` tells why a week fell back."""
    usable = notes.filter((clean(F.col("overview")) != "") | (clean(F.col("detail")) != "") | (clean(F.col("title")) != ""))
    item = F.struct("day", F.to_json(F.struct(
        "day", "weekday", "title", "overview", "detail", "highlights", "total_active_sec_est", "status")).alias("j"))
    calls = usable.groupBy(*WEEK).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]).alias("n")).select(
        *WEEK, F.lit(0).alias("batch"), F.array(F.to_json(F.struct(F.col("n").alias("items")))).alias("items"))
    got = model_pass(calls, WEEK, lambda part: model_fn(_week_items(part)), "week_summary", "weekly-summary")
    lost = got.lost.groupBy(*WEEK).agg(F.min("reason").alias("reason"))
    merged = merge_week_summary(got.answers.drop("batch").withColumn("source", F.lit("model")), week_summary_fallback(notes))
    return ModelPass(merged, lost, got.calls)


def summarize_week(notes: DataFrame, model_fn: Callable[[list[dict]], list[dict]] | None = None) -> DataFrame:
    """The summaries of :func:`summarize_week_pass`; the fallback without a model."""
    return week_summary_fallback(notes) if model_fn is None else summarize_week_pass(notes, model_fn).answers


def rule_week_model(notes: list[dict]) -> list[dict]:
    titles = list(dict.fromkeys(n["title"] for n in notes if n["title"]))
    return [{"weekly_title": titles[0] if titles else "", "weekly_summary": f"{len(notes)} days", "weekly_detail": "",
             "highlights": titles, "confidence": 0.6}]
