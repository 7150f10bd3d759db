"""The day job and the week job with models that fail at times and tell their usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymill.operators import enrich as M
from daymill.operators import weekly as W
from daymill.operators.ordered import GROUP
from daymill.plans import jobs as J
from daymill.plans.catalog.base import query
from daymill.plans.catalog.labels import DAILY, LAB, MIN_SEC, OV
from daymill.plans.catalog.segments import text_job
from daymill.plans.catalog.weeks import REPORT
from daymill.session import work_folder
from daymill.sources import samples as A

USED = "gpt-5-nano"


def _hours_model(items: list[dict]) -> M.Reply:
    """Fails at every fifth hour of a day; counts a token per hour of the clock and item."""
    at = [int(i["hour_start_ts"][11:13]) for i in items]
    if any(h % 5 == 0 for h in at):
        raise TimeoutError("timed out")
    return M.Reply(M.rule_hour_model(items), USED, 1000 * sum(at), 200 * sum(at), len(items))


def _enrich_model(items: list[dict]) -> M.Reply:
    return M.Reply(M.rule_enrich_model(items), USED, 8 * len(items), 0, 2 * len(items))


def _cluster_model(items: list[dict]) -> M.Reply:
    """Leaves the first item of every third ISO week out, which is not a valid answer."""
    import datetime as dt

    week = dt.date.fromisoformat(items[0]["id"][:10]).isocalendar().week
    return M.Reply(W.rule_cluster_model(items[1:] if week % 3 == 0 else items), USED, 100 * len(items), 0, len(items))


def _week_model(notes: list[dict]) -> M.Reply:
    """Fails in even ISO weeks."""
    import datetime as dt

    if dt.date.fromisoformat(notes[0]["day"]).isocalendar().week % 2 == 0:
        raise ValueError("no answer this week")
    return M.Reply(W.rule_week_model(notes), "other-model", 50 * len(notes), 5, 9)


_DAYS: dict[tuple[str, str], J.Store] = {}


def day_store(spark, sf) -> J.Store:
    """The store of one run over all days of the sample; it serves the day queries of one session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DAYS:
        store = J.Store(spark, work_folder(spark, "day_job"))
        J.build_day_snapshots(text_job(spark, sf), store, J.Models(hour=_hours_model, enrich=_enrich_model), min_sec=MIN_SEC)
        _DAYS[key] = store
    return _DAYS[key]


# Labels of the hours that the model answers for.
SOME = LAB.replace("WHERE active_sec >=", "WHERE extract(hour FROM hr) % 5 <> 0 AND active_sec >=")


@query("day_snapshot", f"""WITH {DAILY.replace(LAB, SOME)}, {OV},
g AS (SELECT source_id, day, count(*) FILTER (WHERE active_sec >= {MIN_SEC} AND NOT has) AS gap, count(*) FILTER (WHERE active_sec >= {MIN_SEC} AND has) AS got,
  CAST(sum(active_sec) AS BIGINT) AS total FROM lp GROUP BY ALL),
x AS (SELECT ov.source_id, ov.day, ov.hr, strftime(ov.hr, '%H') || '=' || lt || '|' || ls || '|' || CASE WHEN (t <> '' OR s <> '') AND COALESCE(daily_title, '') <> '' THEN t || '|' || trim(t || ' (' || daily_title || ')') ELSE '|' END AS txt,
  (t <> '' OR s <> '') AND COALESCE(daily_title, '') <> '' AS rich FROM ov LEFT JOIN daily ON ov.source_id = daily.source_id AND ov.day = daily.day),
xx AS (SELECT source_id, day, string_agg(txt, chr(10) ORDER BY hr) AS hours, bool_or(rich) AS rich FROM x GROUP BY ALL)
SELECT g.source_id, CAST(g.day AS VARCHAR) AS day, CASE WHEN gap > 0 THEN 'incomplete' ELSE 'complete' END AS status,
  CASE WHEN gap = 0 THEN '' WHEN got > 0 THEN 'hourly_llm_missing:' || gap ELSE 'hourly_llm_unavailable' END AS incomplete_reason, total AS total_active_sec_est,
  CASE WHEN COALESCE(daily_title, '') <> '' THEN 'complete' ELSE 'missing' END AS daily_status, CASE WHEN rich THEN 'complete' ELSE 'missing' END AS hour_enrich_status,
  COALESCE(daily_title, '') AS daily_title, hours
FROM g JOIN xx ON g.source_id = xx.source_id AND g.day = xx.day LEFT JOIN daily ON g.source_id = daily.source_id AND g.day = daily.day""")
def day_snapshot(spark, sf) -> DataFrame:
    line = F.transform("hours", lambda h: F.concat(
        F.date_format(h["hour_key"], "HH"), F.lit("="),
        F.concat_ws("|", h["hour_title"], h["hour_summary"], h["hour_title_enriched"], h["hour_summary_enriched"])))
    return day_store(spark, sf).read("snapshots").select(
        *GROUP, "status", "incomplete_reason", "total_active_sec_est", "daily_status", "hour_enrich_status",
        F.coalesce("daily.daily_title", F.lit("")).alias("daily_title"), F.array_join(line, "\n").alias("hours"))


def _usage(label: str, i: str, c: str, o: str, usd: str, model: str) -> str:
    """SQL of one usage line."""
    return (f"'  - {label}: input ' || format('{{:,}}', {i}) || CASE WHEN {c} > 0 THEN '（cached ' || format('{{:,}}', {c}) || '）' ELSE '' END || ' / output ' || format('{{:,}}', {o})"
            f" || ' tokens（cost: ' || {_cost(usd)} || '）{model}'")


def _cost(usd: str) -> str:
    return f"CASE WHEN {usd} IS NULL THEN 'n/a / n/a' ELSE printf('$%.6f', {usd}) || ' / ¥' || format('{{:,}}', CAST(round_even({usd} * 150, 0) AS BIGINT)) END"


@query("day_report", f"""WITH {DAILY.replace(LAB, SOME)}, {OV},
u AS (SELECT source_id, day, CAST(COALESCE(sum(extract(hour FROM hr)) FILTER (WHERE has), 0) AS BIGINT) AS h, count(*) FILTER (WHERE has) AS n FROM lp GROUP BY ALL),
e AS (SELECT ov.source_id, ov.day, count(*) AS n FROM ov JOIN daily ON ov.source_id = daily.source_id AND ov.day = daily.day WHERE (t <> '' OR s <> '') AND daily_title <> '' GROUP BY ALL),
m AS (SELECT u.source_id, u.day, 1000 * h AS hi, 200 * h AS hc, u.n AS ho, 8 * COALESCE(e.n, 0) AS ei, 2 * COALESCE(e.n, 0) AS eo,
  (800.0 * h * 0.05 + 200 * h * 0.005 + u.n * 0.40)::DOUBLE / 1000000 AS hu, (8 * COALESCE(e.n, 0) * 0.05 + 2 * COALESCE(e.n, 0) * 0.40)::DOUBLE / 1000000 AS eu
  FROM u LEFT JOIN e ON u.source_id = e.source_id AND u.day = e.day),
c AS (SELECT source_id, day, count(*) AS n, count(*) FILTER (WHERE excl) AS x, count(*) FILTER (WHERE err) AS er FROM ev GROUP BY ALL)
SELECT m.source_id, CAST(m.day AS VARCHAR) AS day, COALESCE('# ' || strftime(m.day, '%y-%m-%d') || '_' || daily_title, '# 作業ログ ' || m.day) AS title,
 CASE WHEN ho = 0 THEN '  - hour-llm（タイムライン用）: 未実行' ELSE {_usage('hour-llm（タイムライン用）', 'hi', 'hc', 'ho', 'hu', ' / model gpt-5-nano')} END AS hour_usage,
 CASE WHEN eo = 0 THEN '  - hour-enrich-llm（目的・意味付け）: 未実行' ELSE {_usage('hour-enrich-llm（目的・意味付け）', 'ei', '0', 'eo', 'eu', ' / model gpt-5-nano')} END AS enrich_usage,
 '  - 合計: input ' || format('{{:,}}', CAST(hi + ei AS BIGINT)) || ' / output ' || format('{{:,}}', CAST(ho + eo AS BIGINT)) || ' tokens（cost: ' || CASE WHEN ho + eo = 0 THEN 'n/a / n/a' ELSE {_cost('(hu + eu)')} END || '）' AS total_usage,
 (SELECT count(*) FROM lp WHERE lp.source_id = m.source_id AND lp.day = m.day) AS hours, c.x AS excluded, c.er AS errors
FROM m JOIN c ON m.source_id = c.source_id AND m.day = c.day LEFT JOIN daily ON m.source_id = daily.source_id AND m.day = daily.day""")
def day_report(spark, sf) -> DataFrame:
    docs = J.day_reports(text_job(spark, sf), day_store(spark, sf))
    find = lambda p: F.regexp_extract("report", p, 1)
    return docs.select(
        *GROUP, find("^([^\n]*)").alias("title"), find("(?m)^(  - hour-llm[^\n]*)$").alias("hour_usage"),
        find("(?m)^(  - hour-enrich-llm[^\n]*)$").alias("enrich_usage"), find("(?m)^(  - 合計[^\n]*)$").alias("total_usage"),
        F.regexp_count("report", F.lit("(?m)^- 主な作業: ")).cast("long").alias("hours"),
        find("(?m)^- 除外: ([0-9]+)回$").cast("long").alias("excluded"), find("(?m)^- スクショ/OCR失敗: ([0-9]+)回$").cast("long").alias("errors"))


# The report of the week queries with the model's words in odd weeks and the usage of both stages.
_WEEK = "week(f.week_start) % 2 = 1"
_RUN = (
    REPORT.replace("'%s'\n  || ", "")
    .replace("|| '- タイトル: ' || f.weekly_title", f"|| '- タイトル: ' || CASE WHEN {_WEEK} THEN f.highlights[1] ELSE f.weekly_title END")
    .replace("'- 概要: ' || f.weekly_summary", f"'- 概要: ' || CASE WHEN {_WEEK} THEN f.n || ' days' ELSE f.weekly_summary END")
    .replace("'  - weekly-clustering（タスククラスタリング）: 未実行'", _usage(
        "weekly-clustering（タスククラスタリング）", "100 * k.n", "0", "k.n", "(k.n * 5.4::DOUBLE / 1000000)", " / model gpt-5-nano"))
    .replace("'  - weekly-summary（総括生成）: 未実行'", f"CASE WHEN {_WEEK} THEN " + _usage(
        "weekly-summary（総括生成）", "50 * f.n", "5", "9", "NULL::DOUBLE", " / model other-model") + " ELSE '  - weekly-summary（総括生成）: 未実行' END")
    .replace("'  - 合計: input 0 / output 0 tokens（cost: n/a / n/a）'",
             f"'  - 合計: input ' || format('{{:,}}', 100 * k.n + CASE WHEN {_WEEK} THEN 50 * f.n ELSE 0 END) || ' / output ' || format('{{:,}}', k.n + CASE WHEN {_WEEK} THEN 9 ELSE 0 END)"
             f" || ' tokens（cost: ' || {_cost('(k.n * 5.4::DOUBLE / 1000000)')} || '）'")
    .replace("AS report\n", """AS report, st.sec AS total_active_sec_est, st.status AS snapshot_status,
 CASE WHEN week(f.week_start) % 3 = 0 THEN 'fallback' ELSE 'model' END AS strategy, st.notes, week(f.week_start) % 3 = 0 AS by_rule\n""")
    + """ JOIN (SELECT source_id, CAST(date_trunc('week', day) AS DATE) AS week_start, count(*) AS n FROM hidx GROUP BY ALL) k ON f.source_id = k.source_id AND f.week_start = k.week_start
 JOIN (SELECT source_id, week_start, CAST(sum(total) AS BIGINT) AS sec, CASE WHEN count(*) FILTER (WHERE status <> 'complete') > 0 THEN 'incomplete' ELSE 'complete' END AS status,
  string_agg(day || ': ' || reason, ', ' ORDER BY day) FILTER (WHERE status <> 'complete') AS notes FROM snap GROUP BY ALL) st ON f.source_id = st.source_id AND f.week_start = st.week_start""")


@query("week_report", f"""SELECT source_id, week_start, report, total_active_sec_est, snapshot_status, strategy,
 CASE WHEN notes IS NOT NULL THEN 'snapshot_generation' WHEN by_rule THEN 'task_clustering' ELSE '' END AS pending_stage,
 CASE WHEN notes IS NOT NULL THEN 'report_written_with_partial_snapshots (' || notes || ')' WHEN by_rule THEN 'report_written_with_fallback_clustering (unassigned)' ELSE '' END AS pending_error
FROM (WITH {_RUN})""")
def week_report(spark, sf) -> DataFrame:
    store = J.Store(spark, work_folder(spark, "week_job"))
    rows = J.build_week_reports(A.day_snapshots(spark, sf), store, J.Models(cluster=_cluster_model, week=_week_model))
    return rows.join(J.pending_weeks(store).select(*W.WEEK, "stage", "error"), W.WEEK, "left").select(
        *W.WEEK, "report", "total_active_sec_est", "snapshot_status", "strategy",
        F.coalesce("stage", F.lit("")).alias("pending_stage"), F.coalesce("error", F.lit("")).alias("pending_error"))
