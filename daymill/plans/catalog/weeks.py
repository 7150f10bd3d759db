"""Week items, notes, clusters, summaries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymill.operators import filters as B
from daymill.operators import usage as U
from daymill.operators import weekly as W
from daymill.plans import report as R
from daymill.plans.catalog.base import query
from daymill.sources import samples as A


def snaps(spark, sf):
    return A.day_snapshots(spark, sf)


WK = "CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week_start"


@query("b7_snapshot_usable", """
SELECT source_id, CAST(day AS VARCHAR) AS day, status = 'complete' OR n_hours >= 23 OR extract(day FROM day) % 2 = 0 AS usable FROM snap""")
def b7(spark, sf):
    s = snaps(spark, sf).withColumn("hours", F.when(F.size("hours") >= 23, F.col("hours")).otherwise(F.slice("hours", 1, 0)))
    return B.snapshot_usable(s).select("source_id", "day", "usable")


@query("c12_task_items", f"""
SELECT source_id, {WK}, CAST(day AS VARCHAR) AS day, idx, CAST(day AS VARCHAR) || ':' || idx AS id, title || ' again' AS hour_title, summary AS hour_summary,
 array_to_string(labels, '|') AS cluster_labels, active_sec AS active_sec_est FROM hidx""")
def c12(spark, sf):
    return W.task_items(snaps(spark, sf), prefer_enriched=True).drop("hour_start_ts", "hour_end_ts")


NOTE = """nt AS (SELECT source_id, day, lower(title) AS low, arg_min(title, idx) AS t, min(idx) AS i FROM hidx GROUP BY source_id, day, lower(title)),
ns AS (SELECT source_id, day, lower(summary) AS low, arg_min(summary, idx) AS t, min(idx) AS i FROM hidx WHERE summary <> '' GROUP BY source_id, day, lower(summary)),
note AS (SELECT s.source_id, s.day, s.week_start, s.status, s.reason, s.total, t.l AS titles, COALESCE(n.l, []) AS notes FROM snap s
 JOIN (SELECT source_id, day, list(t ORDER BY i) AS l FROM nt GROUP BY ALL) t ON s.source_id = t.source_id AND s.day = t.day
 LEFT JOIN (SELECT source_id, day, list(t ORDER BY i) AS l FROM ns GROUP BY ALL) n ON s.source_id = n.source_id AND s.day = n.day)"""
WEEKDAY = "(['月', '火', '水', '木', '金', '土', '日'])[isodow({d})]"


@query("c14_day_note_hourly", f"""
WITH {NOTE} SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, CAST(day AS VARCHAR) AS day, {WEEKDAY.format(d='day')} AS weekday, titles[1] AS title,
 COALESCE(notes[1], '') AS overview, array_to_string(notes[2:], ' ') AS detail, '' AS highlights, array_to_string(titles, '|') AS hour_titles,
 array_to_string(notes, '|') AS hour_narratives, status, reason AS incomplete_reason, total AS total_active_sec_est FROM note""")
def c14(spark, sf):
    return W.day_notes(snaps(spark, sf))


@query("c13_day_note_rich", f"""
WITH {NOTE}, fl AS (SELECT source_id, day, arg_min(title, idx) AS ft, arg_max(title, idx) AS lt, count(*) AS n FROM hidx GROUP BY ALL),
q AS (SELECT note.*, extract(day FROM note.day) % 2 = 0 AS dd, fl.ft, fl.lt, fl.n,
  CASE WHEN lower(fl.ft) = lower(fl.lt) THEN [fl.ft, 'see http://x.com'] ELSE [fl.ft, 'see http://x.com', fl.lt] END AS hl FROM note JOIN fl ON note.source_id = fl.source_id AND note.day = fl.day)
SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, CAST(day AS VARCHAR) AS day, CASE WHEN dd THEN 'Day of ' || ft ELSE titles[1] || ' again' END AS title,
 CASE WHEN dd THEN n || ' hours seen' WHEN len(notes) > 0 THEN notes[1] ELSE titles[1] || ' againを中心に進めた。' END AS overview,
 CASE WHEN len(notes) >= 2 THEN array_to_string(notes[2:], ' ') WHEN dd THEN '主な論点は' || array_to_string(hl, '、') || '。' ELSE '' END AS detail,
 CASE WHEN dd THEN array_to_string(hl, '|') ELSE '' END AS highlights FROM q""")
def c13(spark, sf):
    return W.day_notes(snaps(spark, sf), rich=True).select(*W.WEEK, "day", "title", "overview", "detail", "highlights")


@query("e19_week_total", "SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, CAST(sum(total) AS BIGINT) AS week_active_sec FROM snap GROUP BY ALL")
def e19(spark, sf):
    return U.week_total(W.with_week(snaps(spark, sf)), W.WEEK)


FB = """fi AS (SELECT source_id, CAST(date_trunc('week', day) AS DATE) AS week_start, day, idx, CAST(day AS VARCHAR) || ':' || idx AS id,
  array_to_string(labels, ' / ') AS name, active_sec FROM hidx),
fb0 AS (SELECT source_id, week_start, lower(name) AS k, arg_min(name, (day, idx)) AS name, CAST(sum(active_sec) AS BIGINT) AS sec, list(id ORDER BY day, idx) AS ids FROM fi GROUP BY ALL),
fb AS (SELECT *, 'fallback-' || row_number() OVER (PARTITION BY source_id, week_start ORDER BY sec DESC, name) AS cid FROM fb0)"""


def clusters(spark, sf):
    items = W.task_items(snaps(spark, sf))
    return W.fallback_task_clusters(items), items


@query("e20_fallback_task_clusters", f"""
WITH {FB} SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, cid AS cluster_id, name AS canonical_task_name, array_to_string(ids, '|') AS item_ids,
 sec AS total_active_sec_est FROM fb""")
def e20(spark, sf):
    return clusters(spark, sf)[0].drop("confidence")


@query("f4_cluster_items", f"""
WITH {FB} SELECT fi.source_id, CAST(fi.week_start AS VARCHAR) AS week_start, fb.cid AS cluster_id, fi.id, fi.active_sec AS active_sec_est
FROM fi JOIN fb ON fi.source_id = fb.source_id AND fi.week_start = fb.week_start AND lower(fi.name) = fb.k""")
def f4(spark, sf):
    return W.cluster_items(*clusters(spark, sf)).select(*W.WEEK, "cluster_id", "id", "active_sec_est")


@query("e21_daily_top_tasks", f"""
WITH {FB}, d AS (SELECT fi.source_id, fi.week_start, fi.day, fb.name AS task, CAST(sum(fi.active_sec) AS BIGINT) AS sec
 FROM fi JOIN fb ON fi.source_id = fb.source_id AND fi.week_start = fb.week_start AND lower(fi.name) = fb.k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, day ORDER BY sec DESC, task) AS rank FROM d)
SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, CAST(day AS VARCHAR) AS day, rank, task, sec AS active_sec_est,
 task || '（' || CASE WHEN sec >= 3600 THEN (sec // 3600) || '時間' ELSE '' END || (sec % 3600 // 60) || '分）' AS line FROM r WHERE rank <= 5""")
def e21(spark, sf):
    return W.daily_top_tasks(*clusters(spark, sf))


@query("e24_week_themes", f"""
WITH {NOTE}, w AS (SELECT source_id, week_start, lower(titles[1]) AS low, arg_min(titles[1], day) AS t, min(day) AS d FROM note GROUP BY source_id, week_start, lower(titles[1]))
SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, array_to_string(list(t ORDER BY d), '|') AS themes FROM w GROUP BY source_id, week_start""")
def e24(spark, sf):
    return W.week_themes(W.day_notes(snaps(spark, sf)))


FALL = f"""{NOTE}, w0 AS (SELECT source_id, week_start, lower(titles[1]) AS low, arg_min(titles[1], day) AS t, min(day) AS d FROM note GROUP BY source_id, week_start, lower(titles[1])),
w AS (SELECT source_id, week_start, list(t ORDER BY d) AS th FROM w0 GROUP BY source_id, week_start),
wd AS (SELECT *, row_number() OVER (PARTITION BY source_id, week_start ORDER BY day) AS dn FROM note),
wa AS (SELECT source_id, week_start, count(*) AS n, COALESCE(string_agg(CASE WHEN status = 'complete' AND notes[1] IS NOT NULL THEN day || '（' || {WEEKDAY.format(d='day')} || '）は' || notes[1] END, ' ' ORDER BY day), '') AS dd FROM wd GROUP BY ALL),
fall AS (SELECT w.source_id, w.week_start, (CASE WHEN length(array_to_string(th, 'と')) <= 36 THEN array_to_string(th, 'と') ELSE th[1] END) || 'を進めた週' AS weekly_title,
 '今週は' || th[1] || 'を軸に進めた。 ' || CASE WHEN n >= 2 THEN n || '日分の記録から、前半から後半にかけて論点を整理しながら作業を前進させたことが読み取れる。' ELSE '記録のある日は限られるものの、継続的に進めたテーマが確認できる。' END AS weekly_summary,
 CASE WHEN dd = '' THEN '' ELSE dd || ' ' END || '週全体では' || th[1] || 'を中心に、関連する判断や整理を積み重ねていた。 次のアクションは、週内で整理した論点を具体的な実装や連携作業へ落とし込むことにある。' AS weekly_detail,
 th AS highlights, n FROM w JOIN wa ON w.source_id = wa.source_id AND w.week_start = wa.week_start)"""


@query("e25_week_summary_fallback", f"""
WITH {FALL} SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, weekly_title, weekly_summary, weekly_detail, array_to_string(highlights, '|') AS highlights FROM fall""")
def e25(spark, sf):
    return W.week_summary_fallback(W.day_notes(snaps(spark, sf))).drop("confidence", "source")


def partial_model(spark, sf):
    """Summaries of the even weeks only, some fields blank."""
    notes = W.day_notes(snaps(spark, sf))
    return notes.filter(F.weekofyear("week_start") % 2 == 0).groupBy(*W.WEEK).agg(F.count(F.lit(1)).alias("n")).select(
        *W.WEEK, F.lit("  Model  title ").alias("weekly_title"), F.lit(" ").alias("weekly_summary"), F.lit("").alias("weekly_detail"),
        F.array(F.lit("One"), F.lit("one"), F.concat(F.col("n"), F.lit(" days"))).alias("highlights"), F.lit(0.7).alias("confidence"), F.lit("model").alias("source"))


@query("f10_merge_week_summary", f"""
WITH {FALL} SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, CASE WHEN week(week_start) % 2 = 0 THEN 'Model title' ELSE weekly_title END AS weekly_title,
 weekly_summary, weekly_detail, CASE WHEN week(week_start) % 2 = 0 THEN 'One|' || n || ' days' ELSE array_to_string(highlights, '|') END AS highlights,
 CASE WHEN week(week_start) % 2 = 0 THEN 'model' ELSE 'fallback' END AS source FROM fall""")
def f10(spark, sf):
    return W.merge_week_summary(partial_model(spark, sf), W.week_summary_fallback(W.day_notes(snaps(spark, sf)))).drop("confidence")


@query("e26_incomplete_days", """
SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, CAST(day AS VARCHAR) AS day, status, reason AS incomplete_reason, n_hours AS hour_count,
 total AS total_active_sec_est FROM snap WHERE status <> 'complete'""")
def e26(spark, sf):
    return W.incomplete_days(snaps(spark, sf))


@query("e26_week_meta", """
SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, CAST(sum(total) AS BIGINT) AS total_active_sec_est, count(*) AS source_days,
 CASE WHEN count(*) FILTER (WHERE status <> 'complete') > 0 THEN 'incomplete' ELSE 'complete' END AS snapshot_status,
 COALESCE(string_agg(CASE WHEN status <> 'complete' THEN day || ': ' || reason END, '|' ORDER BY day), '') AS incomplete_notes FROM snap GROUP BY ALL""")
def e26m(spark, sf):
    return W.week_meta(snaps(spark, sf))


@query("e27_validate_clusters", f"""
WITH {FB}, i AS (SELECT source_id, week_start, id, idx FROM fi),
u AS (SELECT source_id, week_start, id FROM i WHERE idx % 7 <> 3 UNION ALL SELECT source_id, week_start, id FROM i WHERE idx % 11 = 5 AND idx % 7 <> 3
  UNION ALL SELECT source_id, week_start, id || 'x' FROM i WHERE idx = 0)
SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, problem, id FROM (
 SELECT source_id, week_start, 'unassigned' AS problem, id FROM i WHERE idx % 7 = 3
 UNION ALL SELECT source_id, week_start, 'duplicate', id FROM u GROUP BY ALL HAVING count(*) > 1
 UNION ALL SELECT source_id, week_start, 'unknown', id || 'x' FROM i WHERE idx = 0
 UNION ALL SELECT DISTINCT source_id, week_start, 'empty', 'none' FROM i)""")
def e27(spark, sf):
    items = W.task_items(snaps(spark, sf))
    own = items.filter(F.col("idx") % 7 != 3)
    again = own.filter(F.col("idx") % 11 == 5)
    stray = items.filter(F.col("idx") == 0).withColumn("id", F.concat("id", F.lit("x")))
    flawed = own.unionByName(again).unionByName(stray).groupBy(*W.WEEK).agg(F.collect_list("id").alias("item_ids")).withColumn("cluster_id", F.lit("all"))
    none = items.select(*W.WEEK).distinct().withColumn("item_ids", F.array().cast("array<string>")).withColumn("cluster_id", F.lit("none"))
    return W.validate_clusters(items, flawed.unionByName(none))


@query("f5_week_calendar", f"""
WITH {NOTE}, wk AS (SELECT DISTINCT source_id, week_start FROM snap),
sp AS (SELECT source_id, week_start, week_start + CAST(i AS INTEGER) AS day FROM wk, range(0, 7) r(i))
SELECT sp.source_id, CAST(sp.week_start AS VARCHAR) AS week_start, CAST(sp.day AS VARCHAR) AS day, {WEEKDAY.format(d='sp.day')} AS weekday, COALESCE(n.titles[1], '') AS title,
 COALESCE(n.status, 'incomplete') AS status, CASE WHEN n.status IS NULL THEN 'snapshot_missing' ELSE n.reason END AS incomplete_reason, COALESCE(n.total, 0) AS total_active_sec_est
FROM sp LEFT JOIN (SELECT * FROM note WHERE extract(day FROM day) % 5 <> 0) n ON sp.source_id = n.source_id AND sp.day = n.day""")
def f5(spark, sf):
    notes = W.day_notes(snaps(spark, sf))
    kept = notes.filter(F.dayofmonth("day") % 5 != 0)
    return W.week_calendar(kept, notes.select(*W.WEEK).distinct()).select(
        *W.WEEK, "day", "weekday", "title", "status", "incomplete_reason", "total_active_sec_est")


@query("m4_cluster_week_tasks", """
WITH i AS (SELECT source_id, CAST(date_trunc('week', day) AS DATE) AS week_start, day, idx, day || ':' || idx AS id, title FROM hidx)
SELECT source_id, CAST(week_start AS VARCHAR) AS week_start, title AS canonical_task_name, string_agg(id, '|' ORDER BY day, idx) AS item_ids, 'model' AS strategy FROM i GROUP BY ALL""")
def m4(spark, sf):
    out = W.cluster_week_tasks(W.task_items(snaps(spark, sf)), W.rule_cluster_model)
    return out.drop("cluster_id", "confidence")


@query("m5_summarize_week", f"""
WITH {FALL}, x AS (SELECT source_id, week_start, count(*) AS n, arg_min(titles[1], day) AS t FROM note GROUP BY ALL)
SELECT f.source_id, CAST(f.week_start AS VARCHAR) AS week_start, x.t AS weekly_title, x.n || ' days' AS weekly_summary, f.weekly_detail, 'model' AS source
FROM fall f JOIN x ON f.source_id = x.source_id AND f.week_start = x.week_start""")
def m5(spark, sf):
    return W.summarize_week(W.day_notes(snaps(spark, sf)), W.rule_week_model).drop("highlights", "confidence")


REPORT = f"""{FALL}, tot AS (SELECT source_id, week_start, CAST(sum(total) AS BIGINT) AS s FROM snap GROUP BY ALL),
hm AS (SELECT *, CASE WHEN s >= 3600 THEN (s // 3600) || '時間' ELSE '' END || (s % 3600 // 60) || '分' AS hm FROM tot),
cal AS (SELECT k.source_id, k.week_start, k.week_start + CAST(i AS INTEGER) AS day FROM (SELECT DISTINCT source_id, week_start FROM snap) k, range(0, 7) r(i)),
dayl AS (SELECT c.source_id, c.week_start, c.day, COALESCE(n.total, 0) AS t, COALESCE(n.notes[1], '') AS ov, COALESCE(array_to_string(n.notes[2:], ' '), '') AS de
  FROM cal c LEFT JOIN note n ON c.source_id = n.source_id AND c.day = n.day),
dl AS (SELECT source_id, week_start, string_agg('### ' || day || '（' || {WEEKDAY.format(d='day')} || '）' || chr(10) || chr(10) || '- 推定作業時間: '
   || CASE WHEN t >= 3600 THEN (t // 3600) || '時間' ELSE '' END || (t % 3600 // 60) || '分'
   || CASE WHEN ov <> '' THEN chr(10) || chr(10) || ov ELSE '' END || CASE WHEN de <> '' AND de <> ov THEN chr(10) || chr(10) || de ELSE '' END
   || CASE WHEN ov = '' AND de = '' THEN chr(10) || chr(10) || '記録不足のため、この日の自然言語要約は生成できませんでした。' ELSE '' END || chr(10), chr(10) ORDER BY day) AS body FROM dayl GROUP BY ALL)
SELECT f.source_id, CAST(f.week_start AS VARCHAR) AS week_start, '# 週次レポート ' || f.week_start || ' - ' || (f.week_start + 6) || chr(10) || chr(10) || '%s'
  || '- 対象期間: ' || f.week_start || ' 〜 ' || (f.week_start + 6) || chr(10) || '- 推定総作業時間: ' || hm.hm || chr(10) || '- 対象日数: 7日' || chr(10) || chr(10)
  || '<details>' || chr(10) || '<summary>📊 LLMサマリー</summary>' || chr(10) || chr(10) || '- 対象期間: ' || f.week_start || ' 〜 ' || (f.week_start + 6) || chr(10)
  || '- 推定総作業時間: ' || hm.hm || chr(10) || '- 対象日数: 7日' || chr(10) || '- LLM使用量（内訳）:' || chr(10)
  || '  - weekly-clustering（タスククラスタリング）: 未実行' || chr(10) || '  - weekly-summary（総括生成）: 未実行' || chr(10)
  || '  - 合計: input 0 / output 0 tokens（cost: n/a / n/a）' || chr(10) || chr(10) || '</details>' || chr(10) || chr(10) || '## 今週の総括' || chr(10) || chr(10)
  || '- タイトル: ' || f.weekly_title || chr(10) || '- 概要: ' || f.weekly_summary || chr(10) || chr(10) || f.weekly_detail || chr(10) || chr(10)
  || '## 今週のハイライト' || chr(10) || chr(10) || array_to_string(list_transform(f.highlights, lambda h: '- ' || h), chr(10)) || chr(10) || chr(10)
  || '## 日別ログ' || chr(10) || chr(10) || rtrim(dl.body, chr(10)) || chr(10) AS report
FROM fall f JOIN hm ON f.source_id = hm.source_id AND f.week_start = hm.week_start JOIN dl ON f.source_id = dl.source_id AND f.week_start = dl.week_start"""


@query("a8_weekly_report_lines", f"WITH {REPORT.replace('%s', '')}")
def a8(spark, sf):
    s = snaps(spark, sf)
    notes = W.day_notes(s)
    return R.as_document(R.weekly_report_lines(W.week_meta(s), notes, W.week_summary_fallback(notes)), W.WEEK)


@query("a13_weekly_report_offline", f"WITH {REPORT.replace('%s', '- 生成方式: hour titles only' + chr(39) + ' || chr(10) || ' + chr(39))}")
def a13(spark, sf):
    return R.as_document(R.weekly_report_offline(snaps(spark, sf), "hour titles only"), W.WEEK)
