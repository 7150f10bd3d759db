"""Hour packs with labels, and the model jobs run with the rule-based model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymill.operators import enrich as M
from daymill.operators import filters as B
from daymill.operators import hours as H
from daymill.operators import stats as ST
from daymill.operators.ordered import GROUP, pack_batches
from daymill.plans import report as R
from daymill.plans.catalog.base import near_duplicate_sql, query
from daymill.plans.catalog.segments import job, text_job
from daymill.sources import samples as A

# Hours below this stay unlabelled in these queries, so fallbacks are exercised.
MIN_SEC = 1000

LAB = f"""lab AS (SELECT source_id, day, hr, COALESCE(labels[1], '') AS hour_title, obs AS hour_summary FROM packs
  WHERE active_sec >= {MIN_SEC} AND (len(labels) > 0 OR len(texts) > 0)),
lp AS (SELECT p.*, COALESCE(l.hour_title, '') AS lt, COALESCE(l.hour_summary, '') AS ls, l.hour_title IS NOT NULL AS has FROM packs p
  LEFT JOIN lab l ON p.source_id = l.source_id AND p.day = l.day AND p.hr = l.hr)"""
KEY = "source_id, CAST(day AS VARCHAR) AS day, hour_start_ts"
DI = f"""{LAB}, di AS (SELECT source_id, day, hr, hour_start_ts, hour_end_ts, active_sec // 60 AS active_min_est,
   CASE WHEN lt <> '' THEN lt WHEN len(labels) > 0 THEN labels[1] ELSE obs END AS hour_title, CASE WHEN ls <> '' THEN ls ELSE obs END AS hour_summary FROM lp)"""
DAILY = f"""{DI}, dn AS (SELECT *, row_number() OVER (PARTITION BY source_id, day ORDER BY hr) - 1 AS i FROM di WHERE hour_title <> '' OR hour_summary <> ''),
dc AS (SELECT source_id, day, i // 4 AS c, arg_min(hour_title, i) FILTER (WHERE hour_title <> '') AS t FROM dn GROUP BY ALL),
dt AS (SELECT source_id, day, count(*) AS chunks FROM dc GROUP BY ALL),
tt AS (SELECT dc.source_id, dc.day, dc.t AS t, min(c) AS at1 FROM dc JOIN dt ON dc.source_id = dt.source_id AND dc.day = dt.day WHERE chunks > 1 GROUP BY ALL
  UNION ALL SELECT dn.source_id, dn.day, dn.hour_title, min(i) FROM dn JOIN dt ON dn.source_id = dt.source_id AND dn.day = dt.day WHERE chunks = 1 AND hour_title <> '' GROUP BY ALL),
daily AS (SELECT source_id, day, arg_min(t, at1) AS daily_title, string_agg(t, ', ' ORDER BY at1) AS daily_summary FROM tt GROUP BY ALL)"""
OV = f"""ov AS (SELECT *, CASE WHEN lt <> '' THEN lt ELSE COALESCE(labels[1], '') END AS t, ls AS s FROM lp)"""


def packs(spark, sf) -> DataFrame:
    return text_job(spark, sf).packs


def hour_labels(spark, sf) -> DataFrame:
    j = text_job(spark, sf)
    return M.label_hours(j.packs, j.clusters, j.timeline, min_sec=MIN_SEC)


def labelled(spark, sf) -> DataFrame:
    return H.with_labels(packs(spark, sf), hour_labels(spark, sf))


@query("c7_hours_overview", f"WITH {LAB}, {OV} SELECT {KEY}, hour_end_ts, t AS hour_title, s AS hour_summary FROM ov WHERE t <> '' OR s <> ''")
def c7(spark, sf):
    return H.hours_overview(labelled(spark, sf)).drop("hour_key")


@query("c8_daily_inputs", f"WITH {DI} SELECT {KEY}, hour_end_ts, active_min_est, hour_title, hour_summary FROM di WHERE hour_title <> '' OR hour_summary <> ''")
def c8(spark, sf):
    return H.daily_inputs(labelled(spark, sf)).drop("hour_key")


@query("c9_hour_observation", f"SELECT {KEY}, obs AS observation FROM packs")
def c9(spark, sf):
    return packs(spark, sf).select(*GROUP, "hour_start_ts", "observation")


@query("c10_hour_cluster_labels", f"SELECT {KEY}, array_to_string(labels, '|') AS cluster_labels FROM packs")
def c10(spark, sf):
    return packs(spark, sf).select(*GROUP, "hour_start_ts", "cluster_labels")


@query("c11_hourly_model_input", f"SELECT {KEY}, active_sec AS active_sec_est, len(labels) AS clusters, len(texts) AS texts FROM packs WHERE len(labels) > 0 OR len(texts) > 0")
def c11(spark, sf):
    n = lambda p: F.json_array_length(F.get_json_object("payload", p)).cast("long")
    j = text_job(spark, sf)
    return H.hourly_model_input(j.packs, j.clusters, j.timeline).select(
        *GROUP, F.get_json_object("payload", "$.hour_start_ts").alias("hour_start_ts"), "active_sec_est",
        n("$.clusters").alias("clusters"), n("$.hour_common_texts").alias("texts"))


@query("m1_label_hours", f"WITH {LAB} SELECT source_id, CAST(day AS VARCHAR) AS day, strftime(hr, '%H') AS hour, hour_title, hour_summary FROM lab")
def m1(spark, sf):
    return hour_labels(spark, sf).select(
        *GROUP, F.date_format("hour_key", "HH").alias("hour"), "hour_title", "hour_summary")


@query("f6_missing_hours", f"WITH {LAB} SELECT source_id, CAST(day AS VARCHAR) AS day, strftime(hr, '%H') AS hour FROM lp WHERE active_sec >= 120 AND NOT has")
def f6(spark, sf):
    p = packs(spark, sf)
    want = B.eligible_hours(p, GROUP)
    return M.missing_keys(want, hour_labels(spark, sf), H.HOUR).select(*GROUP, F.date_format("hour_key", "HH").alias("hour"))


@query("m2_summarize_day", f"WITH {DAILY} SELECT source_id, CAST(day AS VARCHAR) AS day, daily_title, daily_summary FROM daily")
def m2(spark, sf):
    return M.summarize_day(H.daily_inputs(labelled(spark, sf))).select(*GROUP, "daily_title", "daily_summary")


def enriched(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    lab = labelled(spark, sf)
    daily = M.summarize_day(H.daily_inputs(lab))
    return lab, daily, M.enrich_hours(H.hours_overview(lab), daily)


@query("m3_enrich_hours", f"""WITH {DAILY}, {OV} SELECT ov.source_id, CAST(ov.day AS VARCHAR) AS day, strftime(ov.hr, '%H') AS hour, t AS hour_title_enriched,
 t || ' (' || daily_title || ')' AS hour_summary_enriched FROM ov JOIN daily ON ov.source_id = daily.source_id AND ov.day = daily.day WHERE t <> '' OR s <> ''""")
def m3(spark, sf):
    return enriched(spark, sf)[2].select(*GROUP, F.date_format("hour_key", "HH").alias("hour"), "hour_title_enriched", "hour_summary_enriched")


@query("f2_hours_with_labels", f"""WITH {DAILY}, {OV} SELECT {KEY.replace('source_id', 'ov.source_id', 1).replace('day', 'ov.day', 1)}, lt AS hour_title, ls AS hour_summary,
 CASE WHEN t <> '' OR s <> '' THEN t ELSE '' END AS hour_title_enriched FROM ov""")
def f2(spark, sf):
    lab, _, enr = enriched(spark, sf)
    base = lab.drop("hour_title", "hour_summary", "confidence", "hour_title_enriched", "hour_summary_enriched")
    labels = lab.filter("confidence > 0").select(*H.HOUR, "hour_title", "hour_summary", "confidence", F.lit(1).alias("version"))
    return H.with_labels(base, labels, enr).select(*GROUP, "hour_start_ts", "hour_title", "hour_summary", "hour_title_enriched")


@query("c15_snapshot_hours", f"""WITH {LAB} SELECT {KEY}, hour_end_ts, active_sec AS active_sec_est, lt AS hour_title, ls AS hour_summary,
 array_to_string(labels, '|') AS cluster_labels, CASE WHEN has THEN '0.50' ELSE '0.00' END AS confidence FROM lp""")
def c15(spark, sf):
    return H.snapshot_hours(labelled(spark, sf)).select(
        *GROUP, "hour_start_ts", "hour_end_ts", "active_sec_est", "hour_title", "hour_summary", "cluster_labels",
        F.format_string("%.2f", "confidence").alias("confidence"))


@query("c16_hour_timeline_rows", f"""WITH {LAB} SELECT {KEY}, active_sec // 60 AS active_min, CASE WHEN lt <> '' THEN lt WHEN labels[1] IS NOT NULL THEN labels[1] ELSE '（不明）' END AS display_title,
 CASE WHEN ls <> '' THEN ls ELSE obs END AS display_summary, array_to_string(labels, ', ') AS screens FROM lp""")
def c16(spark, sf):
    return H.hour_timeline_rows(labelled(spark, sf)).select(
        *GROUP, "hour_start_ts", "active_min", "display_title", "display_summary", "screens")


@query("c16_hour_intents", f"""WITH {DAILY}, {OV}, x AS (SELECT ov.source_id, ov.day, ov.hour_start_ts, CASE WHEN ls <> '' THEN ls ELSE obs END AS shown,
  CASE WHEN t <> '' OR s <> '' THEN t || ' (' || daily_title || ')' ELSE '' END AS rich
  FROM ov LEFT JOIN daily ON ov.source_id = daily.source_id AND ov.day = daily.day)
SELECT {KEY}, CASE WHEN rich = '' THEN '' WHEN {near_duplicate_sql('x.shown', 'x.rich')} THEN '（観測の要約と近いため省略）' ELSE rich END AS intent FROM x""")
def c16i(spark, sf):
    lab, _, enr = enriched(spark, sf)
    both = lab.drop("hour_title_enriched", "hour_summary_enriched").join(enr.drop("version"), H.HOUR, "left")
    both = both.withColumn("hour_summary_enriched", F.coalesce("hour_summary_enriched", F.lit("")))
    return H.hour_timeline_rows(both).select(*GROUP, "hour_start_ts", "intent")


def day_lines(spark, sf) -> DataFrame:
    """Day reports over the light hour rows (titles by context, no screen text)."""
    j = job(spark, sf)
    lab = A.hour_rows(spark, sf).withColumn("hour_title_enriched", F.lit("")).withColumn("hour_summary_enriched", F.lit("")).withColumn(
        "observation", F.lit("")).withColumn("confidence", F.lit(0.5))
    rows = H.hour_timeline_rows(lab).join(lab.select(*H.HOUR, "hour_summary"), H.HOUR)
    return R.daily_report_lines(ST.capture_counts(j.events), ST.record_period(j.events), ST.day_totals(j.segments, j.hours), rows)


_HM = lambda x: f"CASE WHEN {x} >= 3600 THEN ({x} // 3600) || '時間' ELSE '' END || ({x} % 3600 // 60) || '分'"


@query("a7_daily_report_lines", f"""
WITH c AS (SELECT source_id, day, count(*) AS n, count(*) FILTER (WHERE NOT excl AND NOT err) AS v, count(*) FILTER (WHERE excl) AS x, count(*) FILTER (WHERE err) AS e,
   min(ts) AS a, max(ts) AS b, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS w FROM ev GROUP BY ALL),
t AS (SELECT h.source_id, h.day, h.f, COALESCE(s.g, 0) AS g FROM (SELECT source_id, day, CAST(sum(active_sec) AS BIGINT) AS f FROM hours GROUP BY ALL) h
   LEFT JOIN (SELECT source_id, day, CAST(sum(duration_sec) AS BIGINT) AS g FROM segt GROUP BY ALL) s ON h.source_id = s.source_id AND h.day = s.day),
tt AS (SELECT source_id, day, list(title ORDER BY i) AS l FROM (SELECT source_id, day, title, min(idx) AS i FROM hidx GROUP BY ALL) GROUP BY ALL),
sm AS (SELECT source_id, day, arg_min(CASE WHEN length(summary) > 90 THEN rtrim(left(summary, 89)) || '…' ELSE summary END, idx) AS s FROM hidx WHERE summary <> '' GROUP BY ALL),
tl2 AS (SELECT source_id, day, string_agg('### ' || strftime(hr, '%H:00') || '〜' || strftime(hr, '%H:59') || '（推定稼働: ' || (active_sec // 60) || '分）' || chr(10) || chr(10) || '- 主な作業: ' || title
   || CASE WHEN summary <> '' THEN chr(10) || '- 概要: ' || summary ELSE '' END || chr(10) || '- 主な作業画面: ' || array_to_string(labels, ', ') || chr(10), chr(10) ORDER BY hr) AS body FROM hrow GROUP BY ALL)
SELECT c.source_id, CAST(c.day AS VARCHAR) AS day, '# 作業ログ ' || c.day || chr(10) || chr(10) || '<details>' || chr(10) || '<summary>📊 LLMサマリー</summary>' || chr(10) || chr(10)
 || '- 記録期間: ' || strftime(a, '%H:%M') || ' 〜 ' || strftime(b, '%H:%M') || CASE WHEN w > 0 THEN '（約' || {_HM('w')} || '）' ELSE '' END || chr(10)
 || '- キャプチャ数: ' || n || '回（有効 ' || v || ' / 除外 ' || x || ' / 失敗 ' || e || '）' || chr(10)
 || '- 推定総時間: ' || {_HM('g')} || '（有効分のみ） / ' || {_HM('f')} || '（除外・失敗も含む）' || chr(10) || '- LLM使用量（内訳）:' || chr(10)
 || '  - segment-llm（任意: enrich）: 未実行' || chr(10) || '  - hour-llm（タイムライン用）: 未実行' || chr(10) || '  - daily-llm（総括用）: 未実行' || chr(10)
 || '  - hour-enrich-llm（目的・意味付け）: 未実行' || chr(10) || '  - 合計: input 0 / output 0 tokens（cost: n/a / n/a）' || chr(10) || chr(10) || '</details>' || chr(10) || chr(10)
 || '## 本日のメイン作業（総括）' || chr(10) || chr(10) || '- 推定: ' || array_to_string(l, ' / ') || COALESCE(chr(10) || '- 概要: ' || sm.s, '') || chr(10) || chr(10) || '### ハイライト' || chr(10) || chr(10)
 || array_to_string(list_transform(l, lambda z: '- ' || z), chr(10)) || chr(10) || chr(10) || '## タイムライン（推定・1時間）' || chr(10) || chr(10) || tl2.body || chr(10) || chr(10)
 || '## 参考（データ品質）' || chr(10) || chr(10) || '- 除外: ' || x || '回' || chr(10) || '- スクショ/OCR失敗: ' || e || '回' || chr(10) AS report
FROM c JOIN t ON c.source_id = t.source_id AND c.day = t.day JOIN tt ON c.source_id = tt.source_id AND c.day = tt.day LEFT JOIN sm ON c.source_id = sm.source_id AND c.day = sm.day
JOIN tl2 ON c.source_id = tl2.source_id AND c.day = tl2.day""")
def a7(spark, sf):
    return R.as_document(day_lines(spark, sf), GROUP)


# ---- segment labels -----------------------------------------------------------------

@query("m6_label_segments", """SELECT source_id, CAST(day AS VARCHAR) AS day, seg AS segment_id, label AS task_title, captures || ' captures' AS task_summary, 'other' AS category
FROM segt""")
def m6(spark, sf):
    return M.label_segments(job(spark, sf).segments).drop("confidence")


def _shaky_enrich(items: list[dict]) -> M.Reply:
    """Fails at every fifth hour of a day, answers every seventh without a title, and counts a token per minute of the hour's start."""
    hours = [int(i["hour_start_ts"][11:13]) for i in items]
    if any(h % 5 == 0 for h in hours):
        raise TimeoutError("timed out")
    rows = [{"hour_start_ts": i["hour_start_ts"], "hour_title_enriched": i["hour_title"], "hour_summary_enriched": "" if h % 7 else None} for i, h in zip(items, hours)]
    return M.Reply(rows, "small", 10 * sum(hours), 0, len(items))


@query("m8_partial_stages", """SELECT source_id, CAST(day AS VARCHAR) AS day, count(*) AS asked, count(*) FILTER (WHERE h % 5 = 0 OR h % 7 = 0) AS lost,
 count(*) FILTER (WHERE h % 5 = 0) AS timed_out, count(*) FILTER (WHERE h % 5 = 0 OR h % 7 = 0) > 0 AS partial,
 CAST(10 * coalesce(sum(h) FILTER (WHERE h % 5 <> 0), 0) AS BIGINT) AS input_tokens, count(*) FILTER (WHERE h % 5 <> 0) AS output_tokens
FROM (SELECT source_id, day, CAST(extract(hour FROM hr) AS BIGINT) AS h FROM hrow) GROUP BY source_id, day""")
def m8_partial(spark, sf):
    rows = A.hour_rows(spark, sf)
    daily = rows.select(*GROUP).distinct().withColumns({"daily_title": F.lit("Day"), "daily_summary": F.lit("")})
    p = M.enrich_hours_pass(H.hours_overview(rows), daily, model_fn=_shaky_enrich)
    late = p.lost.groupBy(*GROUP).agg(F.count_if(F.col("reason") == "timed out").alias("timed_out"))
    return M.stage_summary(rows, p).join(late, list(GROUP), "left").select(
        *GROUP, "asked", "lost", F.coalesce("timed_out", F.lit(0)).alias("timed_out"), "partial", "input_tokens", "output_tokens")


@query("f1_segments_with_labels", """SELECT source_id, CAST(day AS VARCHAR) AS day, seg AS segment_id, label, CASE WHEN seg % 3 = 0 THEN '' WHEN seg % 3 = 1 THEN 'second ' || app ELSE 'first ' || app END AS task_title,
 CASE WHEN seg % 3 = 0 THEN '' ELSE 'dev' END AS category FROM segt""")
def f1(spark, sf):
    seg = job(spark, sf).segments
    base = seg.filter("segment_id % 3 <> 0")
    make = lambda df, v, word: df.select(
        *GROUP, "segment_id", F.concat(F.lit(word), "active_app").alias("task_title"), F.lit("").alias("task_summary"),
        F.lit("dev").alias("category"), F.lit(0.5).alias("confidence"), F.lit(v).alias("version"))
    labels = make(base, 1, "first ").unionByName(make(base.filter("segment_id % 3 = 1"), 2, "second "))
    return M.with_segment_labels(seg, labels, version="version").select(*GROUP, "segment_id", "label", "task_title", "category")


@query("m7_parse_model_output", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'fields missing or out of range' WHEN 2 THEN 'no JSON object' ELSE 'not JSON' END AS reject_reason,
 CASE WHEN turn % 4 = 0 THEN role END AS hour_title FROM conversations""")
def m7(spark, sf):
    t = A.table(spark, sf, "conversations")
    good = F.to_json(F.struct(
        F.lit("2024-01-01T00:00:00+00:00").alias("hour_start_ts"), F.lit("").alias("hour_end_ts"), F.col("role").alias("hour_title"),
        F.col("text").alias("hour_summary"), F.when(F.col("turn") % 4 == 0, 0.5).otherwise(1.5).alias("confidence")))
    m = F.col("turn") % 4
    out = F.when(m <= 1, F.concat(F.lit("Result: "), good, F.lit(" end"))).when(m == 2, F.lit("no result")).otherwise(F.lit("{bad json}"))
    raw = t.select("conv_id", "turn", out.alias("output"), F.lit(None).cast("string").alias("error"))
    fit, rejects = M.parse_model_output(raw, "hours")
    return fit.select("conv_id", "turn", F.lit("").alias("reject_reason"), "hour_title").unionByName(
        rejects.select("conv_id", "turn", "reject_reason", F.lit(None).cast("string").alias("hour_title")))


@query("g5_pack_batches", """
WITH RECURSIVE it AS (SELECT source_id, day, idx, greatest(2, length(title) + length(summary) + 60) AS sz FROM hidx),
pk AS (SELECT source_id, day, idx, CAST(0 AS BIGINT) AS batch, 1 AS n, 2 + sz + 1 AS chars FROM it WHERE idx = 0
 UNION ALL SELECT i.source_id, i.day, i.idx, CASE WHEN p.n >= 6 OR p.chars + i.sz + 1 > 600 THEN p.batch + 1 ELSE p.batch END,
  CASE WHEN p.n >= 6 OR p.chars + i.sz + 1 > 600 THEN 1 ELSE p.n + 1 END, CASE WHEN p.n >= 6 OR p.chars + i.sz + 1 > 600 THEN 2 ELSE p.chars END + i.sz + 1
 FROM pk p JOIN it i ON i.source_id = p.source_id AND i.day = p.day AND i.idx = p.idx + 1)
SELECT p.source_id, CAST(p.day AS VARCHAR) AS day, strftime(h.hr, '%H') AS hour, batch FROM pk p JOIN hidx h ON p.source_id = h.source_id AND p.day = h.day AND p.idx = h.idx""")
def g5(spark, sf):
    rows = A.hour_rows(spark, sf)
    size = F.length("hour_title") + F.length("hour_summary") + 60
    return pack_batches(rows, GROUP, ["hour_key"], size, 6, 600).select(*GROUP, F.date_format("hour_key", "HH").alias("hour"), "batch")
