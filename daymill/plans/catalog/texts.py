"""Text expressions, keywords and predicates over the document tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daymill.functions import text as T
from daymill.functions import timefmt as TF
from daymill.functions.similarity import with_near_duplicate
from daymill.operators import texts as X
from daymill.operators.context import select_primary_text
from daymill.operators.ordered import first_seen, ordered_distinct
from daymill.plans.catalog.base import TS, near_duplicate_sql, query
from daymill.plans.catalog.segments import job, text_job
from daymill.session import spread
from daymill.sources import samples as A



def docs(spark, sf):
    return spread(A.table(spark, sf, "documents"), "doc_id")


def pages(spark, sf):
    return A.table(spark, sf, "pages")


@query("i1_shorten", """
SELECT doc_id, md5(col) AS collapsed_md5, CASE WHEN length(col) > 80 THEN rtrim(left(col, 79)) || '…' ELSE col END AS short FROM coldoc""")
def i1(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.collapse(F.col("text"))).alias("collapsed_md5"), T.shorten(F.col("text")).alias("short"))


@query("i2_shorten_path", r"""
WITH p AS (SELECT page_id, '~/' || regexp_replace(url, '^https?://', '') AS s FROM pages)
SELECT page_id, CASE WHEN length(s) > 30 THEN '…' || right(s, 29) ELSE s END AS path FROM p""")
def i2(spark, sf):
    path = F.concat(F.lit("/Users/someone/"), F.regexp_replace("url", "^https?://", ""))
    return pages(spark, sf).select("page_id", T.shorten_path(path, 30).alias("path"))


@query("i3_entity_text", "SELECT doc_id, md5(flat) AS flat_md5 FROM flatdoc")
def i3(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.entity_text(F.col("text"))).alias("flat_md5"))


@query("i4_extract_urls", "SELECT doc_id, tok AS url FROM docurl")
def i4(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(T.extract_urls(T.entity_text(F.col("text")))).alias("url"))


@query("i4_page_urls", r"""
WITH u AS (SELECT page_id, regexp_replace(url, '[).,;:】]+$', '') AS r FROM pages)
SELECT page_id, regexp_extract(r, '^https?://([^/?#]*)', 1) || regexp_replace(regexp_extract(r, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS url FROM u""")
def i4p(spark, sf):
    text = F.concat(F.lit("open "), F.col("url"), F.lit(" now"))
    return pages(spark, sf).select("page_id", F.explode(T.extract_urls(T.entity_text(text))).alias("url"))


@query("i5_extract_paths", r"""
SELECT page_id, '/opt/data/' || regexp_extract(url, '^https?://([^/?#]*)', 1) || '/Contents/' || page_id AS path FROM pages""")
def i5(spark, sf):
    text = F.concat(F.lit("see /opt/data/"), T.url_authority(F.col("url")), F.lit("/Con\ntents/"), F.col("page_id"))
    return pages(spark, sf).select("page_id", F.explode(T.extract_paths(text)).alias("path"))


@query("i6_tokens", """
SELECT f.doc_id, len(regexp_extract_all(flat, '[A-Za-z0-9_./-]{4,}')) AS words, len(regexp_extract_all(flat, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9faf}]{2,}')) AS ja_runs,
 COALESCE(n.files, 0) AS files FROM flatdoc f LEFT JOIN (SELECT doc_id, count(*) AS files FROM docfile GROUP BY doc_id) n ON f.doc_id = n.doc_id""")
def i6(spark, sf):
    flat = docs(spark, sf).select("doc_id", T.entity_text(F.col("text")).alias("flat"))
    size = lambda f: F.size(f(F.col("flat"))).cast("long")
    return flat.select("doc_id", size(T.extract_words).alias("words"), size(T.extract_ja_runs).alias("ja_runs"), size(T.extract_files).alias("files"))


# ---- fixed values: sentence borders and dropped marks, stated for the SQL engine ----
SENT = """sp AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(col, '[▶→・|•]', '。', 'g'), '([。.!?！？]) +', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM coldoc),
sn AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM sp)"""
NORM = """regexp_replace(lower(s), '["''“”‘’（）()【】\\[\\]<>、。.!?！？・|•▶→]', '', 'g')"""


@query("i7_split_sentences", f"WITH {SENT} SELECT doc_id, pos, md5(s) AS sentence_md5 FROM sn WHERE s <> ''")
def i7(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "s")).select(
        "doc_id", "pos", F.md5("s").alias("sentence_md5"))


@query("i8_sentence_norm", f"WITH {SENT} SELECT doc_id, pos, md5({NORM}) AS norm_md5 FROM sn WHERE s <> ''")
def i8(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "s")).select(
        "doc_id", "pos", F.md5(T.sentence_norm(F.col("s"))).alias("norm_md5"))


@query("i9_common_text_norm", f"SELECT doc_id, replace({NORM.replace('lower(s)', 'lower(col)')}, ' ', '') AS norm FROM coldoc")
def i9(spark, sf):
    return docs(spark, sf).select("doc_id", T.common_text_norm(F.col("text")).alias("norm"))


@query("i10_similarity_norm", r"""
SELECT doc_id, md5(regexp_replace(lower(text), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}、。.,!?！？:：;；\-–—/\\()（）「」『』【】\[\]{}<>＜＞"''・]', '', 'g')) AS norm_md5 FROM documents""")
def i10(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.similarity_norm(F.col("text"))).alias("norm_md5"))


@query("i11_redact_derived", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\bsk-[A-Za-z0-9_\-]{12,}\b', 'sk-…', 'g'),
 '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED_EMAIL]', 'g')) AS text_md5 FROM documents""")
def i11(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.redact_derived(F.col("text"))).alias("text_md5"))


@query("i12_hour_buckets", f"""
WITH o AS (SELECT event_id, ts, CAST(user_id % 5 AS INTEGER) * 9 - 12 AS h FROM events)
SELECT event_id, strftime(date_trunc('hour', ts) - to_hours(h), {TS}) AS hour_key,
 strftime(ts, '%Y-%m-%dT%H:00:00') || CASE WHEN h < 0 THEN '-' ELSE '+' END || printf('%02d', abs(h)) || ':00' AS hour_start_ts,
 strftime(ts, '%Y-%m-%dT%H:59:59') || CASE WHEN h < 0 THEN '-' ELSE '+' END || printf('%02d', abs(h)) || ':00' AS hour_end_ts FROM o""")
def i12(spark, sf):
    h = (F.col("user_id") % 5) * 9 - 12
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), TF.offset_text(h * 3600))
    e = A.table(spark, sf, "events").select("event_id", iso.alias("iso")).select(
        "event_id", TF.parse_local(F.col("iso")).alias("local"), TF.offset_seconds(F.col("iso")).alias("off"))
    start = TF.iso_text(TF.hour_start(F.col("local")), F.col("off"))
    return e.select("event_id", TF.hour_key(F.col("local"), F.col("off")).alias("hour_key"), start.alias("hour_start_ts"),
                    TF.hour_end_text(start).alias("hour_end_ts"))


@query("i13_duration_texts", """
SELECT source_id, CAST(day AS VARCHAR) AS day, strftime(hr, '%H:%M') AS hour, strftime(hr, '%y/%m/%d ') || CAST(extract(hour FROM hr) AS VARCHAR) || ':00' AS seen,
 CASE WHEN active_sec >= 3600 THEN CAST(active_sec // 3600 AS VARCHAR) || '時間' ELSE '' END || CAST(active_sec % 3600 // 60 AS VARCHAR) || '分' AS length FROM hours""")
def i13(spark, sf):
    h = job(spark, sf).hours
    return h.select("source_id", "day", F.date_format("hour_key", "HH:mm").alias("hour"), TF.last_seen_text(F.col("hour_key")).alias("seen"),
                    TF.duration_text(F.col("active_sec_est")).alias("length"))


@query("i14_usage_tier", """
WITH a AS (SELECT source_id, app, CAST(sum(duration_sec) AS BIGINT) AS sec FROM segt GROUP BY ALL), m AS (SELECT *, max(sec) OVER (PARTITION BY source_id) AS top FROM a)
SELECT source_id, app AS active_app, sec AS duration_sec, CASE WHEN top <= 0 THEN '少' WHEN sec = top THEN '最多' WHEN sec / top >= 0.66 THEN '多'
 WHEN sec / top >= 0.33 THEN '中' ELSE '少' END AS tier FROM m""")
def i14(spark, sf):
    apps = job(spark, sf).segments.groupBy("source_id", "active_app").agg(F.sum("duration_sec").alias("duration_sec"))
    top = F.max("duration_sec").over(Window.partitionBy("source_id"))
    return apps.withColumn("_top", top).select(
        "source_id", "active_app", "duration_sec", TF.usage_tier(F.col("duration_sec"), F.col("_top")).alias("tier"))


@query("i16_week_dates", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT CAST(d AS VARCHAR) AS day, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS week_start, CAST(CAST(date_trunc('week', d) AS DATE) + 6 AS VARCHAR) AS week_end,
 CAST(CAST(date_trunc('week', d) AS DATE) - 7 AS VARCHAR) AS previous_week, isodow(d) = 1 AS is_monday,
 (['月', '火', '水', '木', '金', '土', '日'])[isodow(d)] AS weekday FROM d""")
def i16(spark, sf):
    d = A.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    c = F.col("day")
    return d.select("day", TF.week_start(c).alias("week_start"), TF.week_end(c).alias("week_end"),
                    TF.previous_week_start(c).alias("previous_week"), TF.is_monday(c).alias("is_monday"), TF.weekday_name(c).alias("weekday"))


@query("i18_json_chars", """SELECT conv_id, turn, length('{"conv_id":' || conv_id || ',"role":"' || role || '","text":"' ||
 replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"}') AS chars FROM conversations""")
def i18(spark, sf):
    t = A.table(spark, sf, "conversations")
    return t.select("conv_id", "turn", T.json_chars(F.struct("conv_id", "role", "text")).alias("chars"))


@query("i19_safe_file_title", r"""
WITH a AS (SELECT doc_id, trim(trim(regexp_replace(regexp_replace(col, '[\\/:*?"<>|]', '-', 'g'), '\s+', ' ', 'g')), ' .') AS s FROM coldoc)
SELECT doc_id, CASE WHEN length(s) > 80 THEN rtrim(left(s, 80)) ELSE s END AS title FROM a""")
def i19(spark, sf):
    return docs(spark, sf).select("doc_id", T.safe_file_title(F.col("text")).alias("title"))


@query("i20_display_number", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 30 END AS display FROM events")
def i20(spark, sf):
    n = F.col("event_id")
    stem = F.when(n % 3 == 0, F.concat(F.lit("shot-"), n)).otherwise(F.concat(F.lit("shot-"), n, F.lit("-d"), n % 30))
    return A.table(spark, sf, "events").select("event_id", T.display_number(stem).alias("display"))


@query("i21_labelled_json", """SELECT conv_id, turn, turn % 2 = 0 AS has_json, CASE WHEN turn % 2 = 0 THEN conv_id END AS id FROM conversations""")
def i21(spark, sf):
    body = F.concat(F.lit("Label: "), F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("conv_id").alias("id")))).otherwise("none"), F.lit(" done"))
    found = T.labelled_json(body)
    t = A.table(spark, sf, "conversations")
    return t.select("conv_id", "turn", (found != "").alias("has_json"), F.from_json(found, "id bigint")["id"].alias("id"))


@query("b9_is_toolish_text", """SELECT doc_id, contains(col, 'http') OR contains(col, '.com') OR contains(col, ' / ') OR contains(col, 'Google Chrome') AS toolish FROM coldoc""")
def b9(spark, sf):
    return docs(spark, sf).select("doc_id", T.is_toolish(F.col("text")).alias("toolish"))


@query("b10_is_abstract_text", r"""
WITH t AS (SELECT doc_id, CASE lang WHEN 'de' THEN '確認して整理 ' WHEN 'es' THEN '確認 README.md ' WHEN 'fr' THEN '情報 ' ELSE '' END || text AS t FROM documents)
SELECT doc_id, NOT regexp_matches(t, '(?i)(~/|/Users/|github\.com|openai\.com|chatgpt\.com|\.py|\.md|\.jsonl?|\.app|2>&1)')
 AND contains(t, '確認') AND contains(t, '整理') AS abstract FROM t""")
def b10(spark, sf):
    lead = F.when(F.col("lang") == "de", "確認して整理 ").when(F.col("lang") == "es", "確認 README.md ").when(
        F.col("lang") == "fr", "情報 ").otherwise("")
    return docs(spark, sf).select("doc_id", T.is_abstract(F.concat(lead, F.col("text"))).alias("abstract"))


@query("b11_is_near_duplicate", f"""
WITH t AS (SELECT a.conv_id, a.turn, a.text, coalesce(b.text, '') AS prev FROM conversations a
    LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
k AS (SELECT conv_id, turn, 'prev' AS kind, text, prev AS other FROM t
    UNION ALL SELECT conv_id, turn, 'edited', text, regexp_replace(text, '([0-9A-Za-z_]+)[ \\t\\n\\x0b\\f\\r]', '\\1, ', 'g') FROM t)
SELECT conv_id, turn, kind, {near_duplicate_sql('k.text', 'k.other')} AS is_near_duplicate FROM k""")
def b11(spark, sf):
    """Turn texts next to the previous turn's text and to a lightly edited copy."""
    turns = A.table(spark, sf, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    t = turns.join(before, ["conv_id", "turn"], "left")
    edited = F.regexp_replace("text", r"(\w+)\s", "$1, ")
    both = t.select("conv_id", "turn", F.lit("prev").alias("kind"), "text", F.coalesce("prev", F.lit("")).alias("other")).unionByName(
        t.select("conv_id", "turn", F.lit("edited").alias("kind"), "text", edited.alias("other")))
    return with_near_duplicate(both, "text", "other").select("conv_id", "turn", "kind", "is_near_duplicate")


@query("b12_has_retryable_error", "SELECT doc_id, " + " OR ".join(
    f"contains(lower(text), '{t}')" for t in ["timed out", "timeout", "tempor", "rate limit", "429", "500", "502", "503", "504",
                                              "service unavailable", "connection reset", "broken pipe"]) + " AS retryable FROM documents")
def b12(spark, sf):
    return docs(spark, sf).select("doc_id", T.has_retryable_error(F.col("text")).alias("retryable"))


@query("e22_top_keywords", """
SELECT doc_id, token, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord_at) AS rank FROM (
 SELECT doc_id, token, count(*) AS hits, min(ord_at) AS ord_at FROM dochit WHERE token <> '' GROUP BY doc_id, token)) WHERE rank <= 8""")
def e22(spark, sf):
    return X.top_keywords(docs(spark, sf), ["doc_id"], "text")


@query("e23_segment_keywords", """
WITH pd AS (SELECT s.source_id, s.day, s.seg, s.seq, s.ts, CASE WHEN s.old THEN s.d1 WHEN s.act = 1 THEN CASE WHEN NOT s.off1 THEN s.d1 WHEN NOT s.off2 THEN s.d2 END
   ELSE CASE WHEN NOT s.off2 THEN s.d2 WHEN NOT s.off1 THEN s.d1 END END AS doc FROM (
   SELECT *, CAST(floor(seq / 4) AS BIGINT) % (SELECT n FROM docn) AS d1, (CAST(floor(seq / 4) AS BIGINT) % (SELECT n FROM docn) + 1) % (SELECT n FROM docn) AS d2 FROM ses) s),
dt AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY ord_at) AS p FROM (SELECT doc_id, token, min(ord_at) AS ord_at FROM dochit WHERE token <> '' GROUP BY ALL)),
c AS (SELECT source_id, day, seg, token, count(*) AS hits, min((ts, seq, p)) AS ord_at FROM pd JOIN dt ON pd.doc = dt.doc_id GROUP BY ALL)
SELECT source_id, CAST(day AS VARCHAR) AS day, seg AS segment_id, token, hits, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY source_id, day, seg ORDER BY hits DESC, ord_at) AS rank FROM c) WHERE rank <= 8""")
def e23(spark, sf):
    return text_job(spark, sf).keywords


@query("e23_segment_snippets")
def e23s(spark, sf):
    return text_job(spark, sf).snippets


@query("g3_first_seen", """
WITH a AS (SELECT doc_id, pos, sent, norm FROM docsent WHERE norm <> '') SELECT md5(norm) AS norm_md5, count(*) AS hits,
 md5(arg_min(sent, (doc_id, pos))) AS first_md5, min(doc_id) AS first_doc FROM a GROUP BY norm""")
def g3(spark, sf):
    s = docs(spark, sf).select("doc_id", F.posexplode(T.split_sentences(T.entity_text(F.col("text")))).alias("pos", "s"))
    n = s.select("doc_id", "pos", "s", T.sentence_norm(F.col("s")).alias("norm")).filter("norm <> ''")
    seen = first_seen(n, "norm", ["doc_id", "pos"], shown="s")
    return seen.select(
        F.lower(F.hex(F.substring("text_key", 1, 16))).alias("norm_md5"), "hits", F.md5("first.text").alias("first_md5"), F.col("first.doc_id").alias("first_doc"))


@query("g4_ordered_distinct", """
WITH w0 AS (SELECT lang, doc_id, string_split(col, ' ') AS ts FROM coldoc JOIN (SELECT doc_id AS d2, lang FROM documents) l ON coldoc.doc_id = l.d2),
w AS (SELECT lang, doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM w0),
f AS (SELECT lang, lower(t) AS low, arg_min(t, (doc_id, p)) AS text, min((doc_id, p)) AS ord_at FROM w WHERE t <> '' GROUP BY ALL)
SELECT lang, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ord_at) AS rank FROM f) WHERE rank <= 25""")
def g4(spark, sf):
    # a document gives each of its words once, in the order in which they first stand
    words = docs(spark, sf).select("lang", "doc_id", F.posexplode(F.array_distinct(F.split(T.collapse(F.col("text")), " "))).alias("p", "t"))
    return ordered_distinct(words, ["lang"], "t", F.struct("doc_id", "p"), 25)


@query("g6_rank_evidence", """
WITH tk AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY ord_at) AS p FROM (SELECT doc_id, token, min(ord_at) AS ord_at FROM dochit GROUP BY ALL)),
s AS (SELECT doc_id, p, token, CASE WHEN length(token) <= 2 OR regexp_matches(token, '^[•\\s←→-]+$') THEN -10 WHEN regexp_matches(token, '^[A-Z0-9]{1,3}$') THEN -6 ELSE
  CASE WHEN contains(token, 'platform.openai.com') THEN 8 ELSE 0 END + CASE WHEN contains(token, 'openai.com') THEN 5 ELSE 0 END + CASE WHEN contains(token, 'github.com') THEN 7 ELSE 0 END
  + CASE WHEN contains(token, 'chatgpt.com') THEN 5 ELSE 0 END + CASE WHEN contains(token, '2>&1') THEN 3 ELSE 0 END
  + CASE WHEN starts_with(token, '/') OR starts_with(token, '~/') OR regexp_matches(token, '(?i)(github\\.com|openai\\.com|chatgpt\\.com|calendar\\.google\\.com)/') THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(token, '\\.[A-Za-z0-9]{2,5}\\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(token, '(?i)\\bREADME\\.md\\b') THEN 2 ELSE 0 END
  - CASE WHEN length(token) - length(replace(token, 'x', '')) >= 6 THEN 4 ELSE 0 END END AS sc FROM tk)
SELECT d.doc_id, COALESCE(e.ev, '') AS evidence FROM documents d LEFT JOIN (
 SELECT doc_id, string_agg(token, ' / ' ORDER BY sc DESC, p) AS ev FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, p) AS r FROM s WHERE sc > 0) WHERE r <= 3 GROUP BY doc_id) e
ON d.doc_id = e.doc_id""")
def g6(spark, sf):
    return docs(spark, sf).select("doc_id", T.rank_evidence(F.array_distinct(T.keyword_hits(F.col("text")))).alias("evidence"))


@query("g7_rank_snippets")
def g7(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.rank_snippets(F.col("text"))).alias("pos", "snippet"))
