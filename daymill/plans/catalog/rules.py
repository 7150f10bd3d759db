"""Exclusion rules, event projections, power states and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymill.functions import redact as R
from daymill.functions import text as T
from daymill.operators import context as C
from daymill.operators import filters as B
from daymill.operators.ordered import asof_latest
from daymill.operators.redaction import redaction_audit
from daymill.plans.catalog.base import TS, query
from daymill.session import spread
from daymill.sources import samples as A

HINTS = ["token", "licensed"]
DOC_RULES = B.ExclusionRules(apps=["SRC3"], domain_keywords=["FR.", "zz"], text_keywords=["token", "Licensed", "the "])
EVENT_RULES = B.ExclusionRules(apps=["PURCHASE"], domain_keywords=["U2.EX"], text_keywords=["token", "licensed", "The "])

# ---- fixed values: redaction patterns and marks, stated for the SQL engine ----
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?\d{1,3}[- ]?)?(?:\(?\d{2,4}\)?[- ]?)?\d{2,4}[- ]?\d{3,4}\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
AUTH = r"(?i)\b(?:token|licensed)\b"
PAIR = "(?i)\\b(token|licensed)\\b\\s*[:=]\\s*([^\\s''\"`]{6,})"
SECRETS = [
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"\bsk-[A-Za-z0-9]{10,}\b", "[REDACTED_API_KEY]"),
    (r"\b(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{10,}\b", "[REDACTED_TOKEN]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_TOKEN]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED_TOKEN]"),
]
TERMS = [
    (r"(?i)\b(?:porn|pornhub|onlyfans|hentai)\b", "[REDACTED_ADULT]"),
    (r"(?i)\b(?:sex|sexual|xxx)\b", "[REDACTED_ADULT]"),
    ("(?:エロ|アダルト|ポルノ|性行為|自慰|オナニー|AV|エッチ)", "[REDACTED_ADULT]"),
    (r"(?i)\b(?:suicide|self[- ]harm)\b", "[REDACTED_SELF_HARM]"),
    ("(?:自殺|自傷)", "[REDACTED_SELF_HARM]"),
]


def chain_sql(x: str, rules) -> str:
    for pattern, tag in rules:
        x = f"regexp_replace({x}, '{pattern}', '{tag}', 'g')"
    return x


def card_sql(src: str) -> str:
    """CTE body: ``src(doc_id, t)`` with checksum-valid cards masked.

    Borders are found on a copy whose letters are all 'a', because the SQL engine's
    word border knows ASCII letters only; the pieces are then cut from the text itself.
    """
    return f"""SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i:
      substr(t, CAST(1 + COALESCE(list_sum(list_transform(p[1:i - 1], lambda v: length(v))), 0)
        + COALESCE(list_sum(list_transform(h[1:i - 1], lambda v: length(v))), 0) AS BIGINT), length(p[i])) ||
      CASE WHEN i > len(h) THEN '' WHEN (list_sum(list_transform(range(1, len(d[i]) + 1), lambda j:
        CASE WHEN (len(d[i]) - j) % 2 = 0 THEN CAST(d[i][j] AS INT)
             WHEN CAST(d[i][j] AS INT) * 2 > 9 THEN CAST(d[i][j] AS INT) * 2 - 9 ELSE CAST(d[i][j] AS INT) * 2 END))) % 10 = 0
      THEN '[REDACTED_CARD]' ELSE h[i] END), '') AS t FROM (
      SELECT *, list_transform(h, lambda v: regexp_replace(v, '[^0-9]', '', 'g')) AS d FROM (
        SELECT doc_id, t, regexp_extract_all(sh, '{CARD}') AS h, string_split_regex(sh, '{CARD}') AS p FROM (
          SELECT doc_id, t, regexp_replace(t, '[\\p{{L}}\\p{{M}}]', 'a', 'g') AS sh FROM {src})))"""


def auth_sql(src: str) -> str:
    return f"""SELECT doc_id, CASE WHEN t = '' THEN t ELSE array_to_string(list_transform(range(1, len(l) + 1), lambda i:
      CASE WHEN f[i] OR (i > 1 AND f[i - 1]) OR (i < len(l) AND f[i + 1]) THEN '[REDACTED_AUTH]' ELSE l[i] END), chr(10)) END AS t FROM (
      SELECT *, list_transform(l, lambda v: regexp_matches(v, '{AUTH}')) AS f FROM (
        SELECT doc_id, t, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS l FROM (
          SELECT doc_id, t, string_split_regex(t, '{BREAK}') AS a FROM {src})))"""


DOC = "d0 AS (SELECT doc_id, text AS t FROM documents)"
OUT = "SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM"


def docs(spark, sf):
    return spread(A.table(spark, sf, "documents"), "doc_id")


def shown(df, c):
    return df.select("doc_id", c.alias("_t")).select("doc_id", F.md5("_t").alias("text_md5"), F.length("_t").alias("n"))


@query("b1_valid_events", "SELECT source_id, CAST(day AS VARCHAR) AS day, seq AS ingest_seq FROM ev WHERE NOT excl AND NOT err")
def b1(spark, sf):
    return B.valid_events(A.events(spark, sf)).select("source_id", "day", "ingest_seq")


DOC_REASON = """CASE WHEN lower(source) = 'src3' THEN 'app:' || source WHEN contains(lower(lang || '.site'), 'fr.') THEN 'domain_kw:FR.'
  WHEN contains(text, 'token') THEN 'text_kw:token' WHEN contains(text, 'Licensed') THEN 'text_kw:Licensed'
  WHEN contains(text, 'the ') THEN 'text_kw:the ' END"""


def doc_contexts(spark, sf):
    return docs(spark, sf).select(
        "doc_id", "text", F.col("source").alias("active_app"), F.lit("").alias("window_title"),
        F.struct(F.concat("lang", F.lit(".site")).alias("domain")).alias("browser"))


@query("b2_exclude_by_rules", f"SELECT doc_id, {DOC_REASON} AS rule_reason, {DOC_REASON} IS NOT NULL AS rule_excluded FROM documents")
def b2(spark, sf):
    return B.exclude_by_rules(doc_contexts(spark, sf), DOC_RULES, "text").select("doc_id", "rule_reason", "rule_excluded")


@query("f7_match_rules", f"SELECT doc_id, {DOC_REASON} AS rule_reason FROM documents")
def f7(spark, sf):
    rules = spark.createDataFrame(
        [("text_kw", "the ", 9), ("text_kw", "Licensed", 8), ("text_kw", "token", 7), ("domain_kw", "FR.", 2), ("app", "src3", 1)],
        "kind string, pattern string, rank int")
    df = doc_contexts(spark, sf)
    out = B.match_rules(df, rules, F.col("active_app"), F.col("browser.domain"), F.col("text"))
    return out.select("doc_id", "rule_reason")


def _doc_hit(t: str) -> str:
    return f"""CASE WHEN contains({t}, 'token') THEN 'text_kw:token' WHEN contains({t}, 'licensed')
      THEN 'text_kw:licensed' WHEN contains({t}, 'The ') THEN 'text_kw:The ' END"""


SHOWN2 = """s2 AS (SELECT e.*, CASE WHEN off1 THEN '' ELSE a.text END AS t1, CASE WHEN off2 THEN '' ELSE b.text END AS t2, a.text AS raw1
  FROM (SELECT *, CAST(floor(seq / 4) AS BIGINT) % (SELECT n FROM docn) AS d1 FROM ev) e
  JOIN documents a ON a.doc_id = e.d1 JOIN documents b ON b.doc_id = (e.d1 + 1) % (SELECT n FROM docn))"""


@query("b3_exclude_two_stage", f"""
WITH {SHOWN2}, j AS (SELECT *, CASE WHEN app = 'purchase' THEN 'app:purchase' WHEN contains(dom, 'u2.ex') THEN 'domain_kw:U2.EX' END AS meta,
   CASE WHEN NOT err AND NOT old THEN {_doc_hit('t1')} END AS r1, CASE WHEN NOT err AND NOT old THEN {_doc_hit('t2')} END AS r2 FROM s2)
SELECT seq AS ingest_seq, meta IS NOT NULL OR (NOT err AND NOT old AND r1 IS NOT NULL AND r2 IS NOT NULL) AS excluded,
  COALESCE(meta, CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN CASE WHEN r1 = r2 THEN r1 ELSE least(r1, r2) || ',' || greatest(r1, r2) END END) AS excluded_reason,
  CASE WHEN meta IS NOT NULL THEN '[REDACTED]' ELSE '' END AS window_title,
  CASE WHEN dom = '' THEN NULL WHEN meta IS NOT NULL THEN '' ELSE 'https://' || dom || '/p/' || k END AS url,
  CASE WHEN meta IS NOT NULL OR err OR old THEN md5('') ELSE md5(CASE WHEN r1 IS NULL THEN t1 ELSE '' END || '/' || CASE WHEN r2 IS NULL THEN t2 ELSE '' END) END AS shown_md5
FROM j""")
def b3(spark, sf):
    out = B.exclude_two_stage(A.events_with_text(spark, sf), EVENT_RULES)
    return out.select(
        "ingest_seq", "excluded", "excluded_reason", "window_title", F.col("browser.url").alias("url"),
        F.md5(F.array_join(F.transform("ocr_by_display", lambda d: d["ocr_text"]), "/")).alias("shown_md5"))


@query("b4_rollup_display_exclusion", f"""
WITH {SHOWN2} SELECT seq AS ingest_seq, excl AS excluded, CASE WHEN excl THEN 'text_kw:Billing,text_kw:Login' END AS excluded_reason,
  CASE WHEN err OR old THEN NULL WHEN act = 1 THEN off1 ELSE off2 END AS active_excluded,
  md5(CASE WHEN err OR old THEN '' WHEN act = 1 THEN t1 ELSE t2 END) AS active_md5 FROM s2""")
def b4(spark, sf):
    return A.events_with_text(spark, sf).transform(B.rollup_display_exclusion).select(
        "ingest_seq", "excluded", "excluded_reason", F.col("ocr_active_display_excluded").alias("active_excluded"),
        F.md5("ocr_active_display_text").alias("active_md5"))


POWER = """cap AS (SELECT source_id, ts, seq FROM ev WHERE app = 'purchase'),
pw AS (SELECT source_id, ts AS pts, CASE WHEN app = 'signup' THEN 'Sleep' ELSE 'Wake' END AS st FROM ev WHERE app IN ('signup', 'view')),
aso AS (SELECT cap.*, CASE WHEN epoch_us(ts) - epoch_us(pts) <= 900000000 THEN st END AS st,
  CASE WHEN epoch_us(ts) - epoch_us(pts) <= 900000000 THEN pts END AS pts
  FROM cap ASOF LEFT JOIN pw ON cap.source_id = pw.source_id AND cap.ts >= pw.pts)"""


def captures_and_power(spark, sf):
    ev = A.events(spark, sf).select("source_id", "ts", "ingest_seq", "active_app")
    power = ev.filter(F.col("active_app").isin("signup", "view")).withColumn(
        "power_state", F.when(F.col("active_app") == "signup", "Sleep").otherwise("Wake"))
    return ev.filter(F.col("active_app") == "purchase").drop("active_app"), power


@query("b5_drop_asleep_captures", f"WITH {POWER} SELECT source_id, seq AS ingest_seq FROM aso WHERE st IS NULL OR st <> 'Sleep'")
def b5(spark, sf):
    caps, power = captures_and_power(spark, sf)
    return B.drop_asleep_captures(caps, power).select("source_id", "ingest_seq")


@query("f8_asof_power", f"WITH {POWER} SELECT source_id, seq AS ingest_seq, st AS power_state, strftime(pts, {TS}) AS power_state_ts FROM aso")
def f8(spark, sf):
    caps, power = captures_and_power(spark, sf)
    return asof_latest(caps, power, ["source_id"], "power_state", 900).drop("ts")


PRIMARY = f"""{SHOWN2}, pt0 AS (SELECT *, CASE WHEN act = 1 THEN t1 ELSE t2 END AS own, CASE WHEN act = 1 THEN t2 ELSE t1 END AS oth,
   CASE WHEN act = 1 THEN off1 ELSE off2 END AS aoff FROM s2),
pt AS (SELECT seq, CASE WHEN err THEN '' WHEN old THEN trim(raw1, chr(32) || chr(10)) WHEN NOT aoff AND own <> '' THEN own ELSE trim(oth, chr(32) || chr(10)) END AS prim,
   CASE WHEN err OR old THEN '' ELSE trim(oth, chr(32) || chr(10)) END AS ref, (NOT err AND NOT old AND NOT aoff AND own <> '') AS used FROM pt0)"""


@query("c1_primary_text", f"WITH {PRIMARY} SELECT seq AS ingest_seq, md5(prim) AS primary_md5, md5(ref) AS reference_md5, used AS used_active_display FROM pt")
def c1(spark, sf):
    return A.events_with_text(spark, sf).transform(C.select_primary_text).select(
        "ingest_seq", F.md5("primary_text").alias("primary_md5"), F.md5("reference_text").alias("reference_md5"), "used_active_display")


@query("c2_primary_source", f"""WITH {PRIMARY} SELECT seq AS ingest_seq, CASE WHEN prim = '' THEN 'fallback_empty' WHEN used THEN 'active_display'
  ELSE 'fallback_all_displays' END AS primary_source FROM pt""")
def c2(spark, sf):
    p = A.events_with_text(spark, sf).transform(C.select_primary_text)
    return p.select("ingest_seq", C.primary_source(
        F.col("primary_text"), F.col("reference_text"), F.col("used_active_display"), F.col("ocr_text")).alias("primary_source"))


@query("c3_display_entries", """
SELECT e.seq AS ingest_seq, x.p AS entry_pos, x.p + 1 AS display, e.act = x.p + 1 AS is_active_display,
  md5(CASE WHEN x.off THEN '' ELSE f.flat END) AS text_md5
FROM (SELECT *, CAST(floor(seq / 4) AS BIGINT) % (SELECT n FROM docn) AS d1 FROM ev WHERE NOT err AND NOT old) e
CROSS JOIN LATERAL (SELECT 0 AS p, e.d1 AS doc, e.off1 AS off UNION ALL SELECT 1, (e.d1 + 1) % (SELECT n FROM docn), e.off2) x
JOIN flatdoc f ON f.doc_id = x.doc""")
def c3(spark, sf):
    return C.display_entries(A.events_with_text(spark, sf), "ingest_seq").select(
        "ingest_seq", "entry_pos", "display", "is_active_display", F.md5("ocr_text").alias("text_md5"))


PAGE_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query("c4_context_label", rf"""
WITH p AS (SELECT page_id, {PAGE_HOST} AS h, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS t FROM pages),
q AS (SELECT page_id, h, CASE WHEN length(t) > 80 THEN rtrim(left(t, 79)) || '…' ELSE t END AS t FROM p)
SELECT page_id, t AS title, 'Chrome' || CASE WHEN h <> '' THEN ' / ' || h ELSE '' END || CASE WHEN t <> '' THEN ' / ' || t ELSE '' END AS label FROM q""")
def c4(spark, sf):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    p = A.table(spark, sf, "pages").select("page_id", T.url_authority(F.col("url")).alias("h"), title.alias("t"))
    return p.select("page_id", T.shorten(F.col("t")).alias("title"), T.context_label(F.lit("Chrome"), F.col("h"), F.col("t")).alias("label"))


@query("c5_url_domain", f"SELECT page_id, {PAGE_HOST} AS domain FROM pages")
def c5(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", T.url_authority(F.col("url")).alias("domain"))


@query("c6_stub_and_error_rows", """
SELECT seq AS ingest_seq, CASE WHEN err THEN 'error' ELSE 'stub' END AS kind, NOT err AS excluded,
 CASE WHEN err THEN NULL ELSE 'app:' || app END AS excluded_reason, err AS has_error, CASE WHEN err THEN '' ELSE '[REDACTED]' END AS window_title,
 CASE WHEN dom = '' THEN NULL WHEN err THEN 'https://' || dom || '/p/' || k ELSE '' END AS url, 0 AS displays, '' AS ocr_text FROM ev""")
def c6(spark, sf):
    ev = A.events_with_text(spark, sf)
    stub = C.excluded_stub(ev.filter(~F.col("has_error")), F.concat(F.lit("app:"), "active_app")).withColumn("kind", F.lit("stub"))
    fail = C.error_row(ev.filter("has_error")).withColumn("kind", F.lit("error"))
    return stub.unionByName(fail).select(
        "ingest_seq", "kind", "excluded", "excluded_reason", "has_error", "window_title", F.col("browser.url").alias("url"),
        F.size("ocr_by_display").alias("displays"), "ocr_text")


# ---- redaction ---------------------------------------------------------------

@query("r1_redact_email", f"WITH {DOC} {OUT} (SELECT doc_id, regexp_replace(t, '{EMAIL}', '[REDACTED_EMAIL]', 'g') AS t FROM d0)")
def r1(spark, sf):
    return shown(docs(spark, sf), R.redact_email(F.col("text")))


@query("r2_redact_phone", f"WITH {DOC} {OUT} (SELECT doc_id, regexp_replace(t, '{PHONE}', '[REDACTED_PHONE]', 'g') AS t FROM d0)")
def r2(spark, sf):
    return shown(docs(spark, sf), R.redact_phone(F.col("text")))


@query("r3_redact_card", f"WITH {DOC}, d1 AS ({card_sql('d0')}) {OUT} d1")
def r3(spark, sf):
    return shown(docs(spark, sf), R.redact_card(F.col("text")))


@query("r4_redact_auth_nearby", f"WITH {DOC}, d1 AS ({auth_sql('d0')}) {OUT} d1")
def r4(spark, sf):
    return shown(docs(spark, sf), R.redact_auth_nearby(F.col("text"), HINTS))


SECRET_SQL = "regexp_replace(" + chain_sql("t", SECRETS) + f", '{PAIR}', '\\1=[REDACTED_SECRET]', 'g')"


@query("r5_redact_secrets", f"WITH {DOC} {OUT} (SELECT doc_id, {SECRET_SQL} AS t FROM d0)")
def r5(spark, sf):
    return shown(docs(spark, sf), R.redact_secrets(F.col("text"), HINTS))


@query("r6_redact_sensitive_terms", f"WITH {DOC} {OUT} (SELECT doc_id, {chain_sql('t', TERMS)} AS t FROM d0)")
def r6(spark, sf):
    return shown(docs(spark, sf), R.redact_sensitive(F.col("text")))


@query("r7_sanitize_for_sharing", f"""
WITH {DOC}, d1 AS (SELECT doc_id, regexp_replace(t, '{EMAIL}', '[REDACTED_EMAIL]', 'g') AS t FROM d0), d2 AS ({card_sql('d1')}),
d3 AS ({auth_sql('d2')}), d4 AS (SELECT doc_id, {SECRET_SQL} AS t FROM d3) {OUT} (SELECT doc_id, {chain_sql('t', TERMS)} AS t FROM d4)""")
def r7(spark, sf):
    return shown(docs(spark, sf), R.sanitize_for_sharing(F.col("text"), hints=HINTS, key_names=HINTS))


_COUNT = lambda p: f"len(regexp_extract_all(t, '{p}'))"


@query("r8_redaction_audit", f"""
WITH d0 AS (SELECT doc_id, lang, text AS t FROM documents), d1 AS ({card_sql('d0')}),
c AS (SELECT lang, {_COUNT(EMAIL)} AS email, {_COUNT(PHONE)} AS phone, cards AS card, {_COUNT(AUTH)} AS auth,
  {' + '.join(_COUNT(p) for p, _ in SECRETS)} + {_COUNT(PAIR)} AS secret, {' + '.join(_COUNT(p) for p, _ in TERMS)} AS term
  FROM d0 JOIN (SELECT doc_id AS id2, len(regexp_extract_all(t, '\\[REDACTED_CARD\\]')) AS cards FROM d1) x ON d0.doc_id = x.id2),
u AS (UNPIVOT (SELECT lang, CAST(email AS BIGINT) AS email, CAST(phone AS BIGINT) AS phone, CAST(card AS BIGINT) AS card,
   CAST(auth AS BIGINT) AS auth, CAST(secret AS BIGINT) AS secret, CAST(term AS BIGINT) AS term FROM c)
   ON email, phone, card, auth, secret, term INTO NAME rule VALUE v)
SELECT lang, rule, CAST(sum(v) AS BIGINT) AS hits, count(*) FILTER (WHERE v > 0) AS texts_hit FROM u GROUP BY lang, rule""")
def r8(spark, sf):
    return redaction_audit(docs(spark, sf), "text", ["lang"], HINTS, HINTS)
