"""Logs, artifacts, stages, power logs, rule tables and report blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymill.operators.ordered import GROUP
from daymill.plans import report as R
from daymill.plans.catalog.base import TS, query
from daymill.plans.catalog.rules import DOC_RULES
from daymill.plans.catalog.segments import job
from daymill.session import work_folder
from daymill.sources import logs
from daymill.sources import samples as A

N = "row_number() OVER (PARTITION BY source_id, day ORDER BY seq) - 1"


def noisy_lines(spark, sf):
    """All events and their log lines; some carry a prefix, some are not JSON at all."""
    ev = A.events(spark, sf)
    n = F.col("ingest_seq")
    line = logs.event_json(ev)
    value = F.when(n % 40 == 7, F.concat(F.lit("14:33:0"), line)).when(n % 40 == 9, F.lit("noise [1]")).when(n % 40 == 11, F.lit("[1, 2]")).otherwise(line)
    return ev, value


@query("a1_read_events", f"""
WITH a AS (SELECT *, {N} AS p FROM ev) SELECT source_id, CAST(day AS VARCHAR) AS day, p AS ingest_seq, id, strftime(ts, {TS}) AS ts, ivl AS interval_sec, app AS active_app,
 NULLIF(dom, '') AS domain, excl AS excluded, err AS has_error FROM a WHERE seq % 40 NOT IN (9, 11)""")
def a1(spark, sf):
    path = work_folder(spark, "logs")
    lines, value = noisy_lines(spark, sf)
    logs.append_lines(lines, path, value)
    good, _ = logs.read_events(spark, path)
    return good.select(*GROUP, "ingest_seq", "id", "ts", "interval_sec", "active_app", F.col("browser.domain").alias("domain"), "excluded", "has_error")


@query("a1_bad_lines", f"""WITH a AS (SELECT *, {N} AS p FROM ev)
SELECT source_id, CAST(day AS VARCHAR) AS day, p AS ingest_seq, CASE seq % 40 WHEN 9 THEN 'noise [1]' ELSE '[1, 2]' END AS value FROM a WHERE seq % 40 IN (9, 11)""")
def a1_bad(spark, sf):
    path = work_folder(spark, "logs")
    lines, value = noisy_lines(spark, sf)
    logs.append_lines(lines, path, value)
    return logs.read_events(spark, path)[1]


@query("a2_append_events", """SELECT source_id, CAST(day AS VARCHAR) AS day, row_number() OVER (PARTITION BY source_id, day ORDER BY seq % 2, seq) - 1 AS ingest_seq,
 id, ivl AS interval_sec, err AS has_error FROM ev""")
def a2(spark, sf):
    path = work_folder(spark, "logs")
    ev = A.events(spark, sf)
    logs.append_events(ev.filter("ingest_seq % 2 = 0"), path)
    logs.append_events(ev.filter("ingest_seq % 2 = 1"), path)
    good, _ = logs.read_events(spark, path)
    return good.select(*GROUP, "ingest_seq", "id", "interval_sec", "has_error")


@query("a3_read_keyed_artifact", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '{"role":"' || role || '"}' ELSE '{}' END AS artifact FROM conversations""")
def a3(spark, sf):
    t = A.table(spark, sf, "conversations")
    body = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct("role"))).when(F.col("turn") % 3 == 1, F.lit("[1]")).otherwise(F.col("text"))
    return logs.read_keyed_artifact(t.withColumn("_a", body), "_a", "conv_id", "turn")


@query("a5_write_day_snapshot", """SELECT source_id, CAST(day AS VARCHAR) AS day, status, CASE WHEN status = 'complete' THEN total ELSE total + 1 END AS total_active_sec_est FROM snap""")
def a5(spark, sf):
    path = work_folder(spark, "snapshots")
    first = A.day_snapshots(spark, sf).select(*GROUP, "status", "total_active_sec_est")
    logs.write_day_snapshot(first, path)
    logs.write_day_snapshot(first.withColumn("total_active_sec_est", F.col("total_active_sec_est") + 1), path)
    return spark.read.schema(first.schema).parquet(path)


@query("a6_write_stage", "SELECT 2 AS stage, count(*) AS n FROM segt UNION ALL SELECT 0, count(*) FROM ev")
def a6(spark, sf):
    base = work_folder(spark, "stages")
    j = job(spark, sf)
    parts = [(0, "raw", j.events), (2, "segment", j.segments), (4, "hour-pack", j.hours)]
    made = [(n, logs.write_stage(df, base, n, name, max_stage=2)) for n, name, df in parts]
    out = None
    for n, path in made:
        if path is not None:
            one = spark.read.parquet(path).agg(F.lit(n).cast("long").alias("stage"), F.count(F.lit(1)).alias("n"))
            out = one if out is None else out.unionByName(one)
    return out


@query("a10_read_power_log", f"""SELECT source_id, strftime(date_trunc('second', ts), {TS}) AS ts, CASE app WHEN 'signup' THEN 'Sleep' WHEN 'view' THEN 'Wake' ELSE 'DarkWake' END AS power_state
FROM ev WHERE app IN ('signup', 'view', 'click')""")
def a10(spark, sf):
    path = work_folder(spark, "power")
    ev = A.events(spark, sf)
    name = F.when(F.col("active_app") == "signup", "Sleep").when(F.col("active_app") == "view", "Wake").when(
        F.col("active_app") == "click", "DarkWake").otherwise("Wake Requests")
    local = F.col("local_ts") + F.make_dt_interval(F.lit(0), F.lit(9))
    line = F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" +0900 "), name, F.lit("   \tby policy"))
    logs.append_lines(ev.select(*GROUP, "ingest_seq", line.alias("value")), path)
    return logs.read_power_log(spark, path).drop("ingest_seq")


@query("a10_assertion_lines", "SELECT event_id, event_type AS name, event_id % 3 AS n FROM events WHERE event_type <> 'error'")
def a10b(spark, sf):
    n = F.col("event_id")
    line = F.when(F.col("event_type") == "error", F.lit("Assertion status:")).otherwise(F.concat(F.lit("   "), "event_type", F.lit("    "), n % 3))
    return logs.parse_assertion_lines(A.table(spark, sf, "events").select("event_id", line.alias("value")), "event_id")


@query("a11_rule_tables", """
WITH r AS (SELECT * FROM (VALUES ('app', 'SRC3', 0), ('domain_kw', 'FR.', 2), ('domain_kw', 'zz', 3), ('text_kw', 'token', 4), ('text_kw', 'Licensed', 5), ('text_kw', 'the ', 6)) v(kind, pattern, rank))
SELECT kind, pattern, rank, count(*) AS texts FROM documents, r WHERE CASE kind WHEN 'app' THEN lower(source) = lower(pattern)
 WHEN 'domain_kw' THEN contains(lower(lang || '.site'), lower(pattern)) ELSE contains(text, pattern) END GROUP BY ALL""")
def a11(spark, sf):
    """Documents each rule of a rule table would match by itself."""
    rules = [F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["pattern"]).alias("pattern"), F.lit(r["rank"]).alias("rank"))
             for r in logs.rule_tables(spark, DOC_RULES).collect()]

    def match(r):
        low = F.lower(r["pattern"])
        return (F.when(r["kind"].isin("app", "locked"), F.lower("source") == low)
                .when(r["kind"] == "domain_kw", F.contains(F.lower(F.concat("lang", F.lit(".site"))), low))
                .otherwise(F.contains(F.col("text"), r["pattern"])))

    docs = A.table(spark, sf, "documents").select("source", "lang", "text")
    hits = docs.select(F.explode(F.filter(F.array(*rules), match)).alias("r"))
    return hits.groupBy("r.kind", "r.pattern", "r.rank").agg(F.count(F.lit(1)).alias("texts"))


@query("a12_report_blocks", r"""
WITH t AS (SELECT doc_id, '# Doc ' || doc_id || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) || '2. second' || chr(10) || text AS x FROM documents),
l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS ln, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM t),
m AS (SELECT *, starts_with(ln, '|') AS tb, CASE WHEN starts_with(ln, '|') AND COALESCE(lag(starts_with(ln, '|')) OVER (PARTITION BY doc_id ORDER BY i), false) THEN 0 ELSE 1 END AS st FROM l),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM m),
b AS (SELECT doc_id, min(i) AS i, string_agg(ln, chr(10) ORDER BY i) AS u FROM g GROUP BY doc_id, grp HAVING trim(string_agg(ln, chr(10) ORDER BY i), ' ' || chr(9) || chr(13)) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq, CASE WHEN starts_with(u, '### ') THEN 'heading_3' WHEN starts_with(u, '## ') THEN 'heading_2' WHEN starts_with(u, '# ') THEN 'heading_1'
  WHEN starts_with(u, '|') THEN 'code' WHEN starts_with(u, '- ') THEN 'bulleted_list_item' WHEN regexp_matches(u, '^\d+\.\s') THEN 'numbered_list_item' ELSE 'paragraph' END AS kind FROM b),
c AS (SELECT *, CASE WHEN kind = 'code' THEN u WHEN kind = 'numbered_list_item' THEN trim(regexp_replace(u, '^\d+\.\s', '')) WHEN kind = 'paragraph' THEN trim(u) ELSE trim(regexp_replace(u, '^(#{1,3}|-) ', '')) END AS t FROM k),
s AS (SELECT doc_id, seq AS unit, kind, t, unnest(range(CASE WHEN starts_with(kind, 'heading') THEN 1 ELSE greatest(1, (length(t) + 1999) // 2000) END)) AS part FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit, part) AS seq FROM s)
SELECT doc_id, seq, (seq - 1) // 100 AS block_batch, kind, md5(CASE WHEN starts_with(kind, 'heading') THEN t ELSE substring(t, part * 2000 + 1, 2000) END) AS content_md5 FROM r""")
def a12(spark, sf):
    text = F.concat(F.lit("# Doc "), "doc_id", F.lit("\n| a | b |\n| 1 | 2 |\n2. second\n"), "text")
    blocks = R.report_blocks(A.table(spark, sf, "documents").select("doc_id", text.alias("x")), ["doc_id"], "x")
    return blocks.select("doc_id", "seq", "block_batch", "kind", F.md5("content").alias("content_md5"))


