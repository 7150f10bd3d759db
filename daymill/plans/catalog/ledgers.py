"""Ledgers, queues, set operations, page matching and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymill.operators import filters as B
from daymill.operators import ledger as L
from daymill.plans.catalog.base import TS, query
from daymill.session import work_folder
from daymill.sources import logs
from daymill.sources import samples as A

ATT = "att AS (SELECT user_id, ts, event_id AS seq, event_type <> 'error' AS ok, CASE WHEN value < 20 THEN 'network' ELSE 'other' END AS kind FROM events)"
LED = f"""{ATT}, lo AS (SELECT user_id, max((ts, seq)) AS ok FROM att WHERE ok GROUP BY user_id),
led AS (SELECT a.user_id, count(*) AS retry_count, max(a.ts) AS last, arg_max(a.kind, (a.ts, a.seq)) AS kind FROM att a LEFT JOIN lo ON a.user_id = lo.user_id
  WHERE NOT a.ok AND (lo.ok IS NULL OR (a.ts, a.seq) > lo.ok) GROUP BY a.user_id)"""


def ledger(spark, sf):
    att = A.table(spark, sf, "events").select(
        "user_id", "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("value") < 20, "network").otherwise("other").alias("error_kind"))
    return L.retry_ledger(att, ["user_id"])


@query("k8_retry_ledger", f"""WITH {LED} SELECT user_id, retry_count, strftime(last, {TS}) AS last_attempted_at,
 strftime(last + INTERVAL 10 MINUTE, {TS}) AS next_retry_after, kind AS last_error_kind FROM led""")
def k8(spark, sf):
    return ledger(spark, sf)


@query("b8_due_retries", f"WITH {LED} SELECT user_id FROM led WHERE user_id % 7 = 0 OR last + INTERVAL 10 MINUTE <= TIMESTAMP '2024-01-30 12:00:00'")
def b8(spark, sf):
    import datetime as dt

    led = ledger(spark, sf).withColumn("next_retry_after", F.when(
        F.col("user_id") % 7 == 0, F.when(F.col("user_id") % 2 == 0, "").otherwise("soon")).otherwise(
        F.date_format("next_retry_after", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return B.due_retries(led, F.lit(dt.datetime(2024, 1, 30, 12)).cast("timestamp_ntz").cast("timestamp")).select("user_id")


@query("g9_work_queue", """
WITH p AS (SELECT DISTINCT day FROM ev WHERE err AND k < 3), i AS (SELECT DISTINCT day FROM snap WHERE status <> 'complete'), t AS (SELECT max(day) AS day FROM ev)
SELECT CAST(day AS VARCHAR) AS day, min(part) AS part FROM (SELECT day, 0 AS part FROM p UNION ALL SELECT day, 1 FROM i UNION ALL SELECT day, 2 FROM t) GROUP BY day""")
def g9(spark, sf):
    ev = A.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    pending = ev.filter((F.col("event_type") == "error") & (k < 3)).select(F.to_date("ts").alias("day")).distinct()
    bad = A.day_snapshots(spark, sf).filter("status <> 'complete'").select("day").distinct()
    return L.work_queue(pending, bad, ev.agg(F.max(F.to_date("ts")).alias("day")))


@query("h1_difference", """SELECT DISTINCT user_id, CAST(day AS VARCHAR) AS day FROM ev a
 WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.day = a.day AND b.app = 'purchase')""")
def h1(spark, sf):
    ev = A.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return L.difference(ev, ev.filter("event_type = 'purchase'"), ["user_id", "day"])


@query("h2_ordered_union", """SELECT user_id, CAST(min(part) AS BIGINT) AS part FROM (SELECT user_id, 0 AS part FROM events WHERE event_type = 'error'
 UNION ALL SELECT user_id, 1 FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id, 2 FROM events WHERE event_type = 'view') GROUP BY user_id""")
def h2(spark, sf):
    ev = A.table(spark, sf, "events")
    pick = lambda t: ev.filter(F.col("event_type") == t).select("user_id").distinct()
    return L.work_queue(pick("error"), pick("signup"), pick("view"), "user_id")


@query("h3_keyed_upsert", """SELECT doc_id, CASE WHEN quality IS NULL OR doc_id % 3 = 0 THEN 'documents' ELSE 'labels' END AS origin, CASE WHEN quality IS NULL OR doc_id % 3 = 0 THEN n_chars ELSE quality END AS v
 FROM documents d LEFT JOIN (SELECT doc_id AS id2, quality FROM labels) l ON d.doc_id = l.id2""")
def h3(spark, sf):
    old = A.table(spark, sf, "documents").select("doc_id", F.lit("documents").alias("origin"), F.col("n_chars").alias("v"), F.lit(1).alias("version"))
    new = A.table(spark, sf, "labels").select("doc_id", F.lit("labels").alias("origin"), F.col("quality").cast("long").alias("v"),
                                              F.when(F.col("doc_id") % 3 == 0, 0).otherwise(2).alias("version"))
    return L.upsert(old, new, ["doc_id"]).drop("version")


@query("h4_distinct_sorted_reasons", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS reasons FROM events GROUP BY user_id")
def h4(spark, sf):
    kinds = A.table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", L.distinct_sorted(F.col("k")).alias("reasons"))


@query("a4_latest_artifact", "SELECT o_custkey, max((o_orderdate, o_orderkey))[2] AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def a4(spark, sf):
    runs = A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return logs.latest_artifact(runs, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("a14_publish_state", """
WITH a AS (SELECT o_custkey, count(*) AS n, arg_max(CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'skipped' END, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS t FROM orders GROUP BY ALL)
SELECT c_custkey AS o_custkey, COALESCE(s, 'pending') AS status, COALESCE(t, '') AS title, COALESCE(n, 0) AS attempts, COALESCE(s, 'pending') = 'pending' AS resend FROM customer LEFT JOIN a ON c_custkey = o_custkey""")
def a14(spark, sf):
    att = A.table(spark, sf, "orders").select(
        "o_custkey", F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "pending").otherwise("skipped").alias("status"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("version"))
    reports = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return L.publish_state(reports, att, ["o_custkey"])


@query("a9_apply_retention", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') < 400")
def a9(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return logs.apply_retention(o, F.lit("1998-08-02").cast("date"), 400)


@query("a9_drop_old_days", """SELECT source_id, CAST(day AS VARCHAR) AS day, count(*) AS events FROM ev
WHERE date_diff('day', day, (SELECT max(day) FROM ev)) < 10 GROUP BY source_id, day""")
def a9_drop(spark, sf):
    path = work_folder(spark, "retention")
    ev = A.events(spark, sf)
    logs.append_events(ev, path)
    logs.drop_old_days(spark, path, ev.agg(F.max("day")).first()[0], 10)
    return logs.read_events(spark, path)[0].groupBy("source_id", "day").agg(F.count(F.lit(1)).alias("events"))


LI = """li AS (SELECT CAST(l_shipdate AS DATE) AS d, l_orderkey * 10 + l_linenumber AS page_id,
 CASE WHEN l_linenumber = 1 THEN '週次レポート ' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || ' report' WHEN l_linenumber = 2 THEN 'log ' || strftime(l_shipdate, '%y-%m-%d') ELSE 'log' END AS title FROM lineitem)"""


def pages(spark, sf):
    d, n = F.to_date("l_shipdate"), F.col("l_linenumber")
    title = F.when(n == 1, F.concat(F.lit("週次レポート "), d.cast("string"), F.lit(" report"))).when(
        n == 2, F.concat(F.lit("log "), F.date_format(d, "yy-MM-dd"))).otherwise("log")
    return A.table(spark, sf, "lineitem").select(d.alias("page_day"), (F.col("l_orderkey") * 10 + n).alias("page_id"), title.alias("title"))


@query("f9_match_pages", f"""
WITH {LI}, od AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), c AS (SELECT od.d, li.page_id, li.title,
 row_number() OVER (PARTITION BY od.d ORDER BY CASE WHEN contains(title, strftime(od.d, '%y-%m-%d')) THEN 0 ELSE 1 END, page_id DESC) AS r
 FROM od JOIN li ON li.d = od.d OR li.d = od.d + 1)
SELECT o_orderkey, c.page_id, c.title FROM orders o LEFT JOIN (SELECT * FROM c WHERE r = 1) c ON CAST(o.o_orderdate AS DATE) = c.d""")
def f9(spark, sf):
    reports = A.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return L.match_pages(reports, pages(spark, sf), "day", "page_day", "title", ["page_id"], "page_id").drop("day")


@query("g8_pick_page", f"""
WITH {LI}, wk AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders)
SELECT CAST(w AS VARCHAR) AS week_start, max(page_id) AS page_id FROM wk LEFT JOIN li ON (li.d = w OR li.d = w + 1) AND starts_with(title, '週次レポート ') AND contains(title, CAST(w AS VARCHAR)) GROUP BY w""")
def g8(spark, sf):
    from daymill.functions.timefmt import week_start

    weeks = A.table(spark, sf, "orders").select(week_start(F.to_date("o_orderdate")).alias("week_start")).distinct()
    return L.match_week_pages(weeks, pages(spark, sf), "page_day", "title", ["page_id"], "page_id")
