"""Ledgers, queues, set operations and page matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions.text import strip_ws, text_of
from daymill.operators.enrich import upsert  # noqa: F401 - the keyed upsert is shared


def retry_ledger(attempts: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Open keys with the failures since their last success; a success clears a key.

    ``attempts``: keys, order columns, ``ok``, ``error_kind``.
    """
    at = F.struct(*order)
    last_ok = attempts.filter("ok").groupBy(*keys).agg(F.max(at).alias("_ok"))
    open_fails = attempts.filter(~F.col("ok")).join(last_ok, list(keys), "left").filter(
        F.col("_ok").isNull() | (at > F.col("_ok")))
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(K.RETRY_DELAY_MIN), F.lit(0))
    return open_fails.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("retry_count"), F.max(order[0]).alias("last_attempted_at"),
        (F.max(order[0]) + delay).alias("next_retry_after"), F.max_by("error_kind", at).alias("last_error_kind"))


def work_queue(pending: DataFrame, incomplete: DataFrame, today: DataFrame, key: str = "day") -> DataFrame:
    """Pending keys in order, then yesterday if incomplete, then today; each once, first place wins."""
    tag = lambda df, part: df.select(F.col(key), F.struct(F.lit(part).alias("part"), F.col(key).alias("k")).alias("_at"))
    rows = tag(pending, 0).unionByName(tag(incomplete, 1)).unionByName(tag(today, 2))
    return rows.groupBy(key).agg(F.min("_at.part").alias("part"))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` does not hold."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def distinct_sorted(values: Column, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))), sep)


def publish_state(reports: DataFrame, attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status per report: that of its newest attempt, ``pending`` before the first.

    ``resend`` marks reports whose stored output has to be sent again.
    """
    last = attempts.groupBy(*keys).agg(F.max_by(F.struct("status", "title"), "version").alias("_l"), F.count(F.lit(1)).alias("attempts"))
    out = reports.join(last, list(keys), "left")
    status = F.coalesce("_l.status", F.lit("pending"))
    return out.select(
        *reports.columns, status.alias("status"), F.coalesce("_l.title", F.lit("")).alias("title"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), (status == "pending").alias("resend"))


def match_pages(reports: DataFrame, pages: DataFrame, date: str, page_date: str, title: str, newest: Sequence[str], out: str) -> DataFrame:
    """The page of each report dated that day or the day after.

    A title naming the date wins, then the newest.  The choice depends on the date
    alone, so pages are reduced to one per date before reports join.
    """
    d = F.explode(F.array(F.col(page_date), F.date_sub(F.col(page_date), 1))).alias("_d")
    cand = pages.select(title, *newest, out, d)
    iso = F.col("_d").cast("string")
    named = text_of(F.col(title)).contains(iso) | text_of(F.col(title)).contains(F.substring(iso, 3, 8))
    best = cand.groupBy("_d").agg(F.max_by(F.struct(out, title), F.struct(named.alias("named"), *newest)).alias("_p"))
    return reports.join(best.select(F.col("_d").alias(date), "_p"), date, "left").select(
        *reports.columns, F.col(f"_p.{out}").alias(out), F.col(f"_p.{title}").alias(title))


def match_week_pages(weeks: DataFrame, pages: DataFrame, page_date: str, title: str, newest: Sequence[str], out: str) -> DataFrame:
    """The newest page of each week whose title has the week prefix and names the week."""
    d = F.explode(F.array(F.col(page_date), F.date_sub(F.col(page_date), 1))).alias("week_start")
    cand = pages.filter(strip_ws(F.col(title)).startswith(K.WEEK_PAGE_PREFIX.strip())).select(title, *newest, out, d)
    fit = cand.filter(F.col(title).startswith(K.WEEK_PAGE_PREFIX) & F.col(title).contains(F.col("week_start").cast("string")))
    best = fit.groupBy("week_start").agg(F.max_by(out, F.struct(*newest)).alias(out))
    return weeks.join(best, "week_start", "left")
