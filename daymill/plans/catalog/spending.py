"""Token usage, cost and number formats over the conversation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymill.functions import timefmt as TF
from daymill.operators import usage as U
from daymill.plans.catalog.base import query
from daymill.sources import samples as A

LEDGER = """us AS (SELECT conv_id, turn, role AS stage, CASE WHEN turn % 5 = 4 THEN 'other-model' ELSE 'gpt-5-nano' END AS model,
  CAST(length(text) AS BIGINT) AS i, CAST(floor(length(text) / 4) AS BIGINT) AS c, turn * 10 AS o FROM conversations),
uc AS (SELECT *, CASE WHEN model = 'gpt-5-nano' THEN ((i - c) * CAST(0.05 AS DOUBLE) + c * CAST(0.005 AS DOUBLE) + o * CAST(0.40 AS DOUBLE)) / CAST(1000000.0 AS DOUBLE) END AS usd FROM us)"""


def ledger(spark, sf):
    t = A.table(spark, sf, "conversations")
    n = F.length("text").cast("long")
    return t.select(
        "conv_id", "turn", F.col("role").alias("stage"),
        F.when(F.col("turn") % 5 == 4, "other-model").otherwise("gpt-5-nano").alias("model"),
        n.alias("input_tokens"), F.floor(n / 4).alias("cached_tokens"), (F.col("turn") * 10).alias("output_tokens"))


@query("e16_merge_usage", f"""
WITH {LEDGER} SELECT stage, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
 CAST(sum(c) AS BIGINT) AS cached_tokens FROM us GROUP BY stage""")
def e16(spark, sf):
    return U.merge_usage(ledger(spark, sf), ["stage"])


@query("e16_merge_usage_details", f"""
WITH {LEDGER} SELECT stage, 'audio=' || CAST(sum(turn) AS BIGINT) || ',cached=' || CAST(sum(c) AS BIGINT) AS details FROM us GROUP BY stage""")
def e16d(spark, sf):
    led = ledger(spark, sf).withColumn("details", F.create_map(
        F.lit("cached"), F.col("cached_tokens"), F.lit("audio"), F.col("turn")))
    merged = U.merge_usage_details(led, ["stage"])
    pairs = F.transform(F.map_entries("details"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.select("stage", F.array_join(F.array_sort(pairs), ",").alias("details"))


@query("e17_usage_cost", f"""WITH {LEDGER} SELECT conv_id, turn, model, CASE WHEN usd IS NULL THEN 'n/a' ELSE printf('$%.6f', usd) END AS cost_usd FROM uc""")
def e17(spark, sf):
    out = U.usage_cost(ledger(spark, sf), U.price_table(spark))
    return out.select("conv_id", "turn", "model", TF.usd_text(F.col("cost_usd")).alias("cost_usd"))


@query("e18_usage_report", f"""
WITH {LEDGER} SELECT CASE WHEN grouping(stage) = 1 THEN '合計' ELSE stage END AS stage, CAST(sum(i) AS BIGINT) AS input_tokens,
 CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(c) AS BIGINT) AS cached_tokens, printf('%.9f', sum(usd)) AS cost_usd,
 'input ' || format('{{:,}}', CAST(sum(i) AS BIGINT)) || CASE WHEN sum(c) > 0 THEN '（cached ' || format('{{:,}}', CAST(sum(c) AS BIGINT)) || '）' ELSE '' END
   || ' / output ' || format('{{:,}}', CAST(sum(o) AS BIGINT)) || ' tokens' AS tokens_text,
 printf('$%.6f', sum(usd)) || ' / ¥' || format('{{:,}}', CAST(round_even(sum(usd) * 150, 0) AS BIGINT)) AS cost_text
FROM uc GROUP BY ROLLUP (stage)""")
def e18(spark, sf):
    rep = U.usage_report(U.usage_cost(ledger(spark, sf), U.price_table(spark)))
    return rep.withColumn("cost_usd", F.format_string("%.9f", "cost_usd"))


@query("m8_usage_ledger", f"""
WITH {LEDGER} SELECT stage, model, count(*) AS batches, CAST(sum(i) AS BIGINT) AS input_tokens,
 count(*) FILTER (WHERE usd IS NULL) AS unpriced, printf('%.9f', COALESCE(sum(usd), 0)) AS cost_usd FROM uc GROUP BY stage, model""")
def m8(spark, sf):
    from daymill.operators.enrich import usage_ledger

    led = usage_ledger(ledger(spark, sf), U.price_table(spark))
    return led.withColumn("cost_usd", F.format_string("%.9f", F.coalesce("cost_usd", F.lit(0.0)))).select(
        "stage", "model", "batches", "input_tokens", "unpriced", "cost_usd")


@query("i15_number_texts", f"""
WITH {LEDGER} SELECT conv_id, turn, format('{{:,}}', i * 1000) AS int_text, CASE WHEN usd IS NULL THEN 'n/a' ELSE printf('$%.6f', usd * 1000) END AS usd_text,
 CASE WHEN usd IS NULL THEN 'n/a' ELSE '¥' || format('{{:,}}', CAST(round_even(usd * 1000 * 150, 0) AS BIGINT)) END AS jpy_text FROM uc""")
def i15(spark, sf):
    out = U.usage_cost(ledger(spark, sf), U.price_table(spark))
    usd = F.col("cost_usd") * 1000
    return out.select("conv_id", "turn", TF.int_text(F.col("input_tokens") * 1000).alias("int_text"),
                      TF.usd_text(usd).alias("usd_text"), TF.jpy_text(usd).alias("jpy_text"))


@query("i17_usage_tokens", f"""
WITH {LEDGER} SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE i END AS input_tokens, CASE WHEN turn % 3 = 2 THEN NULL ELSE o END AS output_tokens,
 CASE WHEN turn % 3 = 2 THEN NULL WHEN turn % 3 = 0 THEN least(2 * c + turn * 1000, i) ELSE 0 END AS cached_tokens FROM us""")
def i17(spark, sf):
    led = ledger(spark, sf)
    new = F.to_json(F.struct("input_tokens", "output_tokens", F.struct(
        (F.col("cached_tokens") * 2 + F.col("turn") * 1000).alias("cached_tokens")).alias("input_tokens_details")))
    old = F.to_json(F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens")))
    doc = F.when(F.col("turn") % 3 == 0, new).when(F.col("turn") % 3 == 1, old).otherwise(F.lit("no usage"))
    out = led.select("conv_id", "turn", TF.usage_tokens(doc).alias("u"))
    return out.select("conv_id", "turn", "u.input_tokens", "u.output_tokens", "u.cached_tokens")
