"""Token usage and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daymill.functions import fixed as K
from daymill.functions.timefmt import cost_text, int_text

COUNTERS = ["input_tokens", "output_tokens", "cached_tokens"]


def merge_usage(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """Token counters summed over calls."""
    return ledger.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(c).cast("long").alias(c) for c in COUNTERS])


def merge_usage_details(ledger: DataFrame, by: Sequence[str], details: str = "details") -> DataFrame:
    """A map of detail counters summed key by key; keys are counted before they meet again."""
    pairs = ledger.select(*by, F.explode(details).alias("detail", "_n"))
    sums = pairs.groupBy(*by, "detail").agg(F.sum("_n").cast("long").alias("tokens"))
    return sums.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("detail", "tokens")))).alias(details))


def price_table(spark: SparkSession) -> DataFrame:
    """USD per million tokens by tier and model; a short fixed table."""
    return spark.createDataFrame(
        K.TOKEN_PRICES, "tier string, model string, in_rate double, cached_rate double, out_rate double")


def cost(inp: Column, cached: Column, out: Column, in_rate: Column, cached_rate: Column, out_rate: Column) -> Column:
    """USD, null when the model has no price; cached tokens lie in [0, input]."""
    kept = F.greatest(F.lit(0), F.least(cached, inp))
    total = (inp - kept) * in_rate + kept * F.coalesce(cached_rate, in_rate) + out * out_rate
    return total / 1000000.0


def usage_cost(ledger: DataFrame, prices: DataFrame, tier: str = "standard") -> DataFrame:
    """Adds ``cost_usd``; prices of one tier are joined by model."""
    rates = prices.filter(F.col("tier") == tier).drop("tier")
    priced = ledger.join(rates, "model", "left")
    return priced.withColumn("cost_usd", cost(
        F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens"),
        F.col("in_rate"), F.col("cached_rate"), F.col("out_rate"))).drop("in_rate", "cached_rate", "out_rate")


def usage_report(costed: DataFrame, stage: str = "stage") -> DataFrame:
    """Tokens and cost per stage and in total, with the report texts."""
    out = costed.rollup(stage).agg(
        *[F.sum(c).cast("long").alias(c) for c in COUNTERS], F.sum("cost_usd").alias("cost_usd"),
        F.grouping(stage).alias("_all"))
    return (
        out.withColumn(stage, F.when(F.col("_all") == 1, K.TOTAL).otherwise(F.col(stage))).drop("_all")
        .withColumn("tokens_text", usage_text(F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens")))
        .withColumn("cost_text", cost_text(F.col("cost_usd")))
    )


def usage_text(inp: Column, cached: Column, out: Column) -> Column:
    note = F.when(cached > 0, F.concat(F.lit("（cached "), int_text(cached), F.lit("）"))).otherwise(F.lit(""))
    return F.concat(F.lit("input "), int_text(inp), note, F.lit(" / output "), int_text(out), F.lit(" tokens"))


def usage_map(calls: DataFrame, prices: DataFrame, by: Sequence[str], tier: str = "standard") -> DataFrame:
    """``by, usage``: a map from stage to its tokens, cost and model names, as report lines read it.

    Calls that failed or name no model tell nothing about usage; a stage with only such calls has no entry.
    """
    known = usage_cost(calls.filter(~F.col("failed") & F.col("model").isNotNull()), prices, tier)
    per = known.groupBy(*by, "stage").agg(
        *[F.sum(c).cast("long").alias(c) for c in COUNTERS], F.sum("cost_usd").alias("cost_usd"),
        F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("model"))
    entry = F.struct("stage", F.struct(*COUNTERS, "cost_usd", "model").alias("used"))
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("usage"))


def week_total(days: DataFrame, by: Sequence[str], seconds: str = "total_active_sec_est") -> DataFrame:
    return days.groupBy(*by).agg(F.sum(seconds).cast("long").alias("week_active_sec"))
