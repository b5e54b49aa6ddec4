"""Cost, time and throughput estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialoom.functions.dims import ratio

# Token and price assumptions.
CHARS_PER_TOKEN = 4
PROMPT_TOKENS = 500
INPUT_USD_PER_1K = 0.003
OUTPUT_USD_PER_1K = 0.015
USD_PER_ITEM = 0.003
VIABLE_SUCCESS = 0.8


def generation_cost(df: DataFrame) -> DataFrame:
    """One row of token and cost estimates for nested conversations.

    The output counts the turn texts and the whole serialised record.
    """
    spoken = F.coalesce(F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(F.length(t["text"]), F.lit(0))),
                        F.lit(0))
    turns = F.coalesce(F.when(F.col("turns").isNotNull(), F.size("turns")), F.lit(0))
    rows = df.select(spoken.cast("bigint").alias("spoken"), turns.cast("bigint").alias("turns"),
                     F.length(F.to_json(F.struct("*"))).cast("bigint").alias("record"))
    sums = rows.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("turns"), F.lit(0)).alias("total_turns"),
                    F.coalesce(F.sum(F.col("spoken") + F.col("record")), F.lit(0)).alias("chars"))
    tokens = sums.select("conversations", "total_turns", (F.col("conversations") * PROMPT_TOKENS).alias("input_tokens"),
                         F.floor(F.col("chars") / CHARS_PER_TOKEN).alias("output_tokens"))
    usd_in = F.col("input_tokens") / 1000 * INPUT_USD_PER_1K
    usd_out = F.col("output_tokens") / 1000 * OUTPUT_USD_PER_1K
    return tokens.select(
        "*", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), usd_in.alias("input_cost_usd"),
        usd_out.alias("output_cost_usd"), (usd_in + usd_out).alias("total_cost_usd"),
        ratio(usd_in + usd_out, F.col("conversations")).alias("cost_per_item_usd"))


def plan_estimate(plans: DataFrame) -> DataFrame:
    """Adds cost_usd, seconds (sequential) and batch_minutes to rows with ``items`` and ``delay``."""
    n = F.col("items")
    minutes = F.when(n <= 100, 5).when(n <= 500, 15).when(n <= 1000, 25).when(n <= 2000, 45)\
        .otherwise(F.floor(n / 1000 * 25)).cast("bigint")
    return plans.withColumns({"cost_usd": n * USD_PER_ITEM, "seconds": n * (F.col("delay") + 1.0), "batch_minutes": minutes})


def throughput(calls: DataFrame) -> DataFrame:
    """Per delay of a call log (delay, ok, seconds): success rate, latency and effective calls per minute."""
    ok = F.sum(F.col("ok").cast("bigint"))
    latency = F.avg(F.when(F.col("ok"), F.col("seconds")))
    rows = calls.groupBy("delay").agg(ok.alias("successes"), (F.count("*") - ok).alias("failures"),
                                      F.coalesce(latency, F.lit(0.0)).alias("avg_response_time"))
    rate = ratio(F.col("successes"), F.col("successes") + F.col("failures"))
    each = F.col("avg_response_time") + F.col("delay")
    rpm = F.when(each > 0, 60 / each).otherwise(F.lit(0.0))
    return rows.withColumns({"success_rate": rate, "effective_rpm": rpm, "effective_rpm_adjusted": rpm * rate})


def best_delay(rates: DataFrame) -> DataFrame:
    """The delay with most successful calls per minute among those with 80 % success; if there is none,
    the one with the highest success rate. The smaller delay wins a tie."""
    viable = F.col("success_rate") >= VIABLE_SUCCESS
    order = F.struct(viable.cast("int").alias("v"),
                     F.when(viable, F.col("effective_rpm_adjusted")).otherwise(F.col("success_rate")).alias("s"),
                     (-F.col("delay")).alias("d"))
    picked = F.max_by(F.struct("delay", "success_rate", "effective_rpm", "effective_rpm_adjusted"), order)
    return rates.agg(picked.alias("p")).select("p.*")


