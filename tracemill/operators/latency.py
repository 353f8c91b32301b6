"""Where a session's time goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens, turns

# fixed values
TRUSTED_SHARE, TOOL_CAP_S = 0.95, 900.0
LONG_MISS_RATIO, LONG_MISS_TOKENS, MIN_LONG_MISSES = 0.25, 10_000, 200


def trusted_ttft() -> Column:
    return F.coalesce((F.col("ttft_ms") > 0) & (F.col("ttft_ms") < TRUSTED_SHARE * (F.col("end_ms") - F.col("start_ms"))), F.lit(False))


def effective_llm_time(requests: DataFrame) -> DataFrame:
    """Per session: prefill and decode seconds; unsplit time is shared by the session's own ratio, else its harness's, else that of all."""
    ok, latency, ttft = trusted_ttft(), (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("ttft_ms") / 1000
    s = requests.groupBy("session_id").agg(
        F.min("harness").alias("harness"), F.sum(F.when(ok, ttft).otherwise(0.0)).alias("p"), F.sum(F.when(ok, latency - ttft).otherwise(0.0)).alias("d"), F.sum(F.when(~ok, latency).otherwise(0.0)).alias("u")
    )
    # ratios of a harness and of all are a few rows, joined back rather than windowed over
    h = s.groupBy("harness").agg(F.sum("p").alias("hp"), F.sum("d").alias("hd"))
    a = h.agg(F.sum("hp").alias("ap"), F.sum("hd").alias("ad"))
    s = s.join(h, "harness", "left").join(F.broadcast(a), F.lit(True))
    ratio = F.coalesce(F.try_divide("p", F.col("p") + F.col("d")), F.try_divide("hp", F.col("hp") + F.col("hd")), F.try_divide("ap", F.col("ap") + F.col("ad")), F.lit(0.0))
    return s.withColumn("r", ratio).select("session_id", (F.col("p") + F.col("u") * F.col("r")).alias("prefill"), (F.col("d") + F.col("u") * (1 - F.col("r"))).alias("decode"))


def time_breakdown(requests: DataFrame, cap_tool_waits: bool = False) -> DataFrame:
    wait = F.greatest(F.col("wait_s"), F.lit(0.0))
    tool = F.when(F.col("waited_for").isin("tool", "subagent"), F.least(wait, F.lit(TOOL_CAP_S)) if cap_tool_waits else wait)
    human = F.when(F.col("waited_for").isin("user", "ask_user_tool"), wait)
    w = requests.withColumn("wait_s", turns.wait_s()).groupBy("session_id").agg(F.coalesce(F.sum(tool), F.lit(0.0)).alias("tool"), F.coalesce(F.sum(human), F.lit(0.0)).alias("human"))
    return effective_llm_time(requests).join(w, "session_id")


PARTS = ["prefill", "decode", "tool", "human"]


def time_shares(requests: DataFrame) -> DataFrame:
    return tokens._shares(time_breakdown(requests), ["session_id"], PARTS)


def speedups(breakdown: DataFrame) -> DataFrame:
    """Session-time speed-up if one part of machine time ran twice as fast."""
    total = F.sum("prefill") + F.sum("decode") + F.sum("tool")
    return breakdown.agg(*((total / (total - 0.5 * F.sum(p))).alias(p) for p in PARTS[:3]))


def ttft_decomposition(requests: DataFrame, min_long_misses: int = MIN_LONG_MISSES, long_miss_tokens: int = LONG_MISS_TOKENS) -> DataFrame:
    """Per model with enough long misses: their number, the median prefill rate, and median TTFT, decode and queueing seconds."""
    r = requests.filter(trusted_ttft()).withColumn("unc", tokens.uncached()).withColumn("ttft_s", F.col("ttft_ms") / 1000)
    long_miss = (F.try_divide("cache_read_tokens", "prompt_tokens") < LONG_MISS_RATIO) & (F.col("unc") > long_miss_tokens)
    rates = r.groupBy("model").agg(F.count_if(long_miss).alias("long_misses"), F.percentile(F.when(long_miss, F.col("unc") / F.col("ttft_s")), F.lit(0.5)).alias("rate")).filter(F.col("long_misses") >= min_long_misses)
    q = F.greatest(F.col("ttft_s") - F.col("unc") / F.col("rate"), F.lit(0.0))
    q = F.when(F.col("unc").isNotNull(), q)
    decode = (F.col("end_ms") - F.col("start_ms") - F.col("ttft_ms")) / 1000
    return r.join(rates, "model").groupBy("model").agg(F.first("long_misses").alias("long_misses"), F.first("rate").alias("rate"), *(F.percentile(c, F.lit(0.5)).alias(n) for c, n in ((F.col("ttft_s"), "ttft"), (decode, "decode"), (q, "queueing"))))
