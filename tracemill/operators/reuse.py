"""Replay of block reads: every read is judged against the block's next read, for all TTLs and policies at once.

Reads are ordered by (scope, week, block, arrival) in range partitions, so a block that nearly every request reads is spread
over many; the last read of a partition gets the first of the next. A hit and the time a block stays are step functions
of the TTL: each read and policy counts under the indices where they change, and the 13 TTLs are filled in
on those few sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import BLOCK_TOKENS
from . import turns
from .lineage import settled

# fixed values
TTLS = (("1s", 1.0), ("10s", 10.0), ("30s", 30.0), ("1m", 60.0), ("5m", 300.0), ("10m", 600.0), ("15m", 900.0), ("30m", 1800.0), ("1h", 3600.0), ("3h", 10800.0), ("6h", 21600.0), ("1d", 86400.0), ("none", float("inf")))
POLICIES = ("ttl_only", "reclaim_mutate", "reclaim_dead", "reclaim_both")
RECOMPUTE_PRICE, STORAGE_PRICE_PER_DAY, MILLION, DAY_S = 1.0, 30.0, 1e6, 86_400


def judged_reads(reads: DataFrame) -> DataFrame:
    """reads: session_id, week, harness, step, start_ms, end_ms, pos, block_id. Adds scope, first, next read and signals (seconds)."""
    inf = F.lit(float("inf"))
    spark = reads.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = reads.select("week", "session_id", "step", "pos", "block_id", turns.scope_of(F.col("harness")).alias("scope"), (F.col("start_ms") / 1000).alias("arrival"), (F.col("end_ms") / 1000).alias("completion"))
    # one shuffle by session serves all that asks for the session: when it ends, when its next step comes, and whether that
    # reads the block, however often this one does
    of_session = Window.partitionBy("week", "session_id")
    back = of_session.orderBy(F.desc("step"))
    later, whole = back.rangeBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = F.count("*").over(Window.partitionBy("week", "session_id", "scope", "block_id").orderBy("step").rangeBetween(1, 1))
    r = r.repartition(parts, "week", "session_id").withColumn("session_end", F.max("completion").over(whole)).withColumn("next_arrival", F.coalesce(F.last("arrival").over(later), inf))
    r = r.withColumn("mutate_signal", F.when(again > 0, inf).otherwise(F.col("next_arrival"))).select("scope", "week", "session_id", "step", "pos", "block_id", "arrival", "completion", "mutate_signal", "session_end")
    # written once, so that the sampling of ranges reads a table
    r = settled(r, "session-reads")
    ends = r.groupBy("scope", "week").agg(F.max("completion").alias("week_end"))

    block, order = ["scope", "week", "block_id"], ["arrival", "session_id", "step", "pos"]
    r = settled(r.repartitionByRange(parts, *block, *order).withColumn("__p", F.spark_partition_id()), "ordered-reads")
    at = F.struct(*block, *order, "completion")
    ends_of = r.groupBy("__p").agg(F.min(at).alias("head"), F.max(at).alias("tail"))
    by = Window.orderBy("__p")
    # one row a partition
    ends_of = ends_of.select("__p", F.lead("head").over(by).alias("__after"), F.lag("tail").over(by).alias("__before"))
    same = lambda end: (F.col(f"{end}.scope") == F.col("scope")) & (F.col(f"{end}.week") == F.col("week")) & (F.col(f"{end}.block_id") == F.col("block_id"))
    w = Window.partitionBy("__p", *block).orderBy(*order)
    r = r.join(F.broadcast(ends_of), "__p").join(F.broadcast(ends), ["scope", "week"])  # a row a partition; a row a week and scope
    following = lambda c: F.coalesce(F.lead(c).over(w), F.when(same("__after"), F.col(f"__after.{c}")))
    r = r.withColumn("__arrival", following("arrival")).withColumn("__completion", following("completion")).withColumn("first", (F.row_number().over(w) == 1) & ~F.coalesce(same("__before"), F.lit(False)))
    return r.select(
        "scope", "week", "session_id", "step", "block_id", "arrival", "completion", "week_end", "mutate_signal", "session_end",
        "first", (F.col("__arrival") - F.col("completion")).alias("gap"), (F.col("__completion") - F.col("completion")).alias("until_next"),
    )


def _first_at_least(value: Column) -> Column:
    """Index of the first TTL that is no less than the value."""
    out = F.lit(len(TTLS))
    for k in reversed(range(len(TTLS))):
        out = F.when(value <= TTLS[k][1], k).otherwise(out)
    return out


def tallies(judged: DataFrame) -> DataFrame:
    """Hit and missed tokens, reusable and dead token-seconds per scope, week, policy and TTL."""
    inf = F.lit(float("inf"))
    signals = {"ttl_only": inf, "reclaim_mutate": F.col("mutate_signal"), "reclaim_dead": F.col("session_end"), "reclaim_both": F.least("mutate_signal", "session_end")}
    policies = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), (signals[p] - F.col("completion")).alias("after")) for p in POLICIES)))
    g = judged.select("scope", "week", "gap", "until_next", (F.col("week_end") - F.col("completion")).alias("rest"), policies.alias("p")).select("*", "p.*")
    # from this TTL on it hits, and from that one on an end other than the TTL's comes first
    hits = F.when(F.col("gap") < 0, 0).when(F.col("gap") <= F.col("after"), _first_at_least(F.col("gap"))).otherwise(len(TTLS))
    g = g.withColumn("hits", hits).withColumn("cap", F.greatest(F.least("after", "rest"), F.lit(0.0))).withColumn("capped", _first_at_least(F.col("cap")))
    keys = ["scope", "week", "policy"]
    g = g.groupBy(*keys, F.col("gap").isNotNull().alias("has_next"), "hits", F.least("capped", "hits").alias("capped")).agg(F.count("*").alias("n"), F.sum(F.greatest("until_next", F.lit(0.0))).alias("until"), F.sum("cap").alias("cap"))
    # at most 2 x 14 x 14 rows of each scope, week and policy
    ttl = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("ttl"), F.lit(s).alias("ttl_s")) for k, (t, s) in enumerate(TTLS))))
    g = g.select("*", ttl.alias("t")).select("*", "t.*")
    hit = F.col("k") >= F.col("hits")
    stays = F.when(hit, F.col("until")).when(F.col("k") >= F.col("capped"), F.col("cap")).otherwise(F.col("ttl_s") * F.col("n"))
    total = lambda rows, value: F.coalesce(F.sum(F.when(rows, value)), F.lit(0) if value is n else F.lit(0.0))
    n = F.col("n")
    return g.groupBy(*keys, "ttl").agg(
        (BLOCK_TOKENS * total(hit, n)).alias("hit_tokens"), (BLOCK_TOKENS * total(~hit, n)).alias("miss_tokens"),
        (BLOCK_TOKENS * total(F.col("has_next"), stays)).alias("reusable_token_seconds"), (BLOCK_TOKENS * total(~F.col("has_next"), stays)).alias("dead_token_seconds"),
    )


def over_weeks(t: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over weeks; ratios only after that."""
    return t.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in t.columns if c not in (*keys, "week")))


def scope_totals(reads: DataFrame, requests: DataFrame) -> DataFrame:
    n = reads.groupBy("session_id", "step").agg(F.count("*").alias("reads"))
    r = requests.withColumn("scope", turns.scope_of(F.col("harness"))).join(n, ["session_id", "step"], "left")
    return r.groupBy("scope", "week").agg(
        F.sum(BLOCK_TOKENS * F.coalesce("reads", F.lit(0)) * (F.col("end_ms") - F.col("start_ms")) / 1000).alias("active_token_seconds"), ((F.max("end_ms") - F.min("start_ms")) / 1000).alias("span_seconds"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).cast("double").alias("output_tokens"), F.count("*").alias("requests"),
    )


def request_misses(judged: DataFrame) -> DataFrame:
    return judged.groupBy("scope", "week", "session_id", "step").agg((BLOCK_TOKENS * F.count_if("first")).alias("missed_tokens"), F.count("*").alias("reads"))


def cost_curves(tally: DataFrame, totals: DataFrame) -> DataFrame:
    """Per scope, policy and TTL (weeks summed): retained tokens, prefill over its floor, API and infrastructure cost over the one-minute total."""
    floor = tally.filter("policy = 'ttl_only' and ttl = 'none'").select("scope", F.col("miss_tokens").alias("floor"))
    c = tally.join(F.broadcast(floor), "scope").join(F.broadcast(totals), "scope")  # 2 scopes, 104 rows
    kept = F.col("reusable_token_seconds") + F.col("dead_token_seconds")
    c = c.select(
        "scope", "policy", "ttl", (kept / F.col("span_seconds")).alias("mean_retained_tokens"), (F.col("miss_tokens") / F.col("floor")).alias("normalised_prefill"),
        (F.col("reusable_token_seconds") / F.col("active_token_seconds")).alias("reusable_over_active"), (F.col("dead_token_seconds") / F.col("active_token_seconds")).alias("dead_over_active"),
        (F.col("miss_tokens") * 10.0 / MILLION).alias("api_input"), (F.col("hit_tokens") * 1.0 / MILLION).alias("api_cache_read"), (F.col("output_tokens") * 50.0 / MILLION).alias("api_output"),
        (F.col("miss_tokens") * RECOMPUTE_PRICE / MILLION).alias("recompute"), (kept / DAY_S * STORAGE_PRICE_PER_DAY / MILLION).alias("storage"),
    )
    api, infra = ("api_input", "api_cache_read", "api_output"), ("recompute", "storage")
    w = Window.partitionBy("scope", "policy")
    at_minute = lambda parts: F.max(F.when(F.col("ttl") == "1m", sum((F.col(p) for p in parts), F.lit(0.0)))).over(w)
    c = c.withColumn("__a", at_minute(api)).withColumn("__i", at_minute(infra))
    for p in api:
        c = c.withColumn(p, F.col(p) / F.col("__a"))
    for p in infra:
        c = c.withColumn(p, F.col(p) / F.col("__i"))
    return c.withColumn("api_total", F.expr("api_input + api_cache_read + api_output")).withColumn("infrastructure_total", F.expr("recompute + storage")).drop("__a", "__i")


def with_ttl_order(df: DataFrame) -> DataFrame:
    order = F.create_map(*(F.lit(x) for i, (t, _) in enumerate(TTLS) for x in (t, i)))
    return df.withColumn("ttl_order", order[F.col("ttl")])


def api_cost_knee(curves: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per scope and policy: the shortest TTL within 5 % of the lowest API cost, and the TTL of the lowest infrastructure cost."""
    w = Window.partitionBy("scope", "policy")
    c = with_ttl_order(curves).withColumn("least", F.min("api_total").over(w))
    return c.groupBy("scope", "policy").agg(F.min_by("ttl", F.when(F.col("api_total") <= F.col("least") * (1 + tolerance), F.col("ttl_order"))).alias("knee"), F.min_by("ttl", F.struct("infrastructure_total", "ttl_order")).alias("lowest_infrastructure"))


def retention_summary(curves: DataFrame) -> DataFrame:
    """Per scope, under ttl_only: prefill above the floor, retained tokens over those at 15 minutes, and dead over active at a day, with its fall under reclaim_both."""
    at = lambda c, ttl, policy="ttl_only": F.max(F.when((F.col("ttl") == ttl) & (F.col("policy") == policy), F.col(c)))
    return curves.groupBy("scope").agg(
        *((at("normalised_prefill", t) - 1).alias(f"prefill_above_floor_{t}") for t in ("5m", "15m", "1h")), *((at("mean_retained_tokens", t) / at("mean_retained_tokens", "15m")).alias(f"retained_{t}_over_15m") for t in ("1h", "1d")),
        at("dead_over_active", "1d").alias("dead_over_active_1d"), (at("dead_over_active", "1d") / at("dead_over_active", "1d", "reclaim_both")).alias("reclaim_both_dead_fall_1d"),
    )


def prefill_against_storage(curves: DataFrame, ttls: list[str]) -> DataFrame:
    """Per scope, policy and chosen TTL: prefill above the floor, and what it keeps over what the shortest of them keeps."""
    c = curves.filter(F.col("ttl").isin(*ttls))
    first = F.max(F.when(F.col("ttl") == ttls[0], F.col("mean_retained_tokens"))).over(Window.partitionBy("scope", "policy"))
    return c.select("scope", "policy", "ttl", (F.col("normalised_prefill") - 1).alias("prefill_above_floor"), (F.col("mean_retained_tokens") / first).alias("retained_over_first"))
