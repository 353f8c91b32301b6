"""Gaps before requests, idle gaps at providers, and what the cache still held after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens, turns

# fixed values
CAUSE_NAMES = {"tool": "Tool Gap", "ask_user_tool": "Ask-User Tool", "user": "User Idle", "subagent": "Subagent"}
GAP_BINS = (("<1m", 0, 60), ("1–5m", 60, 300), ("5–15m", 300, 900), ("15–30m", 900, 1800), ("30m–1h", 1800, 3600), (">1h", 3600, float("inf")))
IDLE_EDGES = 27
IDLE_RANGE_S = (10.0, 3600.0)
MIN_ROWS = 20


def gap_bin(gap: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, low, _ in GAP_BINS:
        out = F.when(gap >= low, label).otherwise(out)
    return out


def gap_rows(requests: DataFrame) -> DataFrame:
    """Requests with a gap of 0 s or more and a known cause."""
    cause = F.create_map(*(F.lit(x) for kv in CAUSE_NAMES.items() for x in kv))[F.col("waited_for")]
    r = requests.select("session_id", "step", turns.wait_s().alias("gap_s"), cause.alias("cause"), tokens.hit_ratio().alias("hit_ratio"))
    return r.filter((F.col("gap_s") >= 0) & F.col("cause").isNotNull()).withColumn("gap_bin", gap_bin(F.col("gap_s")))


def gaps_by_cause_and_bin(requests: DataFrame) -> DataFrame:
    half = F.lit(0.5)
    return gap_rows(requests).groupBy("cause", "gap_bin").agg(F.count("*").alias("rows"), F.percentile("hit_ratio", half).alias("median_hit_ratio"), F.percentile("gap_s", half).alias("median_gap_s"), F.avg("hit_ratio").alias("mean_hit_ratio"))


def idle_gap_rows(requests: DataFrame) -> DataFrame:
    """Arrival minus the latest completion of any earlier request of the user at the provider, if the request before it reported too."""
    w = Window.partitionBy("provider", "user_id").orderBy("start_ms", "session_id", "step")
    r = requests.filter(F.col("provider").isNotNull() & F.col("user_id").isNotNull())
    latest = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.select("session_id", "step", "provider", ((F.col("start_ms") - latest) / 1000).alias("idle_gap_s"), tokens.hit_ratio().alias("hit_ratio"), F.lag("cache_read_tokens").over(w).alias("__before"))
    return r.filter("idle_gap_s is not null and hit_ratio is not null and __before is not null").drop("__before")


def idle_bin(gap: Column) -> Column:
    """Bin 0 to 25: right-closed geometric edges, the lowest included."""
    low, high = IDLE_RANGE_S
    import numpy as np

    edges = [float(x) for x in np.geomspace(low, high, IDLE_EDGES)]
    return F.greatest(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < gap)) - 1, F.lit(0))


def retention_points(rows: DataFrame, per_provider: bool = False, least: int = MIN_ROWS) -> DataFrame:
    """Median gap, median hit ratio and rows per idle-gap group; a thin bin joins the next, a thin tail the last group."""
    keys = ["provider"] if per_provider else []
    low, high = IDLE_RANGE_S
    r = rows.filter(F.col("idle_gap_s") <= high).withColumn("idle_gap_s", F.greatest("idle_gap_s", F.lit(low))).withColumn("bin", idle_bin(F.col("idle_gap_s")))
    counts = r.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    # at most 26 bins a group: the merging is a fold over a small sorted array
    bins = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("b"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("group"), F.array().cast("array<struct<bin:int,group:int>>").alias("out"))
    def step(a, x):
        held = a["held"] + x["n"]
        full = held >= least
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(held).alias("held"), F.when(full, a["group"] + 1).otherwise(a["group"]).alias("group"), F.array_append(a["out"], F.struct(x["bin"].alias("bin"), a["group"].alias("group"))).alias("out"))
    folded = bins.select(*keys, F.aggregate("b", start, step).alias("f"))
    # groups 0 .. group-1 are full; the tail has number `group` and joins group-1; without a full group there is none
    at = folded.filter("f.group > 0").select(*keys, F.explode("f.out").alias("o"), F.col("f.group").alias("full")).select(*keys, "o.bin", F.least(F.col("o.group"), F.col("full") - 1).alias("group"))
    half = F.lit(0.5)
    return r.join(at, [*keys, "bin"]).groupBy(*keys, "group").agg(F.percentile("idle_gap_s", half).alias("gap_s"), F.percentile("hit_ratio", half).alias("hit_ratio"), F.count("*").alias("rows"))


def top_providers(rows: DataFrame, least: int, most: int = 4) -> DataFrame:
    return rows.groupBy("provider").agg(F.count("*").alias("gaps")).filter(F.col("gaps") >= least).orderBy(F.desc("gaps"), "provider").limit(most)
