"""Token series, hit ratios and cost shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import settled
from .turns import in_session

# fixed values
CACHED_PRICE, UNCACHED_PRICE, OUTPUT_PRICE = 1.0, 10.0, 50.0
ROLES = ("system", "user", "assistant", "tool", "tool_definitions")
DEFINITIONS_AS_SYSTEM = {"system_and_tools": ("system", "tool_definitions"), "user": ("user",), "assistant": ("assistant",), "tool": ("tool",)}
MESSAGE_ROLES = {r: (r,) for r in ROLES[:4]}


def reports_cache() -> Column:
    return F.col("cache_read_tokens").isNotNull()


def hit_ratio() -> Column:
    return F.when(reports_cache() & (F.col("prompt_tokens") > 0), F.least(F.col("cache_read_tokens") / F.col("prompt_tokens"), F.lit(1.0)))


def uncached() -> Column:
    return F.when(reports_cache(), F.greatest(F.col("prompt_tokens") - F.col("cache_read_tokens"), F.lit(0)))


def cost_components(requests: DataFrame) -> DataFrame:
    rows = requests.filter(reports_cache() & (F.col("prompt_tokens") > 0))
    return rows.select("session_id", (F.col("cache_read_tokens") * CACHED_PRICE).alias("cached"), (uncached() * UNCACHED_PRICE).alias("uncached"), (F.coalesce("completion_tokens", F.lit(0)) * OUTPUT_PRICE).alias("output"))


def _shares(sums: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    return sums.withColumn("__t", total).filter("__t > 0").select(*keys, *((F.col(p) / F.col("__t")).alias(p) for p in parts))


COSTS = ["cached", "uncached", "output"]


def cost_shares_per_session(requests: DataFrame) -> DataFrame:
    return _shares(cost_components(requests).groupBy("session_id").agg(*(F.sum(c).alias(c) for c in COSTS)), ["session_id"], COSTS)


def pooled_cost_shares(requests: DataFrame) -> DataFrame:
    return _shares(cost_components(requests).agg(*(F.sum(c).alias(c) for c in COSTS)), [], COSTS)


def role_shares(requests: DataFrame, parts: dict[str, tuple[str, ...]], keys: list[str]) -> DataFrame:
    """Each part's share of the sum of all parts, per request with any of their tokens."""
    sums = requests.select(*keys, *(sum((F.col(f"tokens_{f}") for f in fields), F.lit(0)).alias(name) for name, fields in parts.items()))
    return _shares(sums, keys, list(parts))


def context_shares(requests: DataFrame, parts: dict[str, tuple[str, ...]]) -> DataFrame:
    """Quartiles of each part's share of the input, by size bins of the number of messages."""
    rows = settled(role_shares(requests.filter("n_messages >= 1"), parts, ["n_messages"]), "shares")
    return size_bins(rows, "n_messages", list(parts))


def user_prompt_rise(requests: DataFrame) -> DataFrame:
    """Tokens of each new user prompt: the rise of user tokens over the step before, all of them at step 0."""
    rise = F.when(F.col("step") > 0, F.col("tokens_user") - F.lag("tokens_user").over(in_session())).otherwise(F.col("tokens_user"))
    return requests.withColumn("rise", rise).filter((F.col("step_trigger") == "user") & (F.col("rise") > 0)).select("session_id", "step", F.col("rise").cast("long").alias("rise"))


def growth_rows(requests: DataFrame) -> DataFrame:
    return requests.filter(reports_cache() & (F.col("prompt_tokens") > 0) & (F.col("n_messages") >= 1))


def tokens_per_request(requests: DataFrame) -> DataFrame:
    """Medians of input, uncached and output tokens (outputs over one token), and the share of rows with more cached than input."""
    return requests.agg(
        F.percentile("prompt_tokens", F.lit(0.5)).alias("input"), F.percentile(uncached(), F.lit(0.5)).alias("uncached"),
        F.percentile(F.when(F.col("completion_tokens") > 1, F.col("completion_tokens")), F.lit(0.5)).alias("output"),
        F.avg(F.when(reports_cache(), (F.col("cache_read_tokens") > F.col("prompt_tokens")).cast("double"))).alias("negative_uncached"),
    )


def rank_bins(shares: DataFrame, sort_by: list[str], parts: list[str], most: int = 200, per_bin: int = 10) -> DataFrame:
    """Rows sorted and cut into equal bins; each bin's mean shares, made to add up to 1.

    The global rank comes from range partitions and the sums of their sizes, so no task sees all rows."""
    n = shares.count()
    bins = min(most, max(n // per_bin, 1))
    ranked = global_rank(shares, sort_by, "__rank")
    means = ranked.groupBy(F.expr(f"cast((__rank * {bins}) div {max(n, 1)} as int)").alias("bin")).agg(*(F.avg(p).alias(p) for p in parts))
    return _shares(means, ["bin"], parts).withColumn("percentile", (F.col("bin") + 0.5) * 100 / bins)


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rank from 0 by `order`, which must be a total order.

    Range partitions are written once with their numbers; ranks within them and their sizes are read from that table,
    for a second evaluation could draw other bounds."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = settled(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__p").orderBy(*order)
    sizes = parted.groupBy("__p").agg(F.count("*").alias("__n"))
    # one row a partition
    before = sizes.withColumn("__ahead", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__ahead")
    return parted.withColumn("__i", F.row_number().over(inside) - 1).join(F.broadcast(before), "__p").withColumn(name, F.col("__i") + F.col("__ahead")).drop("__p", "__i", "__ahead")


def rank_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Rank from 0 by `order` within each value of `group`, few or many; no group meets in one task.

    Range partitions of (group, order) are written once. A group is cut only where it is the last of a partition and the first of
    the next, so what stands before a part of it is known for two parts a partition at most."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = settled(df.repartitionByRange(parts, group, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__p", group).orderBy(*order)
    sizes = parted.groupBy("__p", group).agg(F.count("*").alias("__n"))
    of_group = Window.partitionBy(group)
    ahead = F.sum("__n").over(of_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.withColumn("__ahead", ahead).withColumn("__parts", F.count("*").over(of_group)).filter("__parts > 1 and __ahead is not null").select(F.col("__p").alias("__q"), F.col(group).alias("__g"), "__ahead")
    ranked = parted.withColumn("__i", F.row_number().over(inside) - 1)
    ranked = ranked.join(F.broadcast(before), (F.col("__p") == F.col("__q")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    return ranked.select(*df.columns, (F.col("__i") + F.coalesce("__ahead", F.lit(0))).alias(name))


def cdf(df: DataFrame, value: str) -> DataFrame:
    """Each finite value with the share of values at or below its place; ties keep places of their own."""
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).alias("value"))
    n = finite.count()
    keyed = finite.withColumn("__u", F.monotonically_increasing_id())
    return global_rank(keyed, ["value", "__u"], "__r").select("value", ((F.col("__r") + 1) / F.lit(max(n, 1))).alias("share"))


def size_bins(df: DataFrame, x: str, values: list[str], edges_wanted: int = 22, least: int = 50) -> DataFrame:
    """Quartiles of each value per geometric, right-closed bin of x; the edges (at most 22) are planned on the driver."""
    import numpy as np

    upper = df.agg(F.percentile(x, F.lit(0.99))).first()[0]
    edges = np.unique(np.round(np.geomspace(1, float(upper or 1), edges_wanted))).tolist()
    at = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        low = F.col(x) >= edges[k] if k == 0 else F.col(x) > edges[k]
        at = F.when(low & (F.col(x) <= edges[k + 1]), k).otherwise(at)
    mids = F.element_at(F.array(*(F.lit((a + b) / 2 if k else (a - 0.001 + b) / 2) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))), F.col("bin") + 1)
    long = df.withColumn("bin", at).filter("bin is not null").select("bin", F.explode(F.array(*(F.struct(F.lit(v).alias("series"), F.col(v).cast("double").alias("value")) for v in values))).alias("s")).select("bin", "s.*").filter("value is not null")
    q = F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")
    return long.groupBy("series", "bin").agg(q, F.count("*").alias("n")).filter(F.col("n") >= least).select("series", mids.alias("mid"), F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "n")
