"""Cheaper reads: what a harness that mutates less would pay, by TTL and read price cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import settled
from .tokens import rank_within
from .turns import in_session

# fixed values
TTLS = (("5m", 300.0), ("15m", 900.0), ("none", float("inf")))
CUTS = 20
FORCED_COMPACTION_TOKENS = 900_000


def shared_prefixes(reads: DataFrame) -> DataFrame:
    """Blocks of each request, and how many leading ones it shares with the step before.

    Each read looks at its position in the step before; the first position that differs ends the prefix. Rows are placed by session
    alone, so reads that lie by session already are compared and counted without another shuffle."""
    before = Window.partitionBy("session_id", "pos").orderBy("step").rangeBetween(-1, -1)
    low, high = (f("block_id").over(before) for f in (F.min, F.max))
    j = reads.select("session_id", "step", "pos", "block_id", low.alias("__low"), high.alias("__high"))
    same = (F.col("__low") == F.col("block_id")) & (F.col("__high") == F.col("block_id"))
    differs = F.min(F.when(~F.coalesce(same, F.lit(False)), F.col("pos")))
    return j.groupBy("session_id", "step").agg(F.count("*").cast("int").alias("blocks"), F.coalesce(differs, F.count("*")).cast("int").alias("shared_blocks"))


def common_prefix(a, b):
    """Length of the common prefix of two array columns, in one row."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(n == 0, 0).otherwise(F.when(first == 0, n).otherwise(first - 1)).cast("int")


def step_facts(requests: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Steps with gap, cached tokens if warm, and reduction facts. A request without blocks or prompt count is an error, and one
    with two rows of prefixes too."""
    once = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("repeated prefixes: "), "session_id")).cast("int"))
    prefixes = prefixes.groupBy("session_id", "step").agg(F.coalesce(once, F.min("blocks")).alias("blocks"), F.min("shared_blocks").alias("shared_blocks"))
    j = requests.join(prefixes, ["session_id", "step"], "left")
    missing = F.when(F.col("blocks").isNull() | F.col("prompt_tokens").isNull(), F.raise_error(F.concat(F.lit("no blocks or no prompt count: "), "session_id")))
    j = j.withColumn("prompt_tokens", F.coalesce(missing.cast("long"), F.col("prompt_tokens")))
    before = F.lag("prompt_tokens").over(in_session())
    share = F.when(F.col("blocks") > 0, F.col("shared_blocks") / F.col("blocks")).otherwise(0.0)
    j = j.withColumn("before", before).withColumn("gap_s", (F.col("start_ms") - F.lag("end_ms").over(in_session())) / 1000).withColumn("cached_if_warm", F.col("prompt_tokens") * share)
    j = j.withColumn("is_reduction", F.coalesce((F.col("transition") == "mutation") & (F.col("prompt_tokens") < F.col("before")), F.lit(False)))
    return j.select(
        "session_id", "step", "week", "prompt_tokens", "completion_tokens", "gap_s", "cached_if_warm", "is_reduction",
        F.when(F.col("is_reduction"), F.col("prompt_tokens") - F.col("cached_if_warm")).otherwise(0.0).alias("penalty"), F.when(F.col("is_reduction"), F.col("before") - F.col("prompt_tokens")).otherwise(0).cast("double").alias("removed_tokens"),
        F.greatest(F.max("prompt_tokens").over(Window.partitionBy("session_id")), F.lit(FORCED_COMPACTION_TOKENS)).alias("compaction_tokens"),
    )


def skip_ranks(steps: DataFrame) -> DataFrame:
    """Each reduction's rank by penalty in its week (ties by session and step), and their number; no week meets in one task."""
    r = steps.filter("is_reduction").select("week", "penalty", "session_id", "step")
    ranked = rank_within(r, "week", ["penalty", "session_id", "step"], "rank")
    n = r.groupBy("week").agg(F.count("*").alias("reductions"))
    return ranked.join(F.broadcast(n), "week").select("session_id", "step", (F.col("rank") + 1).cast("int").alias("rank"), "reductions")  # a row a week


def skip_sweep(steps: DataFrame) -> DataFrame:
    """Token sums and counts per week, TTL and price cut. A session's steps are folded in order, carrying what skipped reductions kept;
    today's fold knows no cut, so a session takes one fold a TTL for it and one a TTL and cut for the rest."""
    steps = settled(steps, "steps")
    # cut -1 is today
    grid = F.array(*(F.struct(F.lit(t).alias("ttl"), F.lit(s).alias("ttl_s"), F.lit(c).alias("cut")) for t, s in TTLS for c in range(-1, CUTS + 1)))
    s = steps.join(skip_ranks(steps), ["session_id", "step"], "left")
    fields = F.struct("step", "prompt_tokens", "cached_if_warm", "removed_tokens", "gap_s", "rank", "reductions")
    sessions = s.groupBy("week", "session_id").agg(F.sort_array(F.collect_list(fields)).alias("steps"), F.first("compaction_tokens").alias("limit"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("output"), F.count_if("is_reduction").alias("reductions"))
    d = lambda x: F.lit(x).cast("double")
    zero = F.struct(d(0).alias("p"), d(0).alias("c"), F.lit(0).cast("long").alias("f"), d(0).alias("carry"), F.lit(0).cast("long").alias("k"))

    def fold(g):
        def step(a, x):
            warm = F.coalesce(x["gap_s"] <= g["ttl_s"], F.lit(False))
            skipped = (g["cut"] >= 0) & F.coalesce(x["rank"] <= F.floor(g["cut"] * x["reductions"] / CUTS + 0.5), F.lit(False))
            carry = a["carry"] + F.when(skipped, x["removed_tokens"]).otherwise(0.0)
            context = x["prompt_tokens"] + carry
            forced = context > F.col("limit")
            p = F.when(forced, x["prompt_tokens"].cast("double")).when(skipped & warm, 0.0).when(warm, x["prompt_tokens"] - x["cached_if_warm"]).otherwise(context)
            c = F.when(forced, 0.0).when(skipped & warm, context).when(warm, x["cached_if_warm"] + carry).otherwise(0.0)
            return F.struct((a["p"] + p).alias("p"), (a["c"] + c).alias("c"), (a["f"] + forced.cast("long")).alias("f"), F.when(forced, 0.0).otherwise(carry).alias("carry"), (a["k"] + skipped.cast("long")).alias("k"))

        return F.struct(g["ttl"].alias("ttl"), g["cut"].alias("cut"), F.aggregate("steps", zero, step).alias("m"))

    # the folds of a session are made in its row: 66 small results leave it, not 66 copies of its steps
    g = sessions.select("week", "output", "reductions", F.explode(F.transform(grid, fold)).alias("g")).select("week", "output", "reductions", "g.*")
    sums = g.groupBy("week", "ttl", "cut").agg(
        F.sum("m.p").alias("p"), F.sum("m.c").alias("c"), F.sum("output").cast("double").alias("output_tokens"), F.sum("reductions").alias("reductions"), F.sum("m.k").alias("skipped_reductions"), F.sum("m.f").alias("forced_compactions"),
    )
    # 66 rows a week
    w = Window.partitionBy("week", "ttl")
    today = lambda c: F.max(F.when(F.col("cut") < 0, F.col(c))).over(w)
    sums = sums.withColumn("today_prefilled_tokens", today("p")).withColumn("today_cached_tokens", today("c")).filter("cut >= 0")
    return sums.select(
        "week", "ttl", (F.col("cut") / CUTS).alias("read_price_cut"), "today_prefilled_tokens", "today_cached_tokens", F.col("p").alias("prefilled_tokens"), F.col("c").alias("cached_tokens"),
        "output_tokens", "reductions", "skipped_reductions", "forced_compactions",
    )


def multiples(sums: DataFrame) -> DataFrame:
    read, out = 1 - F.col("read_price_cut"), F.col("output_tokens") * 50.0
    today = F.col("today_prefilled_tokens") * 10.0 + F.col("today_cached_tokens") * read + out
    less = F.col("prefilled_tokens") * 10.0 + F.col("cached_tokens") * read + out
    return sums.select("ttl", "read_price_cut", (F.col("today_prefilled_tokens") / F.col("prefilled_tokens")).alias("prefill_multiple"), (today / less).alias("cost_multiple"))


def break_even(curves: DataFrame) -> DataFrame:
    """Per TTL: the highest read price at and below which today's multiple is at least 1, the multiple at free reads, and the lowest."""
    w = Window.partitionBy("ttl").orderBy(F.desc("read_price_cut")).rowsBetween(Window.unboundedPreceding, 0)
    c = curves.withColumn("low", F.min("cost_multiple").over(w))
    return c.groupBy("ttl").agg(F.max(F.when(F.col("low") >= 1, F.round(1 - F.col("read_price_cut"), 2))).alias("break_even"), F.max_by("cost_multiple", "read_price_cut").alias("at_free_reads"), F.min("cost_multiple").alias("lowest"))
