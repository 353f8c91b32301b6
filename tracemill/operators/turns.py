"""Turns, waits, durations and scopes. Requests are keyed (session_id, step); every order ends in that key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..schemas import BENCHMARK_HARNESS

TOOL_WAITED_FOR = ("tool", "ask_user_tool", "subagent")


def in_session() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("step")


def scope_of(harness: Column) -> Column:
    return F.when(harness == BENCHMARK_HARNESS, "SWE-Bench").otherwise("Agentic")


def sessions_in_scope(sessions: DataFrame, requests: DataFrame, calls: DataFrame, scope: str = "Agentic") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Top-level sessions of a scope (or All), their requests with session facts and number of calls, and their calls."""
    top = sessions.filter(F.col("parent_session_id").isNull()).withColumn("scope", scope_of(F.col("harness")))
    if scope != "All":
        top = top.filter(F.col("scope") == scope)
    facts = top.select("session_id", "scope", "harness", "user_id")
    own = calls.join(top.select("session_id"), "session_id", "left_semi")
    n = own.groupBy("session_id", "step").agg(F.count("*").cast("int").alias("n_tool_calls"))
    drop = [c for c in ("scope", "harness", "user_id", "n_tool_calls") if c in requests.columns]
    out = requests.drop(*drop).join(facts, "session_id").join(n, ["session_id", "step"], "left").fillna(0, ["n_tool_calls"])
    return top, out, own


def waited_for(step: Column, trigger: Column, categories: Column) -> Column:
    """What a request waited for, from the categories its predecessor called: user, subagent, ask-user, tool in this order."""
    has = lambda c: F.coalesce(F.array_contains(categories, c), F.lit(False))
    return F.when(step == 0, None).when(trigger == "user", "user").when(has("Subagent"), "subagent").when(has("Ask User"), "ask_user_tool").otherwise("tool")


def with_waited_for(requests: DataFrame, calls: DataFrame) -> DataFrame:
    called = calls.groupBy("session_id", "step").agg(F.collect_set("category").alias("__called"))
    joined = requests.join(called, ["session_id", "step"], "left").withColumn("__before", F.lag("__called").over(in_session()))
    return joined.withColumn("waited_for", waited_for(F.col("step"), F.col("step_trigger"), F.col("__before"))).drop("__called", "__before")


def wait_s() -> Column:
    """Seconds between the previous completion in the session and this arrival."""
    return (F.col("start_ms") - F.lag("end_ms").over(in_session())) / 1000


def turn_number() -> Column:
    return F.sum(F.when(F.col("step_trigger") == "user", 1).otherwise(0)).over(in_session().rowsBetween(Window.unboundedPreceding, 0))


def counts_per_session(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id").agg(F.count("*").alias("requests"), F.count_if(F.col("step_trigger") == "user").alias("user_steps"), F.count_if(F.col("step_trigger") == "tool").alias("tool_steps"))


def turn_durations(requests: DataFrame) -> DataFrame:
    return requests.withColumn("turn", turn_number()).groupBy("session_id", "turn").agg(((F.max("end_ms") - F.min("start_ms")) / 1000).alias("duration_s"))


def session_durations(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id").agg(((F.max("end_ms") - F.min("start_ms")) / 1000).alias("duration_s"))


def tool_wait_s() -> Column:
    """The wait of the next request, if that waited for a call."""
    return F.when(F.lead("waited_for").over(in_session()).isin(*TOOL_WAITED_FOR), (F.lead("start_ms").over(in_session()) - F.col("end_ms")) / 1000)


def totals(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """One row of population totals; a missing count adds 0."""
    r = requests.agg(
        F.round((F.max("end_ms") - F.min("start_ms")) / 86_400_000 / 30.44, 1).alias("months"), F.count("*").alias("requests"), F.sum("n_tool_calls").alias("tool_calls"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("cache_read_tokens"), F.lit(0)).alias("cached_tokens"),
    )
    s = sessions.agg(F.count("*").alias("sessions"), F.count_distinct(F.when(F.col("harness") != BENCHMARK_HARNESS, F.col("harness"))).alias("harnesses"))
    return r.join(s, F.lit(True))


def by_harness(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    s = sessions.groupBy("harness").agg(F.count("*").alias("sessions"))
    t = requests.groupBy("harness").agg(F.sum("prompt_tokens").alias("input_tokens"))
    return s.join(t, "harness", "full").select("harness", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"))
