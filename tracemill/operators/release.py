"""Release tables, manifests and comparisons of two exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arguments, strings
from . import lineage


def provider_letters(df: DataFrame, letters: dict[str, str]) -> DataFrame:
    """provider as its letter; null stays null, an unknown provider is an error."""
    m = F.create_map(*(F.lit(x) for kv in letters.items() for x in kv))
    letter = F.when(F.col("provider").isNull(), None).otherwise(F.coalesce(m[F.col("provider")], F.raise_error(F.concat(F.lit("unknown provider "), "provider")).cast("string")))
    return df.withColumn("provider", letter)


def released_requests(requests: DataFrame, letters: dict[str, str], salt: str) -> DataFrame:
    return provider_letters(requests, letters).withColumn("session_id", strings.pseudonym(F.col("session_id"), "session", salt, 32)).withColumn("user_id", strings.pseudonym(F.col("user_id"), "user", salt, 16))


def salt_series(salt: Column) -> Column:
    """Public fingerprint of a salt, which tells releases of one salt apart from others without giving it away."""
    return F.substring(F.sha2(salt, 256), 1, 16)


def members(rows: DataFrame, released: DataFrame) -> DataFrame:
    """Rows of released sessions, under the session's released id. released: session_id, released_id."""
    return rows.join(released, "session_id").drop("session_id").withColumnRenamed("released_id", "session_id").select(*rows.columns)


def released_calls(calls: DataFrame, released: DataFrame, latencies: DataFrame) -> DataFrame:
    """Calls of released sessions with the latency of their request (session_id, step, latency_ms), null where there is none."""
    return members(calls.join(latencies, ["session_id", "step"], "left"), released)


def request_facts(requests: DataFrame, transitions: DataFrame, digests: DataFrame) -> DataFrame:
    """requests with their transition and cause, both null where there is none, and their digest columns, whose lack is an error."""
    j = requests.join(transitions.select("session_id", "step", "transition", "cause"), ["session_id", "step"], "left").join(digests.withColumn("__d", F.lit(1)), ["session_id", "step"], "left")
    missing = F.when(F.col("__d").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no digest of"), "session_id", "step")).cast("int")).otherwise(F.col("step"))
    return j.withColumn("step", missing).drop("__d")


def release_shaped(calls: DataFrame, full: list[str]) -> DataFrame:
    """The full form of some columns beside the released one: <column>_full becomes <column>, the released one goes."""
    return calls.drop(*full).withColumnsRenamed({f"{c}_full": c for c in full})


def hidden_shares(calls: DataFrame) -> DataFrame:
    """Shares of calls whose name was hidden, and whose programs, argument keys or command words were. calls: name, programs,
    programs_full, arguments_skeleton, arguments_skeleton_full."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    words = lambda c: F.transform(F.filter(arguments.skeleton_pairs(F.col(c)), lambda p: p["key"].isin("command", "commands", "cmd")), lambda p: p["value"])
    return calls.agg(
        share(F.col("name") == "other").alias("name"), share(F.col("programs_full").isNotNull() & ~F.col("programs_full").eqNullSafe(F.col("programs"))).alias("program"),
        share(F.contains("arguments_skeleton", F.lit('"<key>"'))).alias("key"), share(~words("arguments_skeleton_full").eqNullSafe(words("arguments_skeleton"))).alias("command_word"),
    )


# fixed value
FORMAT_VERSION = 1


def manifest(sessions: DataFrame, requests: DataFrame, calls: DataFrame, reads: DataFrame, reasons: DataFrame, tokenizer: str) -> DataFrame:
    """One row of a release: format, tokenizer, rows of each table, sessions left out by reason, and distinct blocks."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(sessions, "sessions").select(F.lit(FORMAT_VERSION).alias("format_version"), F.lit(tokenizer).alias("tokenizer"), "sessions")
    by_reason = reasons.groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("excluded"))
    for part in (count(requests, "requests"), count(calls, "tool_calls"), count(reads.select("block_id").distinct(), "blocks"), by_reason):
        out = out.join(part, F.lit(True))  # one row each
    return out


def week_counters(outcomes: DataFrame, links: DataFrame, chains: DataFrame, spawns: DataFrame) -> DataFrame:
    """One row from lines to matched spawn calls. outcomes: outcome of each line; links: parent_request_id; chains: session_id; spawns: child."""
    a = outcomes.groupBy("outcome").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("lines"), F.coalesce(F.sum(F.when(F.col("outcome") == "unparsable", F.col("n"))), F.lit(0)).alias("unparsable"), F.coalesce(F.sum(F.when(F.col("outcome") == "kept", F.col("n"))), F.lit(0)).alias("kept"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("outcome").isin("kept", "unparsable"), F.struct("outcome", "n"))))).alias("dropped"),
    )
    b = links.agg(F.count("parent_request_id").alias("linked"))
    c = chains.agg(F.count_distinct("session_id").alias("sessions"))
    d = spawns.agg(F.count("*").alias("spawn_calls"), F.count("child").alias("spawn_calls_matched"))
    return a.join(b, F.lit(True)).join(c, F.lit(True)).join(d, F.lit(True))


def release_sessions(sessions: DataFrame, agent: DataFrame, spawns: DataFrame) -> DataFrame:
    """Agent sessions and all they spawned, each with the top session of its trace. sessions: session_id, parent_session_id."""
    inside = lineage.closure(agent, spawns)
    tops = lineage.roots(sessions.select(F.col("session_id").alias("request_id"), F.col("parent_session_id").alias("parent_request_id")))
    return inside.join(tops.select(F.col("request_id").alias("session_id"), F.col("root").alias("trace_id"), "depth"), "session_id")


def session_rows(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id").agg(F.min("harness").alias("harness"), F.count("*").alias("requests"), F.sum("n_tool_calls").alias("tool_calls"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def week_sessions(chains: DataFrame, signals: DataFrame, inside: DataFrame, spawns: DataFrame) -> DataFrame:
    """A row a session of the release, counted on its main chain. chains: request_id, session_id, on_main_chain, turn, is_agent_session; signals: request_id, user_id,
    harness, start_ms, end_ms, of which the session's own id names its root; inside: session_id, trace_id; spawns: session_id, request_id, call_index,
    child_session_id. A spawner outside the release is none."""
    on_chain = chains.filter("on_main_chain").join(inside.select("session_id", "trace_id"), "session_id")
    facts = on_chain.join(signals.select("request_id", "end_ms"), "request_id").groupBy("session_id").agg(
        F.any_value("trace_id").alias("trace_id"), F.bool_or("is_agent_session").alias("is_agent_session"), F.count("*").alias("n_requests"), F.count_if(F.col("turn") == "user").alias("n_user_turns"), F.count_if(F.col("turn") == "tool").alias("n_tool_turns"), F.max("end_ms").alias("end_ms")
    )
    root = signals.select(F.col("request_id").alias("session_id"), "user_id", "harness", "start_ms")
    by = spawns.filter("child_session_id is not null").join(inside.select("session_id"), "session_id", "left_semi")
    by = by.select(F.col("child_session_id").alias("session_id"), F.col("session_id").alias("spawned_by_session_id"), F.col("request_id").alias("spawned_by_request_id"), F.col("call_index").alias("spawned_by_call_index"))
    j = facts.join(root, "session_id").join(by, "session_id", "left")
    return j.select("session_id", "trace_id", "user_id", "harness", "is_agent_session", "n_requests", "n_user_turns", "n_tool_turns", "start_ms", "end_ms", "spawned_by_session_id", "spawned_by_request_id", "spawned_by_call_index")


def load_reference(links: DataFrame, sessions: DataFrame, spawns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Another export's tables as ours: agent sessions by their root's id (root_request_id, harness, root_week, root_month, last_week), their requests
    (session_id, request_id; session_id is the root's id), and matched spawn pairs (request_id, child_root_request_id). links: request_id, end_us, session; sessions: session, root_request_id, framework,
    is_agent_session, last_end_us; spawns: request_id, matched, child_root_request_id. A session whose root has no link is left out."""
    day = lambda us: F.to_date(F.timestamp_millis(F.floor(us / 1000).cast("long")))
    week = lambda us: F.date_format(strings.week_of(day(us)), "yyyy-MM-dd")
    roots = links.select(F.col("request_id").alias("root_request_id"), "end_us")
    agents = sessions.filter("is_agent_session").join(roots, "root_request_id")
    members_of = agents.select("session", F.col("root_request_id").alias("session_id")).join(links.select("session", "request_id"), "session").select("session_id", "request_id").distinct()
    facts = agents.select("root_request_id", F.col("framework").alias("harness"), week(F.col("end_us")).alias("root_week"), F.date_format(day(F.col("end_us")), "yyyy-MM").alias("root_month"), week(F.col("last_end_us")).alias("last_week"))
    return facts, members_of, spawns.filter("matched").select("request_id", "child_root_request_id").distinct()


def compare(ours: DataFrame, other: DataFrame) -> DataFrame:
    """(session_id, request_id) of two exports: per session same, more, fewer, differs, or only in one of them."""
    sets = lambda d, n: d.groupBy("session_id").agg(F.sort_array(F.collect_set("request_id")).alias(n))
    j = sets(ours, "a").join(sets(other, "b"), "session_id", "full")
    outcome = (
        F.when(F.col("b").isNull(), "only_ours").when(F.col("a").isNull(), "only_other").when(F.col("a") == F.col("b"), "same")
        .when(F.size(F.array_except("b", "a")) == 0, "more").when(F.size(F.array_except("a", "b")) == 0, "fewer").otherwise("differs")
    )
    return j.select("session_id", outcome.alias("outcome"))


def outcome_shares(outcomes: DataFrame, month: str = "month") -> DataFrame:
    """Counts of each outcome by month, with an all row."""
    return outcomes.withColumn("m", F.col(month)).rollup("outcome", "m").agg(F.count("*").alias("n"), F.grouping("m").alias("g"), F.grouping("outcome").alias("o")).filter("o = 0").select("outcome", F.when(F.col("g") == 1, "all").otherwise(F.col("m")).alias("month"), "n")


def differing(before: DataFrame, after: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """Long rows (keys, name, before, after) of the numbers that differ, a missing row included."""
    def flat(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias(name)) for n in numbers))).alias("x")).select(*keys, "x.*")
    j = flat(before, "before").join(flat(after, "after"), [*keys, "name"], "full")
    return j.filter(~F.col("before").eqNullSafe(F.col("after")))


def relabel(sessions: DataFrame, name: str, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions of one label moved to what the rules now say (session_id, harness in current), and the moves refused: to or from the benchmark."""
    j = sessions.join(current.withColumnRenamed("harness", "__now"), "session_id", "left")
    moves = (F.col("harness") == name) & F.col("__now").isNotNull() & (F.col("__now") != name)
    unsafe = moves & ((F.col("harness") == "eval:swe-bench") | (F.col("__now") == "eval:swe-bench"))
    return j.withColumn("harness", F.when(moves & ~unsafe, F.col("__now")).otherwise(F.col("harness"))).drop("__now"), j.filter(unsafe).select("session_id", "harness", F.col("__now").alias("asked"))
