"""Queries over tables with the full published columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import strings
from ..operators import release, whatif
from ..operators.lineage import new_path, settled
from ..sources import tables, traces
from .more import _FAM, _family
from .registry import query


def _requests(s, d, base=None):
    """Requests with every published column."""
    k, step = F.col("k"), F.col("step")
    roles = F.struct(*(F.col(f"tokens_{r}").cast("long").alias(r) for r in ("system", "user", "assistant", "tool", "tool_definitions")))
    r = fx.requests(s, d, base)
    return r.select(
        "session_id", "step", F.when(step > 0, F.when(k % 2 == 0, "tool_id").otherwise("text")).alias("link_reason"), "start_ms", "end_ms", "ttft_ms", "model", "provider", (k % 3 == 0).alias("stream"),
        F.when(k % 4 > 0, "stop").alias("finish_reason"), "step_trigger", "waited_for", "prompt_tokens", "completion_tokens", "cache_read_tokens", roles.alias("role_tokens"), F.col("n_messages").cast("int").alias("n_messages"),
        F.when(k % 5 > 0, F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.concat(F.lit("tool "), i))).alias("tool_definition_names"), "transition", "cause", F.transform(F.sequence(F.lit(0), 2 + step % 5), lambda p: (k * 100 + p).cast("long")).alias("block_ids"),
    )


_BLOCKS = "[k * 100 + p for p in range(3 + step % 5)]"


def _calls(s, d, base=None):
    c = fx.tool_calls(s, d, base)
    return c.select("session_id", "step", "call_index", F.concat(F.lit("t"), F.col("step") % 4).alias("name"), "category", "programs", "parse_status", F.concat(F.lit('{"a":"<num>","n":'), "call_index", F.lit("}")).alias("arguments_skeleton"), "outcome", "result_tokens", (100 * F.col("step") + F.col("call_index")).cast("long").alias("latency_ms"))


def _flat(s, d):
    base = settled(fx.base_requests(s, d), "base")
    f = _family(s, d, base).select("session_id", "harness", "user_id", "parent_session_id", "spawned_by_step", "spawned_by_call_index")
    return traces.flatten(traces.nest(f, _requests(s, d, base), _calls(s, d, base)), "line")


@query("S1_all_request_columns", f"""SELECT session_id, step, CASE WHEN step > 0 THEN CASE WHEN k % 2 = 0 THEN 'tool_id' ELSE 'text' END END AS link_reason, start_ms, end_ms, ttft_ms, model, provider, k % 3 = 0 AS stream, CASE WHEN k % 4 > 0 THEN 'stop' END AS finish_reason, step_trigger, waited_for,
    prompt_tokens, completion_tokens, cache_read_tokens, concat_ws(',', tokens_system, tokens_user, tokens_assistant, tokens_tool, tokens_tool_definitions) AS role_tokens, n_messages::INT AS n_messages, CASE WHEN k % 5 > 0 THEN array_to_string(['tool ' || i for i in range(k % 3 + 1)], ',') END AS tool_definition_names, transition, cause,
    array_to_string({_BLOCKS}, ',') AS block_ids FROM fx_waited""")  # fmt: skip
def _(s, d):
    r = _flat(s, d)[1]
    joined = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return r.select(*(F.concat_ws(",", "role_tokens.*").alias(c) if c == "role_tokens" else joined(c) if c in ("tool_definition_names", "block_ids") else F.col(c) for c in r.columns))


@query("S1_all_call_columns", """SELECT session_id, step, call_index, 't' || step % 4 AS name, category, array_to_string(programs, ',') AS programs, parse_status, '{"a":"<num>","n":' || call_index || '}' AS arguments_skeleton, outcome, result_tokens::BIGINT AS result_tokens, (100 * step + call_index)::BIGINT AS latency_ms FROM fx_tool_calls""")
def _(s, d):
    c = _flat(s, d)[2]
    return c.select(*(F.when(F.col(x).isNotNull(), F.array_join(x, ",")).alias(x) if x == "programs" else F.col(x) for x in c.columns))


@query("S6_block_ids", f"SELECT session_id, step, unnest(range(3 + step % 5)) AS pos, unnest({_BLOCKS}) AS block_id FROM fx_requests")
def _(s, d):
    return tables.block_reads(_requests(s, d).select("session_id", "step", "block_ids"))


@query("R7_block_partition", f"SELECT * FROM (SELECT session_id, step, unnest(range(3 + step % 5)) AS pos, unnest({_BLOCKS}) AS block_id FROM fx_requests) WHERE block_id % 4 = 1")
def _(s, d):
    return tables.block_reads(_requests(s, d).select("session_id", "step", "block_ids"), 4, 1)


@query("S6_prefixes_of_published_blocks", f"""x_b AS (SELECT session_id, step, {_BLOCKS} AS a, lag({_BLOCKS}) OVER (PARTITION BY session_id ORDER BY step) AS b FROM fx_requests)
    SELECT session_id, step, len(a)::INT AS blocks, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_position([coalesce(a[i] = b[i], false) for i in range(1, len(a) + 1)], false) - 1, len(a)) END::INT AS shared_blocks FROM x_b""")  # fmt: skip
def _(s, d):
    return whatif.shared_prefixes(tables.block_reads(_requests(s, d).select("session_id", "step", "block_ids")))


@query("J9_aligned", "SELECT session_id, step, -start_ms AS position FROM fx_requests")
def _(s, d):
    r = fx.base_requests(s, d).select("session_id", "step", "start_ms")
    return tables.aligned(r.select("session_id", "step"), r.select("session_id", "step", (-F.col("start_ms")).alias("position")), ["session_id", "step"])


_RELEASED = "x_rel AS (SELECT DISTINCT session_id, substr(sha256('k' || 'session:' || session_id), 1, 32) AS rid FROM fx_requests WHERE harness <> 'hermes')"


def _released(s, d):
    r = fx.base_requests(s, d).filter("harness <> 'hermes'").select("session_id").distinct()
    return r.withColumn("released_id", strings.pseudonym(F.col("session_id"), "session", "k", 32))


@query("F14_released_requests", _RELEASED + " SELECT rid AS session_id, step, prompt_tokens FROM fx_requests JOIN x_rel USING (session_id)")
def _(s, d):
    return release.members(fx.base_requests(s, d).select("session_id", "step", "prompt_tokens"), _released(s, d))


@query("J16_released_calls", _RELEASED + " SELECT rid AS session_id, c.step, call_index, category, CASE WHEN c.step % 3 > 0 THEN end_ms - start_ms END AS latency_ms FROM fx_tool_calls c JOIN x_rel r ON r.session_id = c.session_id JOIN fx_requests q ON q.session_id = c.session_id AND q.step = c.step")
def _(s, d):
    latencies = fx.base_requests(s, d).filter("step % 3 > 0").select("session_id", "step", (F.col("end_ms") - F.col("start_ms")).alias("latency_ms"))
    return release.released_calls(fx.tool_calls(s, d).select("session_id", "step", "call_index", "category"), _released(s, d), latencies)


@query("J17_request_facts", "SELECT session_id, step, CASE WHEN k % 2 = 0 THEN transition END AS transition, CASE WHEN k % 2 = 0 THEN cause END AS cause, n_messages FROM fx_requests")
def _(s, d):
    r = fx.base_requests(s, d)
    return release.request_facts(r.select("session_id", "step"), r.filter("k % 2 = 0"), r.select("session_id", "step", "n_messages"))


@query("M12_salt_series", "SELECT DISTINCT user_id, substr(sha256(user_id), 1, 16) AS series FROM fx_requests")
def _(s, d):
    return fx.base_requests(s, d).select("user_id").distinct().select("user_id", release.salt_series(F.col("user_id")).alias("series"))


_HIDDEN = """x_h AS (SELECT session_id, step, call_index, CASE WHEN step % 3 = 0 THEN 'other' ELSE 'read' END AS name, programs AS pf, CASE WHEN step % 4 = 0 AND programs IS NOT NULL THEN ['<word>'] ELSE programs END AS p, step FROM fx_tool_calls)"""


def _hidden(s, d):
    c, step = fx.tool_calls(s, d), F.col("step")
    full = F.concat(F.lit('{"command": "ls '), "call_index", F.lit('", "a": "<num>"}'))
    shown = F.when(step % 5 == 0, '{"command": "ls <word>", "<key>": "<num>"}').when(step % 5 == 1, F.concat(F.lit('{"command": "ls '), "call_index", F.lit('", "<key>": "<num>"}'))).otherwise(full)
    return c.select("session_id", "step", "call_index", F.when(step % 3 == 0, "other").otherwise("read").alias("name"), F.when((step % 4 == 0) & F.col("programs").isNotNull(), F.array(F.lit("<word>"))).otherwise(F.col("programs")).alias("programs"), F.col("programs").alias("programs_full"), shown.alias("arguments_skeleton"), full.alias("arguments_skeleton_full"))


@query("A40_hidden_shares", _HIDDEN + " SELECT avg((name = 'other')::INT) AS name, avg(coalesce(pf IS NOT NULL AND pf <> p, false)::INT) AS program, avg((step % 5 < 2)::INT) AS key, avg((step % 5 = 0)::INT) AS command_word FROM x_h")
def _(s, d):
    return release.hidden_shares(_hidden(s, d))


@query("F16_full_columns", _HIDDEN + """ SELECT session_id, step, call_index, name, array_to_string(pf, ',') AS programs, '{"command": "ls ' || call_index || '", "a": "<num>"}' AS arguments_skeleton FROM x_h""")
def _(s, d):
    c = release.release_shaped(_hidden(s, d), ["programs", "arguments_skeleton"])
    return c.withColumn("programs", F.when(F.col("programs").isNotNull(), F.array_join("programs", ",")))


@query("K6_result_files", "SELECT harness, count(*) AS requests, 'csv' AS form FROM fx_requests GROUP BY harness UNION ALL SELECT harness, count(*), 'json' FROM fx_requests GROUP BY harness")
def _(s, d):
    """A result table written in both forms and read back."""
    result = fx.base_requests(s, d).groupBy("harness").agg(F.count("*").alias("requests"))
    out = None
    for form in ("csv", "json"):
        path = new_path(s, f"result-{form}")
        tables.write_result(result, path, form)
        back = s.read.schema("harness string, requests long").option("header", True).format(form).load(path).withColumn("form", F.lit(form))
        out = back if out is None else out.union(back)
    return out


def _published(s, d):
    """The three tables written by week as they are published."""
    f, r, c, _ = _flat(s, d)
    path = new_path(s, "published")
    weeks = r.groupBy("session_id").agg(F.date_format(strings.week_of(F.to_date(F.timestamp_millis(F.min("start_ms")))), "yyyy-MM-dd").alias("week"))
    for name, df in (("sessions", f), ("requests", r), ("tool_calls", c)):
        tables.write_table(df.join(weeks, "session_id"), f"{path}/{name}", "week")
    return path


_BY_WEEK = """x_wk AS (SELECT session_id, min(week) AS week FROM fx_requests GROUP BY 1), x_all AS (SELECT 'sessions' AS "table", week, session_id, 0 AS step FROM x_wk UNION ALL SELECT 'requests', w.week, session_id, step FROM fx_requests r JOIN x_wk w USING (session_id) UNION ALL SELECT 'tool_calls', w.week, session_id, step FROM fx_tool_calls JOIN x_wk w USING (session_id))"""


def _counted(tables_):
    parts = [t.select(F.lit(name).alias("table"), "week", "session_id", (F.col("step") if "step" in t.columns else F.lit(0)).alias("step")) for name, t in zip(("sessions", "requests", "tool_calls"), tables_, strict=True)]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("table", "week").agg(F.count("*").alias("rows"), F.count_distinct("session_id").alias("sessions"), F.coalesce(F.sum("step"), F.lit(0)).cast("long").alias("steps"))


@query("S2_all_weeks", _BY_WEEK + ' SELECT "table", week, count(*) AS rows, count(DISTINCT session_id) AS sessions, sum(step)::BIGINT AS steps FROM x_all GROUP BY ALL')
def _(s, d):
    """Every week's tables as one, from their folders."""
    return _counted(tables.load(s, _published(s, d)))


@query("S4_chosen_weeks", _BY_WEEK + ' SELECT "table", week, count(*) AS rows, count(DISTINCT session_id) AS sessions, sum(step)::BIGINT AS steps FROM x_all WHERE week IN (SELECT max(week) FROM x_wk UNION SELECT min(week) FROM x_wk) GROUP BY ALL UNION ALL SELECT \'missing\', \'1999-01-03\', 0, 0, 0')
def _(s, d):
    """The first and the last week, found among the folders and read alone, and a week that is not there."""
    path = _published(s, d)
    weeks = s.read.parquet(f"{path}/sessions").select("week").distinct()
    first, last = weeks.agg(F.min("week"), F.max("week")).first()
    lost = traces.find_weeks(weeks, [str(first), "1999-01-03"]).select(F.lit("missing").alias("table"), "week", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("sessions"), F.lit(0).cast("long").alias("steps"))
    return _counted(tables.load(s, path, [str(first), str(last)])).union(lost)


@query("X38_user_agents", "SELECT event_id, CASE WHEN k % 5 < 3 THEN event_type || '/' || k END AS user_agent FROM fx_requests")
def _(s, d):
    """Metadata as JSON text: with an agent, nested ones that are none, no object, broken, or none at all."""
    from ..sources import logs

    r, k = fx.base_requests(s, d), F.col("k") % 5
    agent = F.concat_ws("/", "event_type", "k")
    metadata = F.when(k < 3, F.to_json(F.struct(F.lit("x").alias("a"), agent.alias("user_agent")))).when(k == 3, F.concat(F.lit('{"deep":{"user_agent":"'), agent, F.lit('"},"user_agent":7}'))).when(F.col("k") % 10 == 4, F.concat(F.lit('["'), agent)).otherwise(F.lit(None).cast("string"))
    lines = r.select("event_id", F.to_json(F.struct(F.lit("r").alias("request_id"), metadata.alias("metadata"))).alias("value"))
    return logs.with_fields(lines).select("event_id", "user_agent")


@query("S13_reference_export", _FAM + """, x_s AS (SELECT session_id, min(harness) AS harness, max(end_ms) AS last FROM fx_requests GROUP BY 1), x_sun AS (SELECT session_id, step, strftime(make_timestamp(end_ms * 1000), '%Y-%m') AS month, strftime(CAST(make_timestamp(end_ms * 1000) AS DATE) - CAST(dayofweek(make_timestamp(end_ms * 1000)) AS INTEGER), '%Y-%m-%d') AS sunday, end_ms FROM fx_requests)
    SELECT s.session_id || ':0' AS root_request_id, s.harness, r.sunday AS root_week, r.month AS root_month, l.sunday AS last_week, (SELECT count(*) FROM fx_requests q WHERE q.session_id = s.session_id) AS requests, (SELECT count(*) FROM x_fam f WHERE f.parent_session_id = s.session_id) AS spawned
    FROM x_s s JOIN x_sun r ON r.session_id = s.session_id AND r.step = 0 JOIN (SELECT session_id, end_ms, any_value(sunday) AS sunday FROM x_sun GROUP BY ALL) l ON l.session_id = s.session_id AND l.end_ms = s.last WHERE s.harness <> 'codex'""")  # fmt: skip
def _(s, d):
    """Another export, in its own names and microseconds, as ours; sessions of one harness are no agents'."""
    r = fx.base_requests(s, d).withColumn("request_id", F.concat_ws(":", "session_id", "step"))
    links = r.select("request_id", (F.col("end_ms") * 1000 + F.col("k")).alias("end_us"), F.concat(F.lit("n"), "session_id").alias("session"))
    sessions = r.groupBy("session_id").agg(F.min("harness").alias("framework"), (F.max("end_ms") * 1000).alias("last_end_us")).select(F.concat(F.lit("n"), "session_id").alias("session"), F.concat(F.col("session_id"), F.lit(":0")).alias("root_request_id"), "framework", (F.col("framework") != "codex").alias("is_agent_session"), "last_end_us")
    lost = sessions.limit(1).withColumn("root_request_id", F.lit("lost"))
    f = _family(s, d)
    spawns = f.filter("parent_session_id is not null").select(F.concat_ws(":", "parent_session_id", "spawned_by_step").alias("request_id"), F.lit(True).alias("matched"), F.concat(F.col("session_id"), F.lit(":0")).alias("child_root_request_id"))
    agents, members, pairs = release.load_reference(links, sessions.union(lost), spawns.union(spawns.withColumn("matched", F.lit(False)).withColumn("child_root_request_id", F.lit("x"))))
    n = members.groupBy(F.col("session_id").alias("root_request_id")).agg(F.count("*").alias("requests"))
    p = pairs.join(links.select("request_id", "session"), "request_id").groupBy(F.concat(F.expr("substring(session, 2)"), F.lit(":0")).alias("root_request_id")).agg(F.count("*").alias("spawned"))
    return agents.join(n, "root_request_id").join(p, "root_request_id", "left").fillna(0, ["spawned"])
