"""Queries of the release as one job: all requests as one week, released, read back, and compared row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx

from ..operators import lineage, privacy, publish, release
from ..operators.lineage import settled
from .more import _CH, _FAM, _family, inputs
from .registry import query

KEYS = publish.Keys("k", dict(zip("ABCD", "WXYZ", strict=True)))
_REASONS = {"click": "end_turn", "view": "function_call", "error": "crash", "purchase": "max_tokens"}


def _private(s, d):
    """The week's private tables: requests, facts of their inputs, sessions, and calls."""
    base = settled(fx.base_requests(s, d), "base")
    r = base.withColumn("request_id", F.concat_ws(":", "session_id", "step"))
    k, stated = F.col("k"), F.create_map(*(F.lit(x) for kv in _REASONS.items() for x in kv))
    requests = r.select(
        "request_id", "session_id", "user_id", "step", F.when(F.col("step_trigger") == "tool", "tool_id").otherwise("text").alias("link"), "end_ms", F.when(k % 11 != 0, F.col("end_ms") - F.col("start_ms")).alias("latency_ms"), "ttft_ms", F.col("model").alias("model_id"), "provider",
        (k % 2 == 0).alias("stream"), F.col("step_trigger").alias("turn"), "prompt_tokens", "completion_tokens", "cache_read_tokens", stated[F.col("event_type")].alias("stated_reason"), "transition", "cause",
    )
    reads = fx.block_reads(s, d, base).groupBy("session_id", "step").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "block_id"))), lambda x: x["block_id"]).alias("block_hashes"))
    tokens = F.create_map(*(x for name in publish.ROLE_TOKENS for x in (F.lit(name), F.col(f"tokens_{name}").cast("long"))))
    names = F.when(k % 3 == 0, F.array(F.lit("Read"), F.lit("Hidden"), F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    facts = r.select("request_id", "session_id", "step", "n_messages", tokens.alias("role_tokens"), names.alias("tool_definition_names"), F.lit(None).cast("string").alias("unknown_role")).join(reads, ["session_id", "step"]).drop("session_id", "step")
    spawned = F.col("parent_session_id").isNotNull()
    sessions = _family(s, d, base).select("session_id", "user_id", "harness", "parent_session_id", F.col("parent_session_id").alias("spawned_by_session_id"), F.when(spawned, F.concat_ws(":", "parent_session_id", "spawned_by_step")).alias("spawned_by_request_id"), F.when(spawned, 0).alias("spawned_by_call_index"))
    calls = fx.tool_calls(s, d, base).withColumn("name", F.when(F.col("call_index") % 2 == 0, "Read").otherwise("Hidden")).withColumn("arguments_skeleton", F.lit('{"a": "<num>"}'))
    return requests, facts, settled(sessions, "sessions"), calls


def _released(s, d):
    """The folder of a release of all requests, in which a second run died before its commit."""
    requests, facts, sessions, calls = _private(s, d)
    folder = lineage.new_path(s, "release")
    reasons = settled(privacy.exclusion_reasons(sessions, {"hermes": "harness"}, s.createDataFrame([], "session_id string, reason string")), "reasons")
    kept = settled(publish.kept_sessions(sessions, reasons), "kept")
    own = settled(requests.join(kept.select("session_id"), "session_id", "left_semi"), "own")
    public = s.createDataFrame([("read",)], "word string")
    rows = settled(publish.with_block_ids(settled(publish.request_rows(own, facts, calls, public, KEYS), "rows")), "released")
    # waits are told by private ids, so they are found before ids are hidden
    waited = own.join(rows.select("session_id", "step", "waited_for", "start_ms").withColumnRenamed("session_id", "hidden"), (publish.session_id(own.session_id, KEYS) == F.col("hidden")) & (own.step == rows.step)).select(F.col("hidden").alias("session_id"), own.step, "waited_for", "start_ms", "end_ms")
    parts = {"sessions": publish.session_rows(kept, requests, KEYS), "requests": rows, "tool_calls": publish.call_rows(calls, waited, kept, public, KEYS)}
    excluded = {r.reason: r.n for r in reasons.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    allowed = {"harness": F.col("value").rlike("^[a-z]+$") | (F.col("value") == "eval:swe-bench"), "name": F.col("value").isin("read", "other")}
    publish.publish(s, folder, "all", parts, privacy.raw_ids(requests, sessions.withColumn("trace_id", F.col("session_id"))), allowed, {"tokenizer": "words", "excluded_sessions": excluded}, KEYS)
    rows.limit(3).write.parquet(f"{folder}/week=all/dead/requests")
    return folder


_KEPT = _FAM + """, x_1 AS (SELECT *, CASE WHEN harness = 'hermes' THEN 'harness' END AS own FROM x_fam), x_kept AS (SELECT a.*, substr(sha256('k' || 'session:' || a.session_id), 1, 32) AS sid FROM x_1 a LEFT JOIN x_1 b ON b.session_id = a.parent_session_id LEFT JOIN x_1 c ON c.session_id = b.parent_session_id WHERE coalesce(a.own, b.own, c.own) IS NULL),
    x_q AS (SELECT r.*, x.sid, CASE WHEN k % 11 = 0 THEN end_ms ELSE r.start_ms END AS st FROM fx_waited r JOIN x_kept x USING (session_id)),
    x_b AS (SELECT x.sid, b.step, b.pos, b.block FROM fx_blocks b JOIN x_kept x USING (session_id)), x_l AS (SELECT block, row_number() OVER (ORDER BY f) AS id FROM (SELECT block, min(struct_pack(a := sid, b := step, c := pos)) AS f FROM x_b GROUP BY block)),
    x_i AS (SELECT sid, step, string_agg(id, ',' ORDER BY pos) AS ids FROM x_b JOIN x_l USING (block) GROUP BY ALL)"""


@query("X40_request_rows", _KEPT + """ SELECT q.sid AS session_id, q.step, CASE WHEN q.step > 0 THEN CASE step_trigger WHEN 'tool' THEN 'tool_call_id' ELSE 'assistant_message' END END AS link_reason, st AS start_ms, end_ms, ttft_ms, model, CASE provider WHEN 'A' THEN 'W' WHEN 'B' THEN 'X' WHEN 'C' THEN 'Y' WHEN 'D' THEN 'Z' END AS provider,
    k % 2 = 0 AS stream, step_trigger, waited_for, prompt_tokens, completion_tokens, cache_read_tokens, concat_ws(',', tokens_system, tokens_user, tokens_assistant, tokens_tool, tokens_tool_definitions) AS role_tokens, n_messages, CASE WHEN k % 3 = 0 THEN 'read,other,-' ELSE '' END AS names,
    CASE event_type WHEN 'click' THEN 'stop' WHEN 'view' THEN 'tool_calls' WHEN 'error' THEN 'other' WHEN 'purchase' THEN 'length' END AS finish_reason, transition, cause, md5(ids) AS blocks FROM x_q q JOIN x_i i ON i.sid = q.sid AND i.step = q.step""")  # fmt: skip
def _(s, d):
    r = publish.read(s, _released(s, d), "requests", ["all"])
    tokens = F.concat_ws(",", *(F.col(f"role_tokens.{name}").cast("string") for name in publish.ROLE_TOKENS))
    return r.withColumn("role_tokens", tokens).withColumn("names", F.array_join("tool_definition_names", ",", "-")).withColumn("blocks", F.md5(F.array_join("block_ids", ","))).drop("week", "tool_definition_names", "block_ids")


@query("C14_release", _KEPT + """, x_w AS (SELECT sid, step, CASE WHEN lead(waited_for) OVER w IN ('tool', 'ask_user_tool', 'subagent') THEN lead(st) OVER w - end_ms END AS latency FROM x_q WINDOW w AS (PARTITION BY sid ORDER BY step)),
    x_c AS (SELECT c.*, x.sid, latency FROM fx_tool_calls c JOIN x_kept x USING (session_id) JOIN x_w w ON w.sid = x.sid AND w.step = c.step)
    SELECT 'sessions' AS "table", sid AS key, concat_ws('|', substr(sha256('k' || 'user:' || user_id), 1, 16), harness, coalesce(substr(sha256('k' || 'session:' || parent_session_id), 1, 32), '-'), coalesce(spawned_by_step::VARCHAR, '-'), CASE WHEN parent_session_id IS NULL THEN '-' ELSE '0' END) AS detail FROM x_kept
    UNION ALL SELECT 'tool_calls', concat_ws(':', sid, step, call_index), concat_ws('|', CASE WHEN call_index % 2 = 0 THEN 'read' ELSE 'other' END, category, coalesce(array_to_string(programs, ','), '-'), coalesce(parse_status, '-'), '{"a": "<num>"}', coalesce(outcome, '-'), coalesce(result_tokens::VARCHAR, '-'), coalesce(latency::VARCHAR, '-')) FROM x_c
    UNION ALL SELECT 'manifest', 'sessions', count(*)::VARCHAR FROM x_kept UNION ALL SELECT 'manifest', 'requests', count(*)::VARCHAR FROM x_q UNION ALL SELECT 'manifest', 'tool_calls', count(*)::VARCHAR FROM x_c UNION ALL SELECT 'manifest', 'blocks', count(*)::VARCHAR FROM x_l
    UNION ALL SELECT 'manifest', 'excluded harness', ((SELECT count(*) FROM x_fam) - (SELECT count(*) FROM x_kept))::VARCHAR UNION ALL SELECT 'manifest', 'damaged files', '0' UNION ALL SELECT 'manifest', 'salt series', substr(sha256('k'), 1, 16)""")  # fmt: skip
def _(s, d):
    """Sessions, calls and the manifest; requests are X40."""
    folder = _released(s, d)
    m = publish.manifests(s, folder)["all"]
    or_dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    sessions = publish.read(s, folder, "sessions").select(F.lit("sessions").alias("table"), F.col("session_id").alias("key"), F.concat_ws("|", "user_id", "harness", or_dash("parent_session_id"), or_dash("spawned_by_step"), or_dash("spawned_by_call_index")).alias("detail"))
    c = publish.read(s, folder, "tool_calls").withColumn("programs", F.array_join("programs", ","))
    calls = c.select(F.lit("tool_calls"), F.concat_ws(":", "session_id", "step", "call_index"), F.concat_ws("|", "name", "category", *map(or_dash, ("programs", "parse_status", "arguments_skeleton", "outcome", "result_tokens", "latency_ms"))))
    told = [(t, str(sum(f["rows"] for f in m["files"][t]))) for t in publish.TABLES] + [("blocks", str(m["distinct_block_ids"])), *((f"excluded {k}", str(v)) for k, v in m["excluded_sessions"].items()), ("damaged files", str(publish.damaged(s, folder).count())), ("salt series", m["salt_series"])]
    return sessions.union(calls).union(s.createDataFrame([("manifest", *x) for x in told], "t string, k string, d string"))


_PARENT = "'c' || (CAST(regexp_extract({0}, 'c([0-9]+)-', 1) AS INT) - 1) || '-' || regexp_extract({0}, '-([0-9]+)', 1)"


@query("A36_week_sessions", _CH + f""", x_se AS (SELECT DISTINCT session_id, CAST(regexp_extract(session_id, 'c([0-9]+)-', 1) AS INT) % 5 IN (1, 2) AS child FROM x_o), x_by AS (SELECT c.session_id, p.session_id AS parent FROM x_se c JOIN x_se p ON c.child AND p.session_id = {_PARENT.format('c.session_id')}),
    x_n AS (SELECT o.session_id, count(*) AS n_requests, count(*) FILTER (WHERE o.turn = 'user') AS n_user_turns, count(*) FILTER (WHERE o.turn = 'tool') AS n_tool_turns, max(end_ms) AS end_ms FROM x_o o JOIN x_in i USING (request_id) WHERE on_main_chain GROUP BY 1)
    SELECT n.session_id, coalesce(b.parent, n.session_id) AS first_above, i.user_id, 'pi' AS harness, n_tool_turns >= 1 AND n_user_turns >= 2 AS is_agent_session, n_requests, n_user_turns, n_tool_turns, i.end_ms - 5 AS start_ms, n.end_ms, b.parent AS spawned_by_session_id, b.parent AS spawned_by_request_id, CASE WHEN b.parent IS NOT NULL THEN 1 END AS spawned_by_call_index
    FROM x_n n JOIN x_in i ON i.request_id = n.session_id LEFT JOIN x_by b USING (session_id)""", fixture=False)  # fmt: skip
def _(s, d):
    """Sessions of linked conversations, every fifth and its next spawned by the one before, if that is there."""
    i = settled(inputs(s, d), "inputs")
    chains = settled(lineage.chains(settled(lineage.links(i).join(i.select("request_id", "end_ms"), "request_id").withColumn("harness", F.lit("pi")).withColumn("new_content_kind", F.lit(None).cast("string")), "linked")), "chained")
    x = chains.select("session_id").distinct().withColumn("conv", F.regexp_extract("session_id", r"c(\d+)-", 1).cast("int"))
    above = F.when((x.conv % 5).isin(1, 2), F.concat(F.lit("c"), x.conv - 1, F.lit("-"), F.regexp_extract("session_id", r"-(\d+)", 1)))
    spawns = x.select(above.alias("session_id"), above.alias("request_id"), F.lit(1).alias("call_index"), F.col("session_id").alias("child_session_id")).filter("session_id is not null").join(x.select("session_id"), "session_id", "left_semi")
    inside = x.join(spawns.select(F.col("child_session_id").alias("session_id"), F.col("session_id").alias("parent")), "session_id", "left").select("session_id", F.coalesce("parent", "session_id").alias("trace_id"))
    signals = i.select("request_id", "user_id", F.lit("pi").alias("harness"), (F.col("end_ms") - 5).alias("start_ms"), "end_ms")
    return release.week_sessions(chains, signals, inside, spawns).withColumnRenamed("trace_id", "first_above")
