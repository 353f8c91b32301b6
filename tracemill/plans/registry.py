"""Query key -> callable and the SQL that gives the same rows in DuckDB. Keys start with inventory ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixtures as fx
from ..functions import strings
from ..operators import gaps, latency, lineage, mutations, privacy, reuse, tokens, tools, turns, whatif
from ..operators.lineage import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FX = "WITH " + fx.DUCK.strip()


def query(key: str, sql: str | None = None, fixture: bool = True):
    def put(f):
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = (FX + (", " if sql.lstrip().upper().startswith("X_") or sql.lstrip().startswith("x_") else " ") + sql) if fixture else sql
        return f

    return put


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def sessions(s: SparkSession, d: str) -> DataFrame:
    return fx.base_requests(s, d).groupBy("session_id").agg(F.min("harness").alias("harness"), F.min("user_id").alias("user_id")).withColumn("parent_session_id", F.lit(None).cast("string"))


def agentic(s: SparkSession, d: str) -> DataFrame:
    return fx.requests(s, d).filter(turns.scope_of(F.col("harness")) == "Agentic")


def calls(s: SparkSession, d: str) -> DataFrame:
    return tools.calls_frame(fx.tool_calls(s, d), fx.requests(s, d))


# ---- population, turns, gaps


@query("F1_population", "SELECT session_id, step, scope, harness, user_id, n_tool_calls FROM fx_waited WHERE scope = 'Agentic'")
def _(s, d):
    r = fx.base_requests(s, d)
    return turns.sessions_in_scope(sessions(s, d), r, fx.tool_calls(s, d))[1].select("session_id", "step", "scope", "harness", "user_id", "n_tool_calls")


@query("J2_calls_in_scope", "SELECT c.session_id, c.step, call_index FROM fx_tool_calls c JOIN fx_waited r USING (session_id, step) WHERE scope = 'SWE-Bench'")
def _(s, d):
    return turns.sessions_in_scope(sessions(s, d), fx.base_requests(s, d), fx.tool_calls(s, d), "SWE-Bench")[2].select("session_id", "step", "call_index")


@query("A11_totals", """SELECT round((max(end_ms) - min(start_ms)) / 86400000 / 30.44, 1) AS months, count(*) AS requests, sum(n_tool_calls)::BIGINT AS tool_calls, sum(prompt_tokens)::BIGINT AS input_tokens,
    sum(completion_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cached_tokens, count(DISTINCT session_id) AS sessions, count(DISTINCT CASE WHEN harness <> 'eval:swe-bench' THEN harness END) AS harnesses FROM fx_requests""")  # fmt: skip
def _(s, d):
    return turns.totals(sessions(s, d), fx.base_requests(s, d))


@query("A12_by_harness", "SELECT harness, count(DISTINCT session_id) AS sessions, sum(prompt_tokens)::BIGINT AS input_tokens FROM fx_requests GROUP BY harness")
def _(s, d):
    return turns.by_harness(sessions(s, d), fx.base_requests(s, d))


@query("W1_turn_numbers", "SELECT session_id, step, turn::BIGINT AS turn FROM fx_waited")
def _(s, d):
    return fx.requests(s, d).select("session_id", "step", turns.turn_number().alias("turn"))


@query("W2_waits", "SELECT session_id, step, wait_s FROM fx_waited")
def _(s, d):
    return fx.requests(s, d).select("session_id", "step", turns.wait_s().alias("wait_s"))


@query("W3_tool_waits", "SELECT DISTINCT session_id, step, tool_wait_s FROM fx_calls")
def _(s, d):
    return calls(s, d).select("session_id", "step", "tool_wait_s").distinct()


@query("W4_tool_latencies", "SELECT session_id, step, lead(start_ms) OVER (PARTITION BY session_id ORDER BY step) - end_ms AS latency_ms FROM fx_requests")
def _(s, d):
    return fx.base_requests(s, d).select("session_id", "step", (F.lead("start_ms").over(turns.in_session()) - F.col("end_ms")).alias("latency_ms"))


@query("W6_user_prompt_rise", """SELECT session_id, step, rise FROM (SELECT session_id, step, step_trigger, CASE WHEN step > 0 THEN tokens_user - lag(tokens_user) OVER (PARTITION BY session_id ORDER BY step) ELSE tokens_user END::BIGINT AS rise FROM fx_requests) WHERE step_trigger = 'user' AND rise > 0""")
def _(s, d):
    return tokens.user_prompt_rise(fx.base_requests(s, d))


@query("W13_waited_for", "SELECT session_id, step, waited_for FROM fx_waited")
def _(s, d):
    return fx.requests(s, d).select("session_id", "step", "waited_for")


@query("A1_counts_per_session", "SELECT session_id, count(*) AS requests, count(*) FILTER (WHERE step_trigger = 'user') AS user_steps, count(*) FILTER (WHERE step_trigger = 'tool') AS tool_steps FROM fx_requests GROUP BY session_id")
def _(s, d):
    return turns.counts_per_session(fx.base_requests(s, d))


@query("A2_turn_durations", "SELECT session_id, turn::BIGINT AS turn, (max(end_ms) - min(start_ms)) / 1000 AS duration_s FROM fx_waited GROUP BY ALL")
def _(s, d):
    return turns.turn_durations(fx.requests(s, d))


@query("A3_session_durations", "SELECT session_id, (max(end_ms) - min(start_ms)) / 1000 AS duration_s FROM fx_requests GROUP BY ALL")
def _(s, d):
    return turns.session_durations(fx.base_requests(s, d))


@query("A45_duration_quantiles", "x_d AS (SELECT session_id, (max(end_ms) - min(start_ms)) / 1000 AS v FROM fx_requests GROUP BY ALL) SELECT quantile_cont(v, 0.5) AS median_s, quantile_cont(v, 0.9) AS p90_s FROM x_d")
def _(s, d):
    return turns.session_durations(fx.base_requests(s, d)).agg(F.percentile("duration_s", F.lit(0.5)).alias("median_s"), F.percentile("duration_s", F.lit(0.9)).alias("p90_s"))


@query("A54_medians_of_counts", "x_c AS (SELECT count(*) AS r, count(*) FILTER (WHERE step_trigger = 'user') AS u, count(*) FILTER (WHERE step_trigger = 'tool') AS t FROM fx_requests GROUP BY session_id) SELECT quantile_cont(r, 0.5) AS requests, quantile_cont(u, 0.5) AS user_steps, quantile_cont(t, 0.5) AS tool_steps FROM x_c")
def _(s, d):
    return turns.counts_per_session(fx.base_requests(s, d)).agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in ("requests", "user_steps", "tool_steps")))


_BIN = "CASE WHEN wait_s >= 3600 THEN '>1h' WHEN wait_s >= 1800 THEN '30m–1h' WHEN wait_s >= 900 THEN '15–30m' WHEN wait_s >= 300 THEN '5–15m' WHEN wait_s >= 60 THEN '1–5m' ELSE '<1m' END"
_CAUSE = "CASE waited_for WHEN 'tool' THEN 'Tool Gap' WHEN 'ask_user_tool' THEN 'Ask-User Tool' WHEN 'user' THEN 'User Idle' WHEN 'subagent' THEN 'Subagent' END"


@query("F6_gap_rows", f"SELECT session_id, step, wait_s AS gap_s, {_CAUSE} AS cause, hit_ratio, {_BIN} AS gap_bin FROM fx_waited WHERE wait_s >= 0 AND waited_for IS NOT NULL")
def _(s, d):
    return gaps.gap_rows(fx.requests(s, d))


@query("C18_gaps_by_cause_and_bin", f"SELECT {_CAUSE} AS cause, {_BIN} AS gap_bin, count(*) AS rows, quantile_cont(hit_ratio, 0.5) AS median_hit_ratio, quantile_cont(wait_s, 0.5) AS median_gap_s, avg(hit_ratio) AS mean_hit_ratio FROM fx_waited WHERE wait_s >= 0 AND waited_for IS NOT NULL GROUP BY 1, 2")
def gaps_by_cause_and_bin(s, d):
    return gaps.gaps_by_cause_and_bin(fx.requests(s, d))


@query("A22_mean_hit_ratio_by_cause", f"SELECT {_CAUSE} AS cause, avg(hit_ratio) AS mean_hit_ratio FROM fx_waited WHERE wait_s >= 0 AND waited_for IS NOT NULL AND hit_ratio IS NOT NULL GROUP BY 1")
def _(s, d):
    return gaps.gap_rows(fx.requests(s, d)).filter("hit_ratio is not null").groupBy("cause").agg(F.avg("hit_ratio").alias("mean_hit_ratio"))


_IDLE = """x_i AS (SELECT session_id, step, provider, (start_ms - max(end_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1000 AS idle_gap_s, hit_ratio, lag(cache_read_tokens) OVER w AS b
    FROM fx_waited WHERE provider IS NOT NULL WINDOW w AS (PARTITION BY provider, user_id ORDER BY start_ms, session_id, step)), x_r AS (SELECT session_id, step, provider, idle_gap_s, hit_ratio FROM x_i WHERE idle_gap_s IS NOT NULL AND hit_ratio IS NOT NULL AND b IS NOT NULL)"""


@query("W5_idle_gap_rows", _IDLE + " SELECT * FROM x_r")
def _(s, d):
    return gaps.idle_gap_rows(fx.base_requests(s, d))


_EDGES = [float(x) for x in np.geomspace(*gaps.IDLE_RANGE_S, gaps.IDLE_EDGES)]


@query("A23_retention_points", "WITH RECURSIVE " + fx.DUCK.strip() + ", " + _IDLE + f""", x_gap AS (SELECT greatest(idle_gap_s, {_EDGES[0]}) AS gap, hit_ratio FROM x_r WHERE idle_gap_s <= {_EDGES[-1]}), x_b AS (SELECT *, greatest(len(list_filter({_EDGES}::DOUBLE[], lambda e: e < gap)) - 1, 0) AS bin FROM x_gap),
    x_nb AS MATERIALIZED (SELECT bin, n, row_number() OVER (ORDER BY bin) AS k FROM (SELECT bin, count(*) AS n FROM x_b GROUP BY bin)),
    x_m AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS bin, 0::BIGINT AS held, 0 AS grp, 0 AS next UNION ALL SELECT x_nb.k, x_nb.bin, CASE WHEN held + n >= {gaps.MIN_ROWS} THEN 0 ELSE held + n END, next, CASE WHEN held + n >= {gaps.MIN_ROWS} THEN next + 1 ELSE next END FROM x_m JOIN x_nb ON x_nb.k = x_m.k + 1),
    x_at AS (SELECT bin, least(grp, (SELECT max(next) FROM x_m) - 1) AS "group" FROM x_m WHERE bin IS NOT NULL AND (SELECT max(next) FROM x_m) > 0)
    SELECT "group", quantile_cont(gap, 0.5) AS gap_s, quantile_cont(hit_ratio, 0.5) AS hit_ratio, count(*) AS rows FROM x_b JOIN x_at USING (bin) GROUP BY x_at."group" """, fixture=False)  # fmt: skip
def _(s, d):
    return gaps.retention_points(gaps.idle_gap_rows(fx.base_requests(s, d)))


@query("O8_top_providers", _IDLE + " SELECT provider, count(*) AS gaps FROM x_r GROUP BY provider HAVING count(*) >= 30 ORDER BY gaps DESC, provider LIMIT 4")
def _(s, d):
    return gaps.top_providers(gaps.idle_gap_rows(fx.base_requests(s, d)), 30)


# ---- tokens, cost, latency

_COST = "x_c AS (SELECT session_id, cache_read_tokens * 1.0::DOUBLE AS cached, greatest(prompt_tokens - cache_read_tokens, 0) * 10.0::DOUBLE AS uncached, coalesce(completion_tokens, 0) * 50.0::DOUBLE AS output FROM fx_requests WHERE cache_read_tokens IS NOT NULL AND prompt_tokens > 0)"


@query("A4_cost_shares", _COST + ", x_s AS (SELECT session_id, sum(cached) AS c, sum(uncached) AS u, sum(output) AS o FROM x_c GROUP BY session_id) SELECT session_id, c / (c + u + o) AS cached, u / (c + u + o) AS uncached, o / (c + u + o) AS output FROM x_s WHERE c + u + o > 0")
def _(s, d):
    return tokens.cost_shares_per_session(fx.base_requests(s, d))


@query("A53_pooled_cost_shares", _COST + " SELECT sum(cached) / sum(cached + uncached + output) AS cached, sum(uncached) / sum(cached + uncached + output) AS uncached, sum(output) / sum(cached + uncached + output) AS output FROM x_c")
def _(s, d):
    return tokens.pooled_cost_shares(fx.base_requests(s, d))


@query("A5_role_shares", "SELECT session_id, step, (tokens_system + tokens_tool_definitions) / t AS system_and_tools, tokens_user / t AS user, tokens_assistant / t AS assistant, tokens_tool / t AS tool FROM (SELECT *, tokens_system + tokens_tool_definitions + tokens_user + tokens_assistant + tokens_tool AS t FROM fx_requests) WHERE t > 0")
def _(s, d):
    return tokens.role_shares(fx.base_requests(s, d), tokens.DEFINITIONS_AS_SYSTEM, ["session_id", "step"])


@query("A43_tokens_per_request", "SELECT quantile_cont(prompt_tokens, 0.5) AS input, quantile_cont(CASE WHEN cache_read_tokens IS NOT NULL THEN greatest(prompt_tokens - cache_read_tokens, 0) END, 0.5) AS uncached, quantile_cont(CASE WHEN completion_tokens > 1 THEN completion_tokens END, 0.5) AS output, avg(CASE WHEN cache_read_tokens IS NOT NULL THEN (cache_read_tokens > prompt_tokens)::INT END) AS negative_uncached FROM fx_requests")
def _(s, d):
    return tokens.tokens_per_request(fx.base_requests(s, d))


@query("W14_rank_bins", _COST + """, x_s AS (SELECT session_id, sum(cached) AS c, sum(uncached) AS u, sum(output) AS o FROM x_c GROUP BY session_id), x_h AS (SELECT session_id, c / (c + u + o) AS c, u / (c + u + o) AS u, o / (c + u + o) AS o FROM x_s WHERE c + u + o > 0),
    x_r AS (SELECT *, row_number() OVER (ORDER BY c, u, session_id) - 1 AS r, count(*) OVER () AS n FROM x_h), x_b AS (SELECT *, least(200, greatest(n // 10, 1)) AS b FROM x_r), x_m AS (SELECT (r * b // n)::INT AS bin, any_value(b) AS b, avg(c) AS c, avg(u) AS u, avg(o) AS o FROM x_b GROUP BY 1)
    SELECT bin, c / (c + u + o) AS cached, u / (c + u + o) AS uncached, o / (c + u + o) AS output, (bin + 0.5) * 100 / b AS percentile FROM x_m""")  # fmt: skip
def _(s, d):
    return tokens.rank_bins(settled(tokens.cost_shares_per_session(fx.base_requests(s, d)), "shares"), ["cached", "uncached", "session_id"], tokens.COSTS)


@query("M5_cdf", "SELECT prompt_tokens AS value, row_number() OVER (ORDER BY prompt_tokens) / count(*) OVER () AS share FROM fx_requests")
def _(s, d):
    return tokens.cdf(settled(fx.base_requests(s, d).select("prompt_tokens"), "values"), "prompt_tokens")


@query("M4_size_bins", """x_g AS (SELECT n_messages AS x, prompt_tokens, CASE WHEN cache_read_tokens IS NOT NULL THEN greatest(prompt_tokens - cache_read_tokens, 0) END AS uncached FROM fx_requests WHERE cache_read_tokens IS NOT NULL AND prompt_tokens > 0 AND n_messages >= 1),
    x_u AS (SELECT greatest(quantile_cont(x, 0.99), 1) AS u FROM x_g), x_e AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS k FROM (SELECT DISTINCT round_even(exp(ln(u) * unnest(range(22)) / 21), 0) AS e FROM x_u)),
    x_b AS (SELECT a.k AS bin, a.e AS low, b.e AS high FROM x_e a JOIN x_e b ON b.k = a.k + 1), x_l AS (SELECT x, 'prompt_tokens' AS series, prompt_tokens::DOUBLE AS v FROM x_g UNION ALL SELECT x, 'uncached', uncached::DOUBLE FROM x_g)
    SELECT series, (CASE WHEN bin = 0 THEN low - 0.001 ELSE low END + high) / 2 AS mid, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, count(*) AS n
    FROM x_l JOIN x_b ON x <= high AND (x > low OR (bin = 0 AND x >= low)) WHERE v IS NOT NULL GROUP BY series, bin, low, high HAVING count(*) >= 50""")  # fmt: skip
def _(s, d):
    r = settled(tokens.growth_rows(fx.base_requests(s, d)).withColumn("uncached", tokens.uncached()).select("n_messages", "prompt_tokens", "uncached"), "growth")
    return tokens.size_bins(r, "n_messages", ["prompt_tokens", "uncached"])


_LLM = """x_t AS (SELECT *, coalesce(ttft_ms > 0 AND ttft_ms < 0.95 * (end_ms - start_ms), false) AS ok FROM fx_waited WHERE scope = 'Agentic'),
    x_s AS (SELECT session_id, min(harness) AS harness, sum(CASE WHEN ok THEN ttft_ms / 1000 ELSE 0 END) AS p, sum(CASE WHEN ok THEN (end_ms - start_ms) / 1000 - ttft_ms / 1000 ELSE 0 END) AS d, sum(CASE WHEN ok THEN 0 ELSE (end_ms - start_ms) / 1000 END) AS u,
      sum(CASE WHEN waited_for IN ('tool', 'subagent') THEN coalesce(greatest(wait_s, 0), 0) ELSE 0 END) AS tool, sum(CASE WHEN waited_for IN ('tool', 'subagent') THEN coalesce(least(greatest(wait_s, 0), 900), 0) ELSE 0 END) AS capped,
      sum(CASE WHEN waited_for IN ('user', 'ask_user_tool') THEN coalesce(greatest(wait_s, 0), 0) ELSE 0 END) AS human FROM x_t GROUP BY session_id),
    x_q AS (SELECT *, coalesce(p / nullif(p + d, 0), sum(p) OVER h / nullif(sum(p + d) OVER h, 0), sum(p) OVER () / nullif(sum(p + d) OVER (), 0), 0) AS r FROM x_s WINDOW h AS (PARTITION BY harness)),
    x_b AS (SELECT session_id, p + u * r AS prefill, d + u * (1 - r) AS decode, tool, capped, human FROM x_q)"""


@query("A6_effective_llm_time", _LLM + " SELECT session_id, prefill, decode FROM x_b")
def _(s, d):
    return latency.effective_llm_time(agentic(s, d))


@query("A7_time_breakdown", _LLM + " SELECT session_id, prefill, decode, capped AS tool, human FROM x_b")
def _(s, d):
    return latency.time_breakdown(agentic(s, d), cap_tool_waits=True)


@query("A51_time_shares", _LLM + ", x_p AS (SELECT *, prefill + decode + tool + human AS t FROM x_b) SELECT avg(prefill / t) AS prefill, avg(decode / t) AS decode, avg(tool / t) AS tool, avg(human / t) AS human FROM x_p WHERE t > 0")
def _(s, d):
    return latency.time_shares(agentic(s, d)).agg(*(F.avg(p).alias(p) for p in latency.PARTS))


@query("A8_speedups", _LLM + ", x_m AS (SELECT sum(prefill) AS p, sum(decode) AS d, sum(capped) AS t FROM x_b) SELECT (p + d + t) / (p + d + t - 0.5 * p) AS prefill, (p + d + t) / (p + d + t - 0.5 * d) AS decode, (p + d + t) / (p + d + t - 0.5 * t) AS tool FROM x_m")
def _(s, d):
    return latency.speedups(latency.time_breakdown(agentic(s, d), cap_tool_waits=True))


@query("A9_ttft_decomposition", """x_r AS (SELECT *, ttft_ms / 1000 AS ttft_s, CASE WHEN cache_read_tokens IS NOT NULL THEN greatest(prompt_tokens - cache_read_tokens, 0) END AS unc FROM fx_requests WHERE ttft_ms > 0 AND ttft_ms < 0.95 * (end_ms - start_ms)),
    x_l AS (SELECT *, cache_read_tokens / prompt_tokens < 0.25 AND unc > 1000 AS lm FROM x_r), x_m AS (SELECT model, count(*) FILTER (WHERE lm) AS long_misses, quantile_cont(unc / ttft_s, 0.5) FILTER (WHERE lm) AS rate FROM x_l GROUP BY model HAVING count(*) FILTER (WHERE lm) >= 20)
    SELECT model, long_misses, rate, quantile_cont(ttft_s, 0.5) AS ttft, quantile_cont((end_ms - start_ms - ttft_ms) / 1000, 0.5) AS decode, quantile_cont(CASE WHEN unc IS NOT NULL THEN greatest(ttft_s - unc / rate, 0) END, 0.5) AS queueing FROM x_l JOIN x_m USING (model) GROUP BY ALL""")  # fmt: skip
def _(s, d):
    return latency.ttft_decomposition(fx.base_requests(s, d), 20, 1000)


@query("F4_trusted_ttft", "SELECT session_id, step, coalesce(ttft_ms > 0 AND ttft_ms < 0.95 * (end_ms - start_ms), false) AS trusted FROM fx_requests")
def _(s, d):
    return fx.base_requests(s, d).select("session_id", "step", latency.trusted_ttft().alias("trusted"))


@query("A42_scope_comparison", "x_s AS (SELECT scope, session_id, (max(end_ms) - min(start_ms)) / 1000 AS v FROM fx_waited GROUP BY ALL), x_m AS (SELECT max(CASE WHEN scope = 'Agentic' THEN m END) AS agentic, max(CASE WHEN scope = 'SWE-Bench' THEN m END) AS swe_bench FROM (SELECT scope, quantile_cont(v, 0.5) AS m FROM x_s GROUP BY scope)) SELECT *, greatest(agentic, swe_bench) / least(agentic, swe_bench) AS ratio FROM x_m")
def _(s, d):
    m = turns.session_durations(fx.base_requests(s, d)).join(sessions(s, d).select("session_id", turns.scope_of(F.col("harness")).alias("scope")), "session_id").groupBy("scope").agg(F.percentile("duration_s", F.lit(0.5)).alias("m"))
    w = m.agg(F.max(F.when(F.col("scope") == "Agentic", F.col("m"))).alias("agentic"), F.max(F.when(F.col("scope") == "SWE-Bench", F.col("m"))).alias("swe_bench"))
    return w.withColumn("ratio", F.greatest("agentic", "swe_bench") / F.least("agentic", "swe_bench"))


# ---- tools


@query("J4_calls_frame", "SELECT session_id, step, call_index, width, latency_s, tool_wait_s FROM fx_calls")
def _(s, d):
    return calls(s, d).select("session_id", "step", "call_index", "width", "latency_s", "tool_wait_s")


@query("A15_tool_overview", """x_k AS (SELECT *, CASE WHEN width <= 1 THEN 'single' WHEN (SELECT 1) = 1 AND min(category) OVER w <> max(category) OVER w THEN 'mixed' ELSE 'same' END AS kind FROM fx_calls WINDOW w AS (PARTITION BY session_id, step)),
    x_n AS (SELECT count(DISTINCT session_id) AS s FROM fx_requests), x_a AS (SELECT count(*) AS n, sum(result_tokens) AS t, sum(CASE WHEN width = 1 THEN tool_wait_s END) AS w FROM x_k)
    SELECT coalesce(category, 'All') AS category, 100.0 * count(*) / any_value(x_a.n) AS calls, 100.0 * count(DISTINCT session_id) / any_value(x_n.s) AS sessions, coalesce(100.0 * sum(result_tokens) / any_value(x_a.t), 0) AS tokens,
      coalesce(100.0 * sum(CASE WHEN width = 1 THEN tool_wait_s END) / any_value(x_a.w), 0) AS time, coalesce(100.0 * avg(CASE WHEN outcome IS NOT NULL THEN (outcome <> 'ok')::INT END), 0) AS fail,
      100.0 * avg((kind = 'same')::INT) AS same, 100.0 * avg((kind = 'mixed')::INT) AS mixed FROM x_k, x_n, x_a GROUP BY ROLLUP (category)""")  # fmt: skip
def _(s, d):
    return tools.overview(calls(s, d), sessions(s, d).count())


@query("A13_shell_share", "SELECT avg((parse_status IS NOT NULL)::INT) AS shell_share FROM fx_tool_calls")
def _(s, d):
    return tools.shell_share(fx.tool_calls(s, d))


@query("O5_category_order", "x_n AS (SELECT category, count(*) AS calls, CASE WHEN category = 'Other' THEN 2 WHEN category LIKE '*%' THEN 1 ELSE 0 END AS kind FROM fx_tool_calls GROUP BY category) SELECT category, calls, row_number() OVER (ORDER BY kind, calls DESC, category)::INT AS place FROM x_n")
def _(s, d):
    return tools.category_order(fx.tool_calls(s, d))


@query("O3_example_commands", "x_l AS (SELECT category, programs[1] AS label, count(*) AS calls FROM fx_tool_calls WHERE category LIKE '*%' AND len(programs) = 1 AND NOT contains(programs[1], '<') GROUP BY ALL), x_p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY calls DESC, label)::INT AS place FROM x_l) SELECT * FROM x_p WHERE place <= 8")
def _(s, d):
    return tools.example_commands(fx.tool_calls(s, d))


_Q = ", ".join(f"quantile_cont({{0}}, {q}) AS p{round(q * 100)}" for q in tools.QUANTILES)


@query("A17_wait_by_category", f"SELECT category, {_Q.format('tool_wait_s')}, avg(tool_wait_s) AS mean, count(*) AS n FROM fx_calls WHERE width = 1 AND tool_wait_s IS NOT NULL GROUP BY category")
def _(s, d):
    return tools.latency_by_category(calls(s, d))


@query("A16_result_tokens_by_category", f"SELECT category, {_Q.format('result_tokens')}, avg(result_tokens) AS mean, count(*) AS n FROM fx_calls WHERE result_tokens IS NOT NULL GROUP BY category")
def _(s, d):
    return tools.result_tokens_by_category(fx.tool_calls(s, d))


@query("A18_batching_profile", """x_b AS (SELECT session_id, step, count(DISTINCT category) AS k FROM fx_calls WHERE width > 1 GROUP BY ALL)
    SELECT 'sessions_batched' AS measure, 100.0 * count(DISTINCT session_id) FILTER (WHERE width > 1) / (SELECT count(DISTINCT session_id) FROM fx_requests) AS percent FROM fx_calls
    UNION ALL SELECT 'width_' || CASE WHEN width >= 4 THEN '4+' ELSE width::VARCHAR END, 100.0 * count(*) / (SELECT count(*) FROM fx_calls) FROM fx_calls GROUP BY 1
    UNION ALL SELECT 'same_tool', 100.0 * avg((k = 1)::INT) FROM x_b UNION ALL SELECT 'mixed', 100.0 * avg((k > 1)::INT) FROM x_b""")  # fmt: skip
def _(s, d):
    return tools.batching_profile(calls(s, d), sessions(s, d).count())


_B = ", ".join(f"quantile_cont(tool_wait_s, {q}) AS p{round(q * 100)}" for q in tools.BANDS)


@query("A19_latency_by_width", f"x_r AS (SELECT session_id, step, max((category = 'Ask User')::INT) AS asks, any_value(width) AS width, any_value(tool_wait_s) AS tool_wait_s, any_value(latency_s) AS latency_s FROM fx_calls GROUP BY ALL), x_f AS (SELECT *, least(width, 8) AS drawn FROM x_r WHERE asks = 0 AND tool_wait_s IS NOT NULL), x_o AS (SELECT quantile_cont(tool_wait_s, 0.5) + quantile_cont(latency_s, 0.5) AS each FROM x_f WHERE width = 1) SELECT drawn AS width, count(*) AS requests, drawn * any_value(each) AS serial_s, {_B} FROM x_f, x_o GROUP BY drawn")
def _(s, d):
    return tools.latency_by_width(calls(s, d))


@query("A20_width_by_category", "SELECT category, avg(width) AS mean_width FROM fx_calls WHERE call_index = 0 AND category <> 'Ask User' GROUP BY category")
def _(s, d):
    return tools.width_by_category(calls(s, d))


@query("W7_trajectory_bins", "SELECT session_id, step, least(floor(10 * (row_number() OVER (PARTITION BY session_id, turn ORDER BY step) - 0.5) / count(*) OVER (PARTITION BY session_id, turn)), 9)::INT AS bin FROM fx_waited WHERE n_tool_calls > 0")
def _(s, d):
    return tools.trajectory_bins(fx.requests(s, d))


@query("A21_trajectory_mix", """x_b AS (SELECT session_id, step, least(floor(10 * (row_number() OVER (PARTITION BY session_id, turn ORDER BY step) - 0.5) / count(*) OVER (PARTITION BY session_id, turn)), 9)::INT AS bin FROM fx_waited WHERE n_tool_calls > 0),
    x_g AS (SELECT bin, CASE WHEN category = '*File Ops' THEN CASE WHEN len(list_filter(programs, lambda p: p IN ('mkdir'))) > 0 THEN 'Write/Edit' WHEN len(list_filter(programs, lambda p: p IN ('ls', 'cat <path>'))) > 0 THEN 'Read' ELSE 'Other' END
      WHEN category = 'Read' THEN 'Read' WHEN category = '*Search' THEN 'Search' WHEN category IN ('Edit', 'Write') THEN 'Write/Edit' WHEN category = '*Interpreter' THEN 'Execute' WHEN category = '*Build/Test' THEN 'Build/Test' WHEN category = '*Git/VCS' THEN 'Git/VCS' WHEN category IN ('Browser', '*Network') THEN 'Browser/Web' ELSE 'Other' END AS g
      FROM fx_tool_calls JOIN x_b USING (session_id, step)), x_n AS (SELECT bin, g, count(*) AS n FROM x_g GROUP BY ALL),
    x_a AS (SELECT bin::INT AS bin, g FROM (SELECT unnest(range(10)) AS bin), (SELECT unnest(['Read', 'Search', 'Write/Edit', 'Execute', 'Build/Test', 'Git/VCS', 'Browser/Web', 'Other']) AS g))
    SELECT bin, g AS "group", coalesce(n / sum(n) OVER (PARTITION BY bin), 0)::DOUBLE AS share FROM x_a LEFT JOIN x_n USING (bin, g)""")  # fmt: skip
def _(s, d):
    return tools.trajectory_mix(fx.tool_calls(s, d), fx.requests(s, d))


# ---- transitions, reuse, what-if

_READS = """x_rd AS (SELECT *, CASE WHEN harness = 'eval:swe-bench' THEN 'SWE-Bench' ELSE 'Agentic' END AS scope, start_ms / 1000 AS arrival, end_ms / 1000 AS completion FROM fx_blocks),
    x_st AS (SELECT DISTINCT week, session_id, step, arrival, completion FROM x_rd), x_nx AS (SELECT week, session_id, step, coalesce(lead(arrival) OVER (PARTITION BY session_id ORDER BY step), 'inf'::DOUBLE) AS next_arrival, max(completion) OVER (PARTITION BY session_id) AS session_end FROM x_st),
    x_we AS (SELECT scope, week, max(completion) AS week_end FROM x_rd GROUP BY ALL),
    x_j AS (SELECT scope, week, session_id, step, block, completion, week_end, session_end, CASE WHEN EXISTS (SELECT 1 FROM fx_blocks n WHERE n.block = x_rd.block AND n.session_id = x_rd.session_id AND n.step = x_rd.step + 1) THEN 'inf'::DOUBLE ELSE next_arrival END AS mutate_signal,
      row_number() OVER o = 1 AS first, lead(arrival) OVER o - completion AS gap, lead(completion) OVER o - completion AS until_next FROM x_rd JOIN x_nx USING (week, session_id, step) JOIN x_we USING (scope, week) WINDOW o AS (PARTITION BY scope, week, block ORDER BY arrival, session_id, step, pos))"""
_TTL = "x_ttl AS (SELECT unnest([" + ", ".join(f"{{'ttl': '{t}', 'ttl_s': '{s}'::DOUBLE}}" for t, s in reuse.TTLS) + "], recursive := true)), x_pol AS (SELECT unnest(['ttl_only', 'reclaim_mutate', 'reclaim_dead', 'reclaim_both']) AS policy)"
_TALLY = f"""{_READS}, {_TTL}, x_g AS (SELECT *, CASE policy WHEN 'ttl_only' THEN 'inf'::DOUBLE WHEN 'reclaim_mutate' THEN mutate_signal WHEN 'reclaim_dead' THEN session_end ELSE least(mutate_signal, session_end) END - completion AS after FROM x_j, x_ttl, x_pol),
    x_h AS (SELECT *, coalesce(gap < 0 OR (gap <= ttl_s AND gap <= after), false) AS hit FROM x_g), x_v AS (SELECT *, greatest(CASE WHEN hit THEN until_next ELSE least(ttl_s, after, week_end - completion) END, 0) AS stays FROM x_h),
    x_tally AS (SELECT scope, week, policy, ttl, 16 * count(*) FILTER (WHERE hit) AS hit_tokens, 16 * count(*) FILTER (WHERE NOT hit) AS miss_tokens, 16 * coalesce(sum(stays) FILTER (WHERE gap IS NOT NULL), 0) AS reusable_token_seconds, 16 * coalesce(sum(stays) FILTER (WHERE gap IS NULL), 0) AS dead_token_seconds FROM x_v GROUP BY ALL)"""


@query("C6_reuse_tally", _TALLY + " SELECT * FROM x_tally")
def _(s, d):
    return reuse.tallies(reuse.judged_reads(fx.block_reads(s, d)))


@query("A27_request_misses", _READS + " SELECT scope, week, session_id, step, 16 * count(*) FILTER (WHERE first) AS missed_tokens, count(*) AS reads FROM x_j GROUP BY ALL")
def _(s, d):
    return reuse.request_misses(reuse.judged_reads(fx.block_reads(s, d)))


_TOTALS = "x_tot AS (SELECT scope, week, sum(16 * (4 + step) * (end_ms - start_ms) / 1000) AS active_token_seconds, (max(end_ms) - min(start_ms)) / 1000 AS span_seconds, sum(coalesce(completion_tokens, 0))::DOUBLE AS output_tokens, count(*) AS requests FROM fx_waited GROUP BY ALL)"


@query("A26_scope_totals", _TOTALS + " SELECT * FROM x_tot")
def _(s, d):
    return reuse.scope_totals(fx.block_reads(s, d), fx.base_requests(s, d))


@query("A24_tallies_over_weeks", _TALLY + " SELECT scope, policy, ttl, sum(hit_tokens)::BIGINT AS hit_tokens, sum(miss_tokens)::BIGINT AS miss_tokens, sum(reusable_token_seconds) AS reusable_token_seconds, sum(dead_token_seconds) AS dead_token_seconds FROM x_tally GROUP BY ALL")
def _(s, d):
    return reuse.over_weeks(reuse.tallies(reuse.judged_reads(fx.block_reads(s, d))), ["scope", "policy", "ttl"])


_CURVES = _TALLY + ", " + _TOTALS + """, x_ts AS (SELECT scope, policy, ttl, sum(hit_tokens) AS h, sum(miss_tokens) AS m, sum(reusable_token_seconds) AS r, sum(dead_token_seconds) AS e FROM x_tally GROUP BY ALL),
    x_to AS (SELECT scope, sum(active_token_seconds) AS a, sum(span_seconds) AS sp, sum(output_tokens) AS o FROM x_tot GROUP BY scope), x_fl AS (SELECT scope, m AS fl FROM x_ts WHERE policy = 'ttl_only' AND ttl = 'none'),
    x_c1 AS (SELECT scope, policy, ttl, (r + e) / sp AS mean_retained_tokens, m / fl AS normalised_prefill, r / a AS reusable_over_active, e / a AS dead_over_active, m * 10 / 1e6 AS ai, h / 1e6 AS ac, o * 50 / 1e6 AS ao, m / 1e6 AS rc, (r + e) / 86400 * 30 / 1e6 AS st FROM x_ts JOIN x_to USING (scope) JOIN x_fl USING (scope)),
    x_cv AS (SELECT *, max(ai + ac + ao) FILTER (WHERE ttl = '1m') OVER p AS am, max(rc + st) FILTER (WHERE ttl = '1m') OVER p AS im FROM x_c1 WINDOW p AS (PARTITION BY scope, policy))"""


def _curves(s, d):
    base = settled(fx.base_requests(s, d), "base")
    reads = settled(fx.block_reads(s, d, base).drop("block"), "reads")
    t = reuse.over_weeks(reuse.tallies(reuse.judged_reads(reads)), ["scope", "policy", "ttl"])
    tot = reuse.over_weeks(reuse.scope_totals(reads, base), ["scope"])
    return settled(reuse.cost_curves(settled(t, "tallies"), tot), "curves")


@query("A29_cost_curves", _CURVES + " SELECT scope, policy, ttl, mean_retained_tokens, normalised_prefill, reusable_over_active, dead_over_active, ai / am AS api_input, ac / am AS api_cache_read, ao / am AS api_output, rc / im AS recompute, st / im AS storage, (ai + ac + ao) / am AS api_total, (rc + st) / im AS infrastructure_total FROM x_cv")
def _(s, d):
    return _curves(s, d)


_ORDER = "CASE ttl " + " ".join(f"WHEN '{t}' THEN {i}" for i, (t, _) in enumerate(reuse.TTLS)) + " END"


@query("A31_knee", _CURVES + f", x_k AS (SELECT *, ai + ac + ao AS api, rc + st AS inf, {_ORDER} AS o, min(ai + ac + ao) OVER (PARTITION BY scope, policy) AS lo FROM x_cv) SELECT scope, policy, arg_min(ttl, o) FILTER (WHERE api / am <= lo / am * 1.05) AS knee, first(ttl ORDER BY inf, o) AS lowest_infrastructure FROM x_k GROUP BY ALL")
def _(s, d):
    return reuse.api_cost_knee(_curves(s, d))


@query("A32_retention_summary", _CURVES + ", x_o AS (SELECT * FROM x_cv WHERE policy = 'ttl_only') SELECT scope, " + ", ".join(f"max(normalised_prefill) FILTER (WHERE ttl = '{t}') - 1 AS \"prefill_above_floor_{t}\"" for t in ("5m", "15m", "1h")) + ", " + ", ".join(f"max(mean_retained_tokens) FILTER (WHERE ttl = '{t}') / max(mean_retained_tokens) FILTER (WHERE ttl = '15m') AS \"retained_{t}_over_15m\"" for t in ("1h", "1d")) + ", max(dead_over_active) FILTER (WHERE ttl = '1d') AS dead_over_active_1d, max(dead_over_active) FILTER (WHERE ttl = '1d') / (SELECT max(dead_over_active) FROM x_cv b WHERE b.scope = x_o.scope AND policy = 'reclaim_both' AND ttl = '1d') AS reclaim_both_dead_fall_1d FROM x_o GROUP BY scope")
def _(s, d):
    return reuse.retention_summary(_curves(s, d))


@query("A46_distinct_blocks", "SELECT week, count(DISTINCT block) AS blocks FROM fx_blocks GROUP BY week")
def _(s, d):
    return fx.block_reads(s, d).groupBy("week").agg(F.count_distinct("block_id").alias("blocks"))


_MISS = _READS + ", x_ms AS (SELECT session_id, step, 16 * count(*) FILTER (WHERE first) AS missed_tokens FROM x_j GROUP BY ALL), x_tr AS (SELECT r.*, missed_tokens FROM fx_waited r LEFT JOIN x_ms USING (session_id, step) WHERE transition IS NOT NULL AND transition <> 'switch')"


def _transitions(s, d):
    return settled(mutations.transition_rows(fx.base_requests(s, d), reuse.request_misses(reuse.judged_reads(fx.block_reads(s, d)))), "transitions")


@query("J5_transition_rows", _MISS + " SELECT session_id, step, transition, cause, hit_ratio, missed_tokens FROM x_tr")
def _(s, d):
    return _transitions(s, d)


@query("A10_mutation_table", _MISS + f""", x_rows AS (SELECT unnest({list(mutations.TABLE_ROWS)}) AS "row") SELECT "row", coalesce(avg((transition = "row" OR cause = "row")::INT), 0) AS steps_share,
    CASE WHEN "row" = 'append' THEN (SELECT count(DISTINCT session_id) FROM x_tr) - (SELECT count(DISTINCT session_id) FROM x_tr WHERE transition = 'mutation') ELSE count(DISTINCT CASE WHEN transition = "row" OR cause = "row" THEN session_id END) END / (SELECT count(DISTINCT session_id) FROM x_tr) AS sessions_share,
    coalesce(sum(CASE WHEN transition = "row" OR cause = "row" THEN missed_tokens END), 0) / (SELECT sum(missed_tokens) FROM x_tr) AS prefill_share FROM x_rows, (SELECT session_id, transition, coalesce(cause, '') AS cause, missed_tokens FROM x_tr) GROUP BY "row\"""")  # fmt: skip
def _(s, d):
    return mutations.mutation_table(_transitions(s, d))


@query("A47_hit_ratio_after", _MISS + " SELECT transition, quantile_cont(hit_ratio, 0.5) AS median_hit_ratio FROM x_tr GROUP BY transition")
def _(s, d):
    return mutations.hit_ratio_after(_transitions(s, d))


@query("A38_transition_counts", "SELECT coalesce(cause, transition) AS kind, count(*) AS n FROM fx_requests WHERE transition IS NOT NULL GROUP BY 1")
def _(s, d):
    return mutations.transition_counts(fx.base_requests(s, d).filter("transition is not null"))


_PREFIX = "x_pf AS (SELECT n.session_id, n.step, count(*)::INT AS blocks, coalesce(min(CASE WHEN b.block IS NULL OR b.block <> n.block THEN n.pos END), count(*))::INT AS shared_blocks FROM fx_blocks n LEFT JOIN fx_blocks b ON b.session_id = n.session_id AND b.step = n.step - 1 AND b.pos = n.pos GROUP BY ALL)"


@query("C7_shared_prefix", _PREFIX + " SELECT * FROM x_pf")
def _(s, d):
    return whatif.shared_prefixes(fx.block_reads(s, d))


_STEPS = _PREFIX + """, x_a AS (SELECT r.session_id, r.step, week, prompt_tokens, completion_tokens, transition, wait_s AS gap_s, prompt_tokens * (shared_blocks / blocks) AS cached_if_warm, lag(prompt_tokens) OVER (PARTITION BY r.session_id ORDER BY r.step) AS b FROM fx_waited r JOIN x_pf p ON p.session_id = r.session_id AND p.step = r.step WHERE scope = 'Agentic'),
    x_sf AS (SELECT session_id, step, week, prompt_tokens, completion_tokens, gap_s, cached_if_warm, coalesce(transition = 'mutation' AND prompt_tokens < b, false) AS is_reduction, CASE WHEN transition = 'mutation' AND prompt_tokens < b THEN prompt_tokens - cached_if_warm ELSE 0 END AS penalty,
      CASE WHEN transition = 'mutation' AND prompt_tokens < b THEN b - prompt_tokens ELSE 0 END::DOUBLE AS removed_tokens, greatest(max(prompt_tokens) OVER (PARTITION BY session_id), 900000) AS compaction_tokens FROM x_a)"""


def _steps(s, d):
    return whatif.step_facts(fx.base_requests(s, d).filter(turns.scope_of(F.col("harness")) == "Agentic"), whatif.shared_prefixes(fx.block_reads(s, d)))


@query("C8_step_facts", _STEPS + " SELECT * FROM x_sf")
def _(s, d):
    return _steps(s, d)


@query("O4_skip_ranks", _STEPS + " SELECT session_id, step, row_number() OVER (PARTITION BY week ORDER BY penalty, session_id, step)::INT AS rank, count(*) OVER (PARTITION BY week) AS reductions FROM x_sf WHERE is_reduction")
def _(s, d):
    return whatif.skip_ranks(_steps(s, d))


_SWEEP = "WITH RECURSIVE " + fx.DUCK.strip() + ", " + _STEPS + """, x_rk AS (SELECT session_id, step, row_number() OVER (PARTITION BY week ORDER BY penalty, session_id, step) AS rank, count(*) OVER (PARTITION BY week) AS reductions FROM x_sf WHERE is_reduction),
    x_grid AS (SELECT ttl, ttl_s, cut FROM (SELECT unnest([{'ttl': '5m', 'ttl_s': 300.0::DOUBLE}, {'ttl': '15m', 'ttl_s': 900.0::DOUBLE}, {'ttl': 'none', 'ttl_s': 'inf'::DOUBLE}], recursive := true)), (SELECT unnest(range(21)) AS cut)),
    x_q AS MATERIALIZED (SELECT f.*, ttl, cut, coalesce(gap_s <= ttl_s, false) AS warm, coalesce(rank <= floor(cut * reductions / 20 + 0.5), false) AS skipped FROM x_sf f LEFT JOIN x_rk USING (session_id, step), x_grid),
    x_walk AS (SELECT session_id, ttl, cut, -1 AS step, 0.0::DOUBLE AS p, 0.0::DOUBLE AS c, 0.0::DOUBLE AS tp, 0.0::DOUBLE AS tc, 0 AS f, 0.0::DOUBLE AS carry FROM x_q WHERE step = 0
      UNION ALL SELECT w.session_id, w.ttl, w.cut, q.step,
        CASE WHEN prompt_tokens + carry + CASE WHEN skipped THEN removed_tokens ELSE 0 END > compaction_tokens THEN prompt_tokens WHEN skipped AND warm THEN 0 WHEN warm THEN prompt_tokens - cached_if_warm ELSE prompt_tokens + carry + CASE WHEN skipped THEN removed_tokens ELSE 0 END END,
        CASE WHEN prompt_tokens + carry + CASE WHEN skipped THEN removed_tokens ELSE 0 END > compaction_tokens THEN 0 WHEN skipped AND warm THEN prompt_tokens + carry + removed_tokens WHEN warm THEN cached_if_warm + carry ELSE 0 END,
        CASE WHEN warm THEN prompt_tokens - cached_if_warm ELSE prompt_tokens END, CASE WHEN warm THEN cached_if_warm ELSE 0 END, (prompt_tokens + carry + CASE WHEN skipped THEN removed_tokens ELSE 0 END > compaction_tokens)::INT,
        CASE WHEN prompt_tokens + carry + CASE WHEN skipped THEN removed_tokens ELSE 0 END > compaction_tokens THEN 0 ELSE carry + CASE WHEN skipped THEN removed_tokens ELSE 0 END END
      FROM x_walk w JOIN x_q q ON q.session_id = w.session_id AND q.ttl = w.ttl AND q.cut = w.cut AND q.step = w.step + 1),
    x_sum AS (SELECT q.week, w.ttl, w.cut / 20 AS read_price_cut, sum(tp) AS today_prefilled_tokens, sum(tc) AS today_cached_tokens, sum(p) AS prefilled_tokens, sum(c) AS cached_tokens, sum(coalesce(completion_tokens, 0))::DOUBLE AS output_tokens, count(*) FILTER (WHERE is_reduction) AS reductions, count(*) FILTER (WHERE skipped) AS skipped_reductions, sum(f)::BIGINT AS forced_compactions
      FROM x_walk w JOIN x_q q USING (session_id, ttl, cut, step) GROUP BY ALL)"""


def _sweep(s, d):
    return settled(whatif.skip_sweep(settled(_steps(s, d), "steps")), "sweep")


@query("C10_skip_sweep", _SWEEP + " SELECT * FROM x_sum", fixture=False)
def _(s, d):
    return _sweep(s, d)


_MULT = _SWEEP + ", x_w AS (SELECT ttl, read_price_cut, sum(today_prefilled_tokens) AS tp, sum(today_cached_tokens) AS tc, sum(prefilled_tokens) AS p, sum(cached_tokens) AS c, sum(output_tokens) AS o FROM x_sum GROUP BY ALL), x_mu AS (SELECT ttl, read_price_cut, tp / p AS prefill_multiple, (tp * 10 + tc * (1 - read_price_cut) + o * 50) / (p * 10 + c * (1 - read_price_cut) + o * 50) AS cost_multiple FROM x_w)"


@query("A30_cheaper_reads", _MULT + " SELECT * FROM x_mu", fixture=False)
def _(s, d):
    return whatif.multiples(reuse.over_weeks(_sweep(s, d), ["ttl", "read_price_cut"]))


@query("A50_break_even", _MULT + ", x_lo AS (SELECT *, min(cost_multiple) OVER (PARTITION BY ttl ORDER BY read_price_cut DESC ROWS UNBOUNDED PRECEDING) AS low FROM x_mu) SELECT ttl, max(CASE WHEN low >= 1 THEN round(1 - read_price_cut, 2) END) AS break_even, arg_max(cost_multiple, read_price_cut) AS at_free_reads, min(cost_multiple) AS lowest FROM x_lo GROUP BY ttl", fixture=False)
def _(s, d):
    return whatif.break_even(whatif.multiples(reuse.over_weeks(_sweep(s, d), ["ttl", "read_price_cut"])))


from . import more  # noqa: E402, F401  the rest of the registry
from . import jobs  # noqa: E402, F401
from . import bodies  # noqa: E402, F401
from . import rendered  # noqa: E402, F401
from . import published  # noqa: E402, F401
from . import callrows  # noqa: E402, F401
from . import storage  # noqa: E402, F401
from . import streams  # noqa: E402, F401
from . import releases  # noqa: E402, F401
from . import ruled  # noqa: E402, F401
