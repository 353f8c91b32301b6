"""Trace tables derived from the driver's star-schema tables, and the same rows as DuckDB SQL.

Each function builds one view with DataFrame expressions; DUCK holds the definitions an oracle
starts from, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import turns
from .schemas import CATEGORIES, CAUSES

HARNESSES = ("hermes", "opencode", "pi", "codex", "eval:swe-bench")
PROGRAMS = ("ls", "git status", "mkdir", "python", "grep", "curl", "make", "cat <path>")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def base_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    day = F.to_date("ts")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("week", F.date_format(F.date_sub(F.next_day(day, "SUN"), 7), "yyyy-MM-dd"))
    e = e.withColumn("session_id", F.concat(F.lit("s"), "user_id", F.lit("-"), "week"))
    e = e.withColumn("start_ms", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"))
    e = e.withColumn("end_ms", F.col("start_ms") + 200 + F.floor(F.col("value") * 100))
    e = e.withColumn("step", (F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")) - 1).cast("int"))
    k, step, user = F.col("k"), F.col("step"), F.col("user_id")
    e = e.withColumn("prompt_tokens", (1000 + 400 * step + 37 * k).cast("long"))
    e = e.withColumn("transition", F.when(step == 0, None).when(k % 10 < 7, "append").when(k % 10 < 9, "mutation").otherwise("switch"))
    return e.select(
        "event_id", "session_id", "week", "step", "start_ms", "end_ms", "k", "event_type", "prompt_tokens", "transition",
        F.concat(F.lit("u"), user).alias("user_id"), _pick(HARNESSES, user % 5).alias("harness"), F.concat(F.lit("m"), user % 3).alias("model"),
        F.when(k == 99, None).otherwise(F.chr(65 + user % 4)).alias("provider"),
        F.when(k % 10 == 0, None).otherwise(F.expr("((end_ms - start_ms) * (k + 1)) div 100")).alias("ttft_ms"),
        F.when((step == 0) | F.col("event_type").isin("signup", "click"), "user").otherwise("tool").alias("step_trigger"),
        F.when(k % 13 == 0, None).otherwise(10 + k).cast("long").alias("completion_tokens"),
        F.when(k % 7 == 0, None).otherwise(F.expr("(prompt_tokens * k) div 90")).alias("cache_read_tokens"),
        (1 + 2 * step).alias("n_messages"),
        F.lit(500).cast("long").alias("tokens_system"), (50 * (step + 1) + k).cast("long").alias("tokens_user"), (20 * step).cast("long").alias("tokens_assistant"),
        (30 * step).cast("long").alias("tokens_tool"), F.lit(200).cast("long").alias("tokens_tool_definitions"),
        F.when(F.col("transition") == "mutation", _pick(CAUSES, k % 7)).alias("cause"),
        F.when(F.col("event_type") == "purchase", 1 + k % 5).when(F.col("event_type").isin("view", "error"), 1).otherwise(0).alias("n_tool_calls"),
    )


def tool_calls(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """base, here and below: base_requests, where they are written already."""
    r = (base or base_requests(spark, sf_dir)).filter("n_tool_calls > 0").select("session_id", "step", "k", F.explode(F.sequence(F.lit(0), F.col("n_tool_calls") - 1)).alias("call_index"))
    k, i = F.col("k"), F.col("call_index")
    r = r.withColumn("category", _pick(CATEGORIES, (k + 3 * i) % 16))
    r = r.withColumn("outcome", F.when((k + i) % 11 == 0, None).otherwise(F.when((k + i) % 9 == 0, "error").when((k + i) % 9 == 1, "denied").when((k + i) % 9 == 2, "timeout").otherwise("ok")))
    shell = F.col("category").startswith("*")
    one, two = _pick(PROGRAMS, (k + i) % 8), _pick(PROGRAMS, (k + i + 3) % 8)
    return r.select(
        "session_id", "step", "call_index", "category", "outcome", F.when(F.col("outcome").isNotNull(), 10 * (k + 1) + i).cast("long").alias("result_tokens"),
        F.when(shell, "success").alias("parse_status"), F.when(shell, F.when(k % 2 == 1, F.array(one, two)).otherwise(F.array(one))).alias("programs"),
    )


def requests(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """base_requests with what each waited for."""
    return turns.with_waited_for(base or base_requests(spark, sf_dir), tool_calls(spark, sf_dir, base))


def block_reads(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """One row per block a request reads: the first two blocks are shared by all sessions of a model, a mutation changes the rest."""
    r = base or base_requests(spark, sf_dir)
    so_far = F.sum(F.when(F.col("transition") == "mutation", 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("mutations", so_far).select("session_id", "week", "harness", "model", "step", "start_ms", "end_ms", "mutations", F.explode(F.sequence(F.lit(0), 3 + F.col("step"))).alias("pos"))
    block = F.when(F.col("pos") < 2, F.concat_ws(":", F.lit("sys"), "model", "pos")).otherwise(F.concat_ws(":", "session_id", "pos", "mutations"))
    return r.select("session_id", "week", "harness", "step", "start_ms", "end_ms", "pos", F.xxhash64(block).alias("block_id"), block.alias("block"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased words of documents; the source stands for the account."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.col("source").alias("account"), F.explode(F.filter(F.split(F.lower("text"), r"[ \n\t]+"), lambda w: w != "")).alias("word"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: fx_requests, fx_tool_calls, fx_waited (requests with waited_for), fx_blocks.
DUCK = f"""
fx_e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, strftime(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER), '%Y-%m-%d') AS week, epoch_us(ts) // 1000 AS start_ms FROM events),
fx_f AS (SELECT *, 's' || user_id || '-' || week AS session_id, start_ms + 200 + CAST(floor(value * 100) AS BIGINT) AS end_ms FROM fx_e),
fx_g AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step FROM fx_f),
fx_h AS (SELECT *, CAST(1000 + 400 * step + 37 * k AS BIGINT) AS prompt_tokens, CASE WHEN step = 0 THEN NULL WHEN k % 10 < 7 THEN 'append' WHEN k % 10 < 9 THEN 'mutation' ELSE 'switch' END AS transition FROM fx_g),
fx_requests AS (SELECT event_id, session_id, week, step, start_ms, end_ms, k, event_type, prompt_tokens, transition, 'u' || user_id AS user_id,
  {_list(HARNESSES)}[CAST(user_id % 5 + 1 AS INTEGER)] AS harness, 'm' || user_id % 3 AS model, CASE WHEN k = 99 THEN NULL ELSE chr(CAST(65 + user_id % 4 AS INTEGER)) END AS provider,
  CASE WHEN k % 10 = 0 THEN NULL ELSE ((end_ms - start_ms) * (k + 1)) // 100 END AS ttft_ms,
  CASE WHEN step = 0 OR event_type IN ('signup', 'click') THEN 'user' ELSE 'tool' END AS step_trigger,
  CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(10 + k AS BIGINT) END AS completion_tokens,
  CASE WHEN k % 7 = 0 THEN NULL ELSE (prompt_tokens * k) // 90 END AS cache_read_tokens, 1 + 2 * step AS n_messages,
  500 AS tokens_system, 50 * (step + 1) + k AS tokens_user, 20 * step AS tokens_assistant, 30 * step AS tokens_tool, 200 AS tokens_tool_definitions,
  CASE WHEN transition = 'mutation' THEN {_list(CAUSES)}[k % 7 + 1] END AS cause,
  CASE event_type WHEN 'purchase' THEN 1 + k % 5 WHEN 'view' THEN 1 WHEN 'error' THEN 1 ELSE 0 END AS n_tool_calls FROM fx_h),
fx_c AS (SELECT session_id, step, k, CAST(unnest(range(n_tool_calls)) AS INTEGER) AS i FROM fx_requests WHERE n_tool_calls > 0),
fx_d AS (SELECT *, {_list(CATEGORIES)}[CAST((k + 3 * i) % 16 + 1 AS INTEGER)] AS category, CASE WHEN (k + i) % 11 = 0 THEN NULL WHEN (k + i) % 9 = 0 THEN 'error' WHEN (k + i) % 9 = 1 THEN 'denied' WHEN (k + i) % 9 = 2 THEN 'timeout' ELSE 'ok' END AS outcome,
  {_list(PROGRAMS)}[CAST((k + i) % 8 + 1 AS INTEGER)] AS p1, {_list(PROGRAMS)}[CAST((k + i + 3) % 8 + 1 AS INTEGER)] AS p2 FROM fx_c),
fx_tool_calls AS (SELECT session_id, step, i AS call_index, category, outcome, CASE WHEN outcome IS NOT NULL THEN 10 * (k + 1) + i END AS result_tokens,
  CASE WHEN category LIKE '*%' THEN 'success' END AS parse_status, CASE WHEN category LIKE '*%' THEN CASE WHEN k % 2 = 1 THEN [p1, p2] ELSE [p1] END END AS programs FROM fx_d),
fx_cats AS (SELECT session_id, step, bool_or(category = 'Subagent') AS sub, bool_or(category = 'Ask User') AS ask FROM fx_tool_calls GROUP BY ALL),
fx_waited AS (SELECT r.*, CASE WHEN r.step = 0 THEN NULL WHEN step_trigger = 'user' THEN 'user' WHEN c.sub THEN 'subagent' WHEN c.ask THEN 'ask_user_tool' ELSE 'tool' END AS waited_for,
  (start_ms - lag(end_ms) OVER (PARTITION BY r.session_id ORDER BY r.step)) / 1000 AS wait_s,
  CASE WHEN cache_read_tokens IS NOT NULL AND prompt_tokens > 0 THEN least(cache_read_tokens / prompt_tokens, 1.0) END AS hit_ratio,
  CASE WHEN harness = 'eval:swe-bench' THEN 'SWE-Bench' ELSE 'Agentic' END AS scope,
  sum(CASE WHEN step_trigger = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY r.session_id ORDER BY r.step ROWS UNBOUNDED PRECEDING) AS turn
  FROM fx_requests r LEFT JOIN fx_cats c ON c.session_id = r.session_id AND c.step = r.step - 1),
fx_calls AS (SELECT c.*, n_tool_calls AS width, (end_ms - start_ms) / 1000 AS latency_s, CASE WHEN next_for IN ('tool', 'ask_user_tool', 'subagent') THEN next_wait END AS tool_wait_s
  FROM fx_tool_calls c JOIN (SELECT *, lead(wait_s) OVER w AS next_wait, lead(waited_for) OVER w AS next_for FROM fx_waited WINDOW w AS (PARTITION BY session_id ORDER BY step)) USING (session_id, step)),
fx_mut AS (SELECT *, sum(CASE WHEN transition = 'mutation' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS m FROM fx_requests),
fx_pos AS (SELECT *, unnest(range(4 + step)) AS pos FROM fx_mut),
fx_blocks AS (SELECT session_id, week, harness, step, start_ms, end_ms, pos, CASE WHEN pos < 2 THEN 'sys:' || model || ':' || pos ELSE session_id || ':' || pos || ':' || m END AS block FROM fx_pos)
"""
