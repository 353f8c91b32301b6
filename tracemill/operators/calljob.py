"""The tool-call job: request bodies to a table of calls with names, families, programs, categories, skeletons and results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import arguments, shell, strings
from ..sources import bodies
from . import toolcalls
from .lineage import settled

KEY = ["session_id", "step"]


def in_order(session: str, at: str) -> WindowSpec:
    return Window.partitionBy(session).orderBy(at)


def facts(calls: DataFrame, rules: toolcalls.Rules) -> DataFrame:
    """calls (raw_name, arguments) with canonical_name, family, category, arguments_skeleton, subagent_type, and for shell calls programs,
    joined_by, deciding_program and parse_status; a shell call without a command has no programs and status failed,
    and so has one whose arguments repeat a key."""
    c = calls.withColumn("canonical_name", toolcalls.canonical_name(F.col("raw_name"), rules))
    c = c.withColumn("family", toolcalls.family(F.col("raw_name"), F.col("canonical_name"), rules)).withColumn("__v", F.try_parse_json("arguments"))
    c = c.withColumn("__s", F.when(F.col("family") == "shell", arguments.command_source(F.col("__v")))).withColumn("__p", shell.programs(F.col("__s.command"), skeleton=True))
    code, is_shell, ran = F.col("__s.label").isNotNull(), F.col("family") == "shell", F.size("__p.programs") > 0
    none = F.array().cast("array<string>")
    c = c.withColumn("programs", F.when(code, F.array("__s.label")).otherwise(F.when(is_shell, F.coalesce("__p.programs", none))))
    c = c.withColumn("joined_by", F.when(code, F.array(F.lit(""))).otherwise(F.when(is_shell, F.coalesce("__p.joined_by", none))))
    status = F.when(code, "success").when(is_shell, F.when(F.coalesce(ran, F.lit(False)), F.col("__p.parse_status")).otherwise("failed"))
    typed = arguments.skeleton(F.col("arguments"), F.col("__s.field"), F.when(code, "<code>").otherwise(F.col("__p.skeleton")))
    category = toolcalls.category(F.col("family"), F.coalesce("programs", none), F.coalesce("joined_by", none), F.coalesce("__p.background", F.lit(False)), rules, F.col("__p.wrappers"))
    kind = F.try_variant_get("__v", "$.subagent_type", "variant")
    return c.select(
        *calls.columns, "canonical_name", "family", "programs", "joined_by", F.when(is_shell, toolcalls.deciding_program(F.col("programs"), F.col("joined_by"), rules)).alias("deciding_program"),
        status.alias("parse_status"), category.alias("category"), typed.alias("arguments_skeleton"), F.when(F.schema_of_variant(kind) == "STRING", F.try_variant_get("__v", "$.subagent_type", "string")).alias("subagent_type"),
    )


def named_by_results(requests: DataFrame, calls: DataFrame, reply: str) -> DataFrame:
    """Calls that replies without a call wrote as text, as the next request's text results name them, each with its result's text.
    requests: session_id, step, prompt and the reply's text."""
    silent = requests.join(calls.select(*KEY).distinct(), KEY, "left_anti").filter(F.col(reply) != "")
    ident = F.to_json(F.struct(*KEY))
    replies = silent.select(*KEY, ident.alias("request_id"), F.col(reply).alias("reply"))
    results = bodies.text_results(requests.select("session_id", (F.col("step") - 1).alias("step"), "prompt").withColumn("request_id", ident))
    k = F.coalesce("name", F.lit("")).alias("k")
    found = bodies.calls_named_by_results(replies, results.select("request_id", "name", "occurrence")).select("request_id", k, "raw_name", "occurrence", "arguments")
    texts = results.select("request_id", k, "occurrence", "place", "text", *KEY)
    return found.join(texts, ["request_id", "k", "occurrence"]).select(*KEY, F.col("place").alias("call_index"), "raw_name", F.lit(None).cast("string").alias("raw_id"), "arguments", "text")


def tool_calls(requests: DataFrame, rules: toolcalls.Rules, tokens: Callable[[Column], Column], reply: str | None = None) -> DataFrame:
    """A row a call of requests (session_id, step, prompt, response): its facts, and tokens and outcome of its result in the session's next
    request, null without one. With reply, calls written as text in that column are added.

    Every join is on session and step, so bodies are shuffled once a side and no session gathers in one task."""
    calls = toolcalls.calls_of_responses(requests.select(*KEY, "response")).drop("response")
    # read three times below, so bodies are parsed once
    results = settled(bodies.fresh_results(requests.select(*KEY, "prompt")).drop("prompt"), "results")
    chosen = toolcalls.match_results(calls.select(*KEY, "call_index", "raw_id"), results)
    brought = results.select("session_id", (F.col("step") - 1).alias("step"), "result_index", "text", "is_error")
    answers = chosen.join(brought, [*KEY, "result_index"]).select(*KEY, "call_index", "text", "is_error")
    rows = facts(calls, rules).join(answers, [*KEY, "call_index"], "left")
    if reply:
        rows = rows.unionByName(facts(named_by_results(requests, calls, reply), rules).withColumn("is_error", F.lit(None).cast("boolean")))
    answered = F.col("text").isNotNull()
    return rows.withColumn("result_tokens", F.when(answered, tokens(F.col("text")))).withColumn("outcome", F.when(answered, strings.outcome(F.col("text"), F.col("is_error")))).drop("text", "is_error", "raw_id")
