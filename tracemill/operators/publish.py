"""The release as one job: a week's three tables from its private ones, a gate before them and a manifest after them.

A week's tables go to a new folder of the release. They are read back, and what the privacy gate finds in them stops the job. Then their files are
hashed, and the manifest that names the folder is written as the last thing, as a numbered commit. Readers go by manifests, so a
run that dies leaves nothing to be read, and a week released again is the old one until it is the new one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..sources import commits, tables
from . import privacy, release, turns
from .lineage import settled

# fixed values
LINK_REASONS = {"tool_id": "tool_call_id", "text": "assistant_message"}
ROLE_TOKENS = ("system", "user", "assistant", "tool", "tool_definitions")
COPIED = ("call_index", "category", "parse_status", "outcome", "result_tokens")
TABLES = ("sessions", "requests", "tool_calls")
BLOCK_TOKENS = 16


@dataclass(frozen=True)
class Keys:
    """What is not told: the salt, and the letter of each provider."""

    salt: str
    letters: dict[str, str] = field(default_factory=dict)


def session_id(raw: Column, keys: Keys) -> Column:
    return strings.pseudonym(raw, "session", keys.salt, 32)


def user_id(raw: Column, keys: Keys) -> Column:
    return strings.pseudonym(raw, "user", keys.salt, 16)


def kept_sessions(sessions: DataFrame, reasons: DataFrame) -> DataFrame:
    """Sessions without a reason to be left out."""
    return sessions.join(reasons.select("session_id"), "session_id", "left_anti")


def session_rows(sessions: DataFrame, requests: DataFrame, keys: Keys) -> DataFrame:
    """Released sessions. sessions: session_id, user_id, harness, spawned_by_session_id, spawned_by_request_id, spawned_by_call_index; a spawn
    names its step by the request of it."""
    steps = requests.select(F.col("request_id").alias("spawned_by_request_id"), F.col("step").alias("spawned_by_step"))
    j = sessions.join(steps, "spawned_by_request_id", "left")
    lost = F.col("spawned_by_request_id").isNotNull() & F.col("spawned_by_step").isNull()
    step = F.when(lost, F.raise_error(F.concat(F.lit("no request "), "spawned_by_request_id")).cast("int")).otherwise(F.col("spawned_by_step").cast("int"))
    return j.select(session_id(F.col("session_id"), keys).alias("session_id"), user_id(F.col("user_id"), keys).alias("user_id"), "harness", session_id(F.col("spawned_by_session_id"), keys).alias("parent_session_id"), step.alias("spawned_by_step"), F.col("spawned_by_call_index").cast("int").alias("spawned_by_call_index"))


def request_rows(requests: DataFrame, facts: DataFrame, calls: DataFrame, public: DataFrame, keys: Keys) -> DataFrame:
    """Released requests with their block hashes (block_hashes). requests: request_id, session_id, step, link, end_ms, latency_ms, ttft_ms, model_id, provider, stream,
    turn, prompt_tokens, completion_tokens, cache_read_tokens, stated_reason, transition, cause; facts: request_id, n_messages, role_tokens (map), tool_definition_names,
    unknown_role, block_hashes. A request without facts, or with an entry of another role, is an error."""
    r = requests.withColumnRenamed("turn", "step_trigger").withColumn("start_ms", F.col("end_ms") - F.coalesce("latency_ms", F.lit(0)))
    r = turns.with_waited_for(r, calls.select("session_id", "step", "category"))
    j = release.provider_letters(r, keys.letters).join(facts.withColumn("__f", F.lit(True)), "request_id", "left")
    fault = F.when(F.col("__f").isNull(), F.concat(F.lit("no digest of "), "request_id")).when(F.col("unknown_role").isNotNull(), F.concat_ws(" ", F.lit("a message of role"), "unknown_role", F.lit("in"), "request_id"))
    links = F.create_map(*(F.lit(x) for kv in LINK_REASONS.items() for x in kv))
    names = j.select("request_id", F.posexplode("tool_definition_names").alias("place", "name"))
    shown = privacy.released_name(names, "name", public).groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "released_name"))), lambda x: x["released_name"]).alias("released_names"))
    j = j.join(shown, "request_id", "left")
    return j.select(
        session_id(F.col("session_id"), keys).alias("session_id"), F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(F.col("step").cast("int")).alias("step"), F.when(F.col("step") > 0, links[F.col("link")]).alias("link_reason"),
        "start_ms", "end_ms", "ttft_ms", F.col("model_id").alias("model"), "provider", "stream", "step_trigger", "waited_for", "prompt_tokens", "completion_tokens", "cache_read_tokens",
        F.struct(*(F.col("role_tokens")[x].alias(x) for x in ROLE_TOKENS)).alias("role_tokens"), F.col("n_messages").cast("int").alias("n_messages"), F.coalesce("released_names", F.array().cast("array<string>")).alias("tool_definition_names"),
        strings.finish_reason(F.col("stated_reason")).alias("finish_reason"), "transition", "cause", "block_hashes",
    )


def with_block_ids(rows: DataFrame) -> DataFrame:
    """block_ids instead of block_hashes: numbers from 1 by the first read of each hash, requests being read in order."""
    reads = rows.select(F.lit("").alias("week"), "session_id", "step", F.posexplode("block_hashes").alias("pos", "block_id"))
    local = privacy.block_local_ids(reads)
    ids = reads.join(local, ["week", "block_id"]).groupBy("session_id", "step").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("local_id") + 1).alias("id")))), lambda x: x["id"]).alias("block_ids"))
    return rows.drop("block_hashes").join(ids, ["session_id", "step"], "left").withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<bigint>")))


def call_rows(calls: DataFrame, rows: DataFrame, kept: DataFrame, public: DataFrame, keys: Keys) -> DataFrame:
    """Released calls of kept sessions. calls: session_id, step, name and the copied columns, and programs and arguments_skeleton as they may ship (`privacy`);
    rows: released requests, whose next one tells how long a batch of calls took."""
    w = turns.in_session()
    latency = F.when(F.lead("waited_for").over(w).isin(*turns.TOOL_WAITED_FOR), F.lead("start_ms").over(w) - F.col("end_ms"))
    waits = rows.select("session_id", "step", latency.alias("latency_ms"))
    own = privacy.released_name(calls.join(kept.select("session_id"), "session_id", "left_semi"), "name", public)
    own = own.select(session_id(F.col("session_id"), keys).alias("session_id"), F.col("step").cast("int").alias("step"), F.col("released_name").alias("name"), "programs", "arguments_skeleton", *COPIED)
    return own.join(waits, ["session_id", "step"], "left").select("session_id", "step", "call_index", "name", "category", "programs", "parse_status", "arguments_skeleton", "outcome", "result_tokens", "latency_ms")


class PrivacyError(ValueError):
    """The gate found values that must not ship; how many, and the columns they are in."""


def publish(spark: SparkSession, folder: str, week: str, parts: dict[str, DataFrame], raw_ids: DataFrame, allowed: dict[str, Column], facts: dict, keys: Keys) -> dict:
    """Writes, checks and commits a week's tables (sessions, requests, tool_calls), and returns its manifest."""
    name = f"week={week}/{uuid.uuid4().hex}"
    at = f"{folder}/{name}"
    order = {"sessions": ["session_id"], "requests": ["session_id", "step"], "tool_calls": ["session_id", "step", "call_index"]}
    for table in TABLES:
        by = order[table]
        ordered = parts[table].repartitionByRange(*by).sortWithinPartitions(*by)
        ordered.write.option("compression", "zstd").option("parquet.block.row.count.limit", tables.GROUP_ROWS).option("maxRecordsPerFile", 1_000_000).parquet(f"{at}/{table}")
    written = {table: spark.read.schema(parts[table].schema).parquet(f"{at}/{table}") for table in TABLES}
    # distinct values are few beside rows; written, so that the gate's patterns are tried on them alone
    found = [privacy.gate(settled(privacy.string_values(written[t], t), "values"), raw_ids, allowed).groupBy("table", "column", "violation").agg(F.count("*").alias("n")) for t in TABLES]
    bad = found[0].union(found[1]).union(found[2]).collect()  # a row a column and kind at most
    if bad:
        raise PrivacyError(f"{week} is not released: " + "; ".join(f"{r.n} values of {r.table}.{r.column} ({r.violation})" for r in bad))
    files = {t: [r.asDict() for r in tables.written_files(spark, f"{at}/{t}").orderBy("path").collect()] for t in TABLES}
    blocks = written["requests"].agg(F.coalesce(F.max(F.array_max("block_ids")), F.lit(0)).alias("n")).first().n
    series = spark.range(1).select(release.salt_series(F.lit(keys.salt)).alias("s")).first().s
    manifest = {"format_version": release.FORMAT_VERSION, "week": week, "block_tokens": BLOCK_TOKENS, "salt_series": series, "distinct_block_ids": blocks, **facts, "folder": name, "files": files}
    while not commits.create(spark, f"{folder}/_manifests", max(commits.numbers(spark, f"{folder}/_manifests"), default=0) + 1, json.dumps(manifest, sort_keys=True)):
        pass
    return manifest


def manifests(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The present manifest of each released week: that of its last commit."""
    out = {}
    for _, text in sorted(commits.read_all(spark, f"{folder}/_manifests").items()):
        m = json.loads(text)
        if m["format_version"] != release.FORMAT_VERSION:
            raise ValueError(f"{m['week']} is of format {m['format_version']}")
        out[m["week"]] = m
    return out


def read(spark: SparkSession, folder: str, table: str, weeks: list[str] | None = None) -> DataFrame:
    """A table of released weeks, with their week. A week that is asked for and not released is an error."""
    known = manifests(spark, folder)
    lost = sorted(set(weeks or ()) - set(known))
    if lost or not known:
        raise ValueError(f"not released: {', '.join(lost) or 'any week'}")
    parts = [spark.read.parquet(f"{folder}/{m['folder']}/{table}").select(F.lit(week).alias("week"), "*") for week, m in sorted(known.items()) if weeks is None or week in weeks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Files of released weeks that are not as their manifests say: week, table, path."""
    known = manifests(spark, folder)
    rows = [(week, t, f["path"], f["bytes"], f["sha256"]) for week, m in known.items() for t in TABLES for f in m["files"][t]]
    told = spark.createDataFrame(rows, "week string, table string, path string, bytes long, sha256 string")
    found = told.limit(0)
    for week, m in known.items():
        for t in TABLES:
            found = found.union(tables.file_digests(spark, f"{folder}/{m['folder']}/{t}").select(F.lit(week), F.lit(t), "path", "bytes", "sha256"))
    odd = told.join(found, told.columns, "left_anti").union(found.join(told, told.columns, "left_anti"))
    return odd.select("week", "table", "path").distinct()
