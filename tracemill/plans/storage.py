"""Queries of readers, sinks, manifests and checks over written tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import arguments
from ..operators import privacy, release, reuse, tools
from ..operators.lineage import new_path, settled
from ..sources import tables
from .more import _OUT, _outcomes
from .registry import _CURVES, _curves, query, sessions, table


@query("K2_written_tables", "SELECT harness, count(*) AS rows, true AS sound FROM fx_requests WHERE harness IS NOT NULL GROUP BY harness")
def _(s, d):
    """Requests written by harness; each file's bytes and hash are there."""
    path = new_path(s, "written")
    tables.write_table(fx.base_requests(s, d).filter("harness is not null").select("session_id", "step", "harness").repartition(2, "session_id"), path, "harness")
    w = tables.written_files(s, path)
    sound = F.min((F.col("bytes") > 0) & (F.length("sha256") == 64))
    return w.groupBy(F.url_decode(F.regexp_extract("path", "harness=([^/]*)/", 1)).alias("harness")).agg(F.sum("rows").alias("rows"), sound.alias("sound"))


@query("S3_checked_columns", "SELECT session_id, step, tokens_system AS role_tokens_system, tokens_user AS role_tokens_user FROM fx_requests")
def _(s, d):
    r = fx.base_requests(s, d)
    roles = F.struct(F.col("tokens_system").alias("system"), F.col("tokens_user").alias("user")).alias("role_tokens")
    return tables.checked(r.select("session_id", "step", roles), ["session_id", "step", "role_tokens"])


@query("S9_column_of_ids", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", fixture=False)
def _(s, d):
    found = tables.column_of(table(s, d, "documents"), table(s, d, "labels").filter("quality = 1"), "doc_id", "text")
    return found.select("doc_id", F.md5("text").alias("digest"))


@query("S5_unreadable_weeks", "SELECT strftime(w, '%Y-%m-%d') AS week, CASE WHEN dayofyear(w) % 3 = 0 THEN 'format' ELSE 'built_from_other_logs' END AS reason FROM (SELECT DISTINCT date_trunc('day', ts)::DATE AS w FROM events) WHERE dayofyear(w) % 3 < 2", fixture=False)
def _(s, d):
    """Manifests by day: some of another format, some made from other logs."""
    days = table(s, d, "events").select(F.to_date("ts").alias("w")).distinct()
    k = F.dayofyear("w") % 3
    m = days.select(F.date_format("w", "yyyy-MM-dd").alias("week"), F.when(k == 0, 2).otherwise(release.FORMAT_VERSION).alias("format_version"), F.when(k == 1, "old").otherwise(F.md5(F.col("w").cast("string"))).alias("built_from"))
    return tables.check_manifest(m, release.FORMAT_VERSION, days.select(F.date_format("w", "yyyy-MM-dd").alias("week"), F.md5(F.col("w").cast("string")).alias("sha256")))


@query("J18_missing_keys", "SELECT DISTINCT session_id, step FROM fx_requests WHERE step % 3 = 1")
def _(s, d):
    r = fx.base_requests(s, d)
    return tables.missing_keys(r, r.filter("step % 3 <> 1"), ["session_id", "step"])


@query("K3_release_manifest", """SELECT 1 AS format_version, 'words' AS tokenizer, (SELECT count(DISTINCT session_id) FROM fx_requests) AS sessions, (SELECT count(*) FROM fx_requests) AS requests, (SELECT count(*) FROM fx_tool_calls) AS tool_calls,
    (SELECT count(DISTINCT block) FROM fx_blocks) AS blocks, (SELECT string_agg(harness || '=' || n, ',' ORDER BY harness) FROM (SELECT harness, count(DISTINCT session_id) AS n FROM fx_requests WHERE harness <> 'codex' GROUP BY harness)) AS excluded""")  # fmt: skip
def _(s, d):
    x = sessions(s, d)
    left_out = x.filter("harness <> 'codex'").select("session_id", F.col("harness").alias("reason"))
    m = release.manifest(x, fx.base_requests(s, d), fx.tool_calls(s, d), fx.block_reads(s, d), left_out, "words")
    pairs = F.transform(F.map_entries("excluded"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return m.withColumn("excluded", F.nullif(F.array_join(pairs, ","), F.lit("")))


@query("K8_all_week_counters", f"""x_o AS (SELECT {_OUT} AS outcome FROM fx_e) SELECT count(*) AS lines, count(*) FILTER (WHERE outcome = 'unparsable') AS unparsable, count(*) FILTER (WHERE outcome = 'kept') AS kept,
    (SELECT string_agg(outcome || '=' || n, ',' ORDER BY outcome) FROM (SELECT outcome, count(*) AS n FROM x_o WHERE outcome NOT IN ('kept', 'unparsable') GROUP BY outcome)) AS dropped, (SELECT count(*) FROM fx_requests WHERE step > 0) AS linked, (SELECT count(DISTINCT session_id) FROM fx_requests) AS sessions,
    (SELECT count(*) FROM fx_tool_calls WHERE category = 'Subagent') AS spawn_calls, (SELECT count(*) FROM fx_tool_calls WHERE category = 'Subagent' AND step % 2 = 0) AS spawn_calls_matched FROM x_o""")  # fmt: skip
def _(s, d):
    r = fx.base_requests(s, d)
    links = r.select(F.when(F.col("step") > 0, F.concat_ws(":", "session_id", F.col("step") - 1)).alias("parent_request_id"))
    spawns = fx.tool_calls(s, d).filter("category = 'Subagent'").select(F.when(F.col("step") % 2 == 0, F.col("session_id")).alias("child"))
    c = release.week_counters(_outcomes(s, d).select("outcome"), links, r.select("session_id"), spawns)
    return c.withColumn("dropped", F.nullif(F.array_join(F.transform(F.map_entries("dropped"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), F.lit("")))


@query("K10_public_word_list", "SELECT DISTINCT list, word FROM (SELECT 'words' AS list, word FROM (SELECT source, unnest(list_filter(string_split_regex(lower(text), '[ \\n\\t]+'), lambda w: w <> '')) AS word FROM documents) WHERE source IS NOT NULL GROUP BY word HAVING count(DISTINCT source) >= 3 UNION ALL SELECT 'tools', lang FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'words', lang FROM documents WHERE lang IS NOT NULL)", fixture=False)
def _(s, d):
    counted = privacy.public_words(fx.words(s, d)).select(F.lit("words").alias("list"), "word")
    named = table(s, d, "documents").filter("lang is not null").select(F.explode(F.array(F.lit("tools"), F.lit("words"))).alias("list"), F.col("lang").alias("word"))
    return tables.public_words_table(counted, named)


@query("C16_relabelled_sessions", """x_s AS (SELECT session_id, min(harness) AS harness FROM fx_requests GROUP BY 1), x_n AS (SELECT *, CASE length(session_id) % 3 WHEN 0 THEN 'hermes' WHEN 1 THEN 'other-agent' ELSE 'eval:swe-bench' END AS asked FROM x_s)
    SELECT session_id, CASE WHEN harness = 'hermes' AND asked = 'other-agent' THEN asked ELSE harness END AS harness, CASE WHEN harness = 'hermes' AND asked = 'eval:swe-bench' THEN asked END AS refused FROM x_n""")  # fmt: skip
def _(s, d):
    x = sessions(s, d).select("session_id", "harness")
    k = F.length("session_id") % 3
    current = x.select("session_id", F.when(k == 0, "hermes").when(k == 1, "other-agent").otherwise("eval:swe-bench").alias("harness"))
    moved, refused = release.relabel(x, "hermes", current)
    return moved.join(refused.select("session_id", F.col("asked").alias("refused")), "session_id", "left")


@query("A48_prefill_against_storage", _CURVES + " SELECT scope, policy, ttl, normalised_prefill - 1 AS prefill_above_floor, mean_retained_tokens / max(mean_retained_tokens) FILTER (WHERE ttl = '5m') OVER (PARTITION BY scope, policy) AS retained_over_first FROM x_cv WHERE ttl IN ('5m', '15m', '1h')")
def _(s, d):
    return reuse.prefill_against_storage(_curves(s, d), ["5m", "15m", "1h"])


@query("F13_medians_with_support", "SELECT category, median(result_tokens)::DOUBLE AS median, count(result_tokens) AS n FROM fx_tool_calls GROUP BY category HAVING count(result_tokens) >= 30")
def _(s, d):
    return tools.medians_with_support(fx.tool_calls(s, d), "result_tokens")


@query("X12_skeleton_words", "SELECT doc_id, n, string_agg(w, ' ' ORDER BY k) AS words FROM (SELECT doc_id, len(w)::INT AS n, unnest(w) AS w, unnest(range(len(w))) AS k FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS w FROM documents)) GROUP BY ALL", fixture=False)
def _(s, d):
    """A skeleton of all words of a text as flags with values and as words, between placeholders and operators."""
    from ..functions import strings

    w = F.filter(strings.words(F.col("text")), lambda x: x.rlike("^[a-z]+$"))
    parts = table(s, d, "documents").select("doc_id", w.alias("w")).filter(F.size("w") > 0)
    skeleton = F.array_join(F.transform("w", lambda x, i: F.when(i % 3 == 0, F.concat(x, F.lit("=<value> &&"))).when(i % 3 == 1, F.concat(F.lit("<path> "), x)).otherwise(F.concat(x, F.lit(" | <str>")))), " ")
    return parts.select("doc_id", arguments.skeleton_words(skeleton).alias("words")).select("doc_id", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))
