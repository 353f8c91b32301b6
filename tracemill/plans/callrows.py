"""Queries of the tool-call job: skeletons and whole call rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import shell, strings
from ..operators import calljob, privacy, toolcalls
from .bodies import prompts
from .jobs import _SIX, _commands, sixes
from .registry import query

RULES = toolcalls.Rules()


@query("X36_command_skeletons", _SIX + """ SELECT doc_id, i, CASE kind WHEN 0 THEN 'sudo -u <str> ' || b || ' 2>&1 | ' || c || ' <str> && ' || e || ' > <str> &' WHEN 1 THEN '<assign> nohup ' || b || ' <str> & ' || d
    WHEN 2 THEN 'cat <heredoc> ; ' || d || ' || ' || e ELSE 'git ' || a || ' ; python -m ' || b END AS skeleton FROM (SELECT *, w[6 * i + 6] AS f FROM x_s JOIN x_w USING (doc_id))""", fixture=False)  # fmt: skip
def _(s, d):
    return _commands(s, d).select("doc_id", "i", shell.programs(F.col("command"), skeleton=True)["skeleton"].alias("skeleton"))


def _kind():
    return (F.floor(F.col("turn") / 2) + F.col("conv_id")) % 5


def _word():
    return F.regexp_extract("text", "([a-z]{4,})", 1)


def _arguments():
    """A call's arguments by turn and conversation: a test run with redirects and the whole text as a note, a server in the background, broken JSON, the whole text as code."""
    tests = F.to_json(F.struct(F.concat(F.lit("pytest -k "), _word(), F.lit(" src/"), _word(), F.lit(".py 2>&1 | tail -20")).alias("command"), F.col("text").alias("note"), F.col("turn").alias("timeout")))
    server = F.to_json(F.struct(F.array(F.concat(F.lit("cd "), _word(), F.lit("/x")), F.lit("nohup node server.js &")).alias("commands")))
    code = F.to_json(F.struct(F.col("text").alias("code"), F.lit("Python").alias("language")))
    return F.when(_kind() == 0, tests).when(_kind() == 1, server).when(_kind() == 2, F.concat(F.lit('{"command": "'), "text")).otherwise(code)


def _written():
    """Every fifth call is written as text: it has no id, so no result is its own."""
    return F.when(_kind() == 4, F.concat(F.lit("\n<function=bash><parameter=command>pytest "), _word(), F.lit("</parameter></function>")))


_ROWS = r"""WITH x_c AS (SELECT conv_id, turn, role, text, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t, regexp_extract(text, '([a-z]{4,})', 1) AS w, (turn // 2 + conv_id) % 5 AS kind FROM conversations),
    x_r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM x_c WHERE role = 'assistant')
    SELECT r.conv_id, r.step, 0 AS call_index, 'shell' AS canonical_name, CASE kind WHEN 0 THEN 'pytest,tail' WHEN 1 THEN 'cd,node' WHEN 2 THEN '' WHEN 4 THEN 'pytest' ELSE 'python (code)' END AS programs, CASE kind WHEN 0 THEN ',|' WHEN 1 THEN ',' ELSE '' END AS joined_by,
      CASE kind WHEN 0 THEN 'pytest' WHEN 1 THEN 'node' WHEN 3 THEN 'python (code)' WHEN 4 THEN 'pytest' END AS deciding_program, CASE kind WHEN 2 THEN 'failed' ELSE 'success' END AS parse_status, CASE kind WHEN 0 THEN '*Build/Test' WHEN 4 THEN '*Build/Test' WHEN 1 THEN '*Wait/Poll' WHEN 2 THEN 'Other' ELSE '*Interpreter' END AS category,
      CASE kind WHEN 0 THEN '{"command": "pytest -k <str> <path> 2>&1 | tail -20", "note": "' || CASE WHEN regexp_full_match(r.text, '[0-9]+(\.[0-9]+)?') THEN '<num>' WHEN r.text IN ('.', '..', '~', './', '../') OR regexp_matches(r.text, '[/\\]|\.[A-Za-z0-9_]{1,8}$|[*?]') THEN '<path>' ELSE '<str>' END || '", "timeout": "<num>"}' WHEN 1 THEN '{"commands": "cd <path> ; nohup node <path> &"}' WHEN 2 THEN '<unparsed>' WHEN 4 THEN '{"command": "pytest <str>"}' ELSE '{"code": "<code>", "language": "<str>"}' END AS arguments_skeleton,
      len(list_filter(string_split_regex(a.t, '[ \n\t]+'), lambda x: x <> '')) AS result_tokens, CASE WHEN a.turn IS NOT NULL THEN CASE WHEN regexp_matches(string_split(a.t, chr(10))[1], '^\s*(error|ERROR|Error)\b[:\s]') THEN 'error' ELSE 'ok' END END AS outcome
    FROM x_r r LEFT JOIN (SELECT * EXCLUDE (w, kind, role) FROM x_c WHERE role = 'user' AND turn % 4 = 2) a ON a.conv_id = r.conv_id AND a.turn = r.turn + 1 AND r.next IS NOT NULL AND r.kind <> 4"""


@query("C12_tool_calls", _ROWS, fixture=False)
def _(s, d):
    p = prompts(s, d, _arguments(), _written())
    ids = F.split("request_id", "-")
    r = p.withColumn("conv_id", F.substring(ids[0], 2, 20).cast("long")).withColumn("turn", F.get(ids, 1).cast("int"))
    step = F.row_number().over(calljob.in_order("conv_id", "turn")) - 1
    r = r.select(F.col("conv_id").alias("session_id"), step.alias("step"), "prompt", "response")
    c = calljob.tool_calls(r, RULES, lambda t: F.size(strings.words(t)).cast("long"))
    joined = lambda x: F.array_join(x, ",").alias(x)
    return c.select(F.col("session_id").alias("conv_id"), "step", "call_index", "canonical_name", joined("programs"), joined("joined_by"), "deciding_program", "parse_status", "category", "arguments_skeleton", "result_tokens", "outcome")


# ---- what ships of a call

_KNOWN = sorted({w for words in RULES.purposes.values() for w in words})
STAND_INS = ["<search>", "<script>.sh"]
_PUBLIC = _SIX + f""", x_a AS (SELECT source AS account, unnest(list_filter(string_split_regex(lower(text), '[ \n\t]+'), lambda w: w <> '')) AS word FROM documents),
    x_p AS (SELECT word FROM x_a WHERE account IS NOT NULL AND length(word) % 2 = 0 GROUP BY word HAVING count(DISTINCT account) >= 3), x_t AS (SELECT *, a IN (FROM x_p) AS pa, b IN (FROM x_p) AS pb, c IN (FROM x_p) AS pc, d IN (FROM x_p) AS pd, e IN (FROM x_p) AS pe FROM x_s WHERE NOT list_has_any([a, b, c, d, e], {_KNOWN}))"""


def _words(s, d):
    return sixes(s, d).withColumn("kind", F.col("i") % 4).filter(~F.arrays_overlap(F.array(*"abcde"), F.array(*map(F.lit, _KNOWN))))


def _public(s, d):
    """Words of even length that three sources or more use."""
    return privacy.public_words(fx.words(s, d)).filter("length(word) % 2 = 0").select("word")


@query("X33_released_labels", _PUBLIC + """ SELECT doc_id, i, CASE kind WHEN 0 THEN CASE WHEN pa THEN a || ' <word>' ELSE '<program>' END WHEN 1 THEN '<search>' WHEN 2 THEN '<script>.sh' ELSE CASE WHEN pa THEN a ELSE '<program>' END END AS released FROM x_t""", fixture=False)
def _(s, d):
    k = F.col("kind")
    label = F.when(k == 0, F.concat_ws(" ", "a", "b")).when(k == 1, F.concat(F.lit("grep "), "a")).when(k == 2, F.concat("a", F.lit(".sh"))).otherwise(F.col("a"))
    return privacy.released_labels(_words(s, d).select("doc_id", "i", label.alias("label")), _public(s, d), STAND_INS, RULES).select("doc_id", "i", F.col("released_label").alias("released"))


@query("X33_released_skeletons", _PUBLIC + """ SELECT doc_id, i, '{"' || CASE WHEN i % 2 = 0 THEN 'command' WHEN pa THEN a ELSE '<key>' END || '": "' || CASE WHEN pb THEN b ELSE '<program>' END || ' --<flag>=<value> <path> && <search> -<flag> ' || CASE WHEN pe THEN e ELSE '<word>' END
    || '", "subagent_type": "' || CASE WHEN pd THEN d ELSE '<str>' END || '"}' AS released FROM x_t""", fixture=False)  # fmt: skip
def _(s, d):
    key = F.when(F.col("i") % 2 == 0, "command").otherwise(F.col("a"))
    text = F.concat(F.lit('{"'), key, F.lit('": "'), "b", F.lit(" --"), "c", F.lit("=<value> <path> && grep -"), "d", F.lit(" "), "e", F.lit('", "subagent_type": "<str>"}'))
    public = _public(s, d)
    keys = public.union(s.range(2).select(F.when(F.col("id") == 0, "command").otherwise("subagent_type").alias("word")))
    c = _words(s, d).select("doc_id", "i", text.alias("skeleton"), F.col("d").alias("subagent_type"))
    c = c.join(public.select(F.col("word").alias("subagent_type"), F.lit(True).alias("public_type")), "subagent_type", "left")
    return privacy.released_skeletons(c, keys, public, STAND_INS, RULES).select("doc_id", "i", F.col("released_skeleton").alias("released"))


@query("X19_allowed_skeletons", _PUBLIC + """ SELECT DISTINCT '{"' || a || '": "' || b || ' <path> | ' || c || ' -<flag>", "subagent_type": "' || d || '"}' AS skeleton, pa AND pb AND pc AND pd AS allowed FROM x_t""", fixture=False)
def _(s, d):
    text = F.concat(F.lit('{"'), "a", F.lit('": "'), "b", F.lit(" <path> | "), "c", F.lit(' -<flag>", "subagent_type": "'), "d", F.lit('"}'))
    public = _public(s, d)
    return privacy.allowed_skeletons(_words(s, d).select(text.alias("skeleton")), public.union(s.range(1).select(F.lit("subagent_type"))), public, STAND_INS, public)


@query("X19_allowed_labels", _PUBLIC + " SELECT doc_id, i, CASE kind WHEN 0 THEN pa WHEN 1 THEN false WHEN 2 THEN true ELSE pa END AS allowed FROM x_t", fixture=False)
def _(s, d):
    k = F.col("kind")
    value = F.when(k == 0, F.concat("a", F.lit(" <word>"))).when(k == 1, F.concat_ws(" ", "a", "b")).when(k == 2, F.when(F.col("i") % 8 == 2, "<program>").otherwise("<script>.sh")).otherwise(F.col("a"))
    return privacy.allowed_labels(_words(s, d).select("doc_id", "i", value.alias("value")), _public(s, d), STAND_INS).select("doc_id", "i", "allowed")


@query("U7_raw_ids", "SELECT DISTINCT id FROM (SELECT session_id || ':' || step AS id FROM fx_requests UNION ALL SELECT session_id FROM fx_requests UNION ALL SELECT user_id FROM fx_requests UNION ALL SELECT 'trace-' || session_id FROM fx_requests) WHERE id IS NOT NULL")
def _(s, d):
    r = fx.base_requests(s, d).select(F.concat_ws(":", "session_id", "step").alias("request_id"), "session_id", "user_id")
    return privacy.raw_ids(r, r.select("session_id", F.concat(F.lit("trace-"), "session_id").alias("trace_id"), "user_id"))
