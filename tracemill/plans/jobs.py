"""Queries of the tool-call job, release tables and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import shell, strings
from ..operators import release, toolcalls, tools, turns
from ..operators.lineage import settled
from .more import _FAM, _family
from .registry import query, table

RULES = toolcalls.Rules()


_TAKEN = [*shell.SOURCE_WORDS, *shell.OPENING, *shell.CLOSING, *shell.WRAPPERS, *shell.SUBCOMMANDS, *shell.SPELLINGS, "python", "git"]
_SIX = f"""WITH x_w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n\t]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND NOT list_contains({_TAKEN}, w)) AS w FROM documents),
    x_s AS (SELECT doc_id, i, i % 4 AS kind, w[6 * i + 1] AS a, w[6 * i + 2] AS b, w[6 * i + 3] AS c, w[6 * i + 4] AS d, w[6 * i + 5] AS e FROM (SELECT doc_id, w, unnest(range(len(w) // 6)) AS i FROM x_w))"""


def sixes(s, d):
    """Words a to f, six by six, of all documents: those of four letters or more that are no shell words."""
    w = F.filter(strings.words(F.col("text")), lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(*_TAKEN))
    # each six is cut out before rows are made of them, so no row carries its document's words
    six = lambda w, i: F.struct(i.alias("i"), *(F.get(w, 6 * i + k).alias(n) for k, n in enumerate("abcdef")))
    at = lambda w: F.when(F.size(w) >= 6, F.sequence(F.lit(0), F.floor(F.size(w) / 6).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    c = table(s, d, "documents").select("doc_id", F.explode(strings.let(w, lambda w: F.transform(at(w), lambda i: six(w, i)))).alias("x"))
    return c.select("doc_id", "x.*")


def _commands(s, d):
    """Commands of six words each of all documents: wrapped with redirects and a group, in the background, with a here-document, and with unbalanced quotes."""
    c = sixes(s, d)
    made = ("sudo -u %s %s 2>&1 | %s '%s; x' && (%s) > %s &", "%s=1 nohup /usr/bin/%s %s & %s", "cat <<%1$s\n%2$s; %3$s | x\n%1$s\n%4$s || %5$s", "git %s; python3.11 -m %s # %s | x\n\"%s && %s")
    kind = F.col("i") % 4
    out = F.lit(None).cast("string")
    for k, form in enumerate(made):
        out = F.when(kind == k, F.format_string(form, *"abcdef")).otherwise(out)
    return c.select("doc_id", "i", out.alias("command"))


@query("X6_programs_per_command", _SIX + """ SELECT doc_id, i, CASE kind WHEN 0 THEN concat_ws(',', b, c, e) WHEN 1 THEN concat_ws(',', b, d) WHEN 2 THEN concat_ws(',', 'cat', d, e) ELSE concat_ws(',', 'git ' || a, 'python -m ' || b) END AS programs,
    CASE kind WHEN 0 THEN ',|,&&' WHEN 1 THEN ',' WHEN 2 THEN ',,||' ELSE ',;' END AS joined_by, kind < 2 AS background, CASE WHEN kind = 3 THEN 'partial' ELSE 'success' END AS parse_status FROM x_s""", fixture=False)  # fmt: skip
def _(s, d):
    p = toolcalls.with_programs(_commands(s, d), "command")
    return p.select("doc_id", "i", F.array_join("programs", ",").alias("programs"), F.array_join("joined_by", ",").alias("joined_by"), "background", "parse_status")


@query("X6_shell_grammar", _SIX + """ SELECT doc_id, i, concat_ws(',', a, b, c) AS programs FROM x_s""", fixture=False)
def _(s, d):
    """Programs inside functions, loops, branches of a case, conditions and groups, beside quoted texts and substitutions; names of functions and patterns are none."""
    made = (
        "fun() { %s x; %s; }\nfunction other () {\n%s y\n}", "for i in %4$s %5$s; do %1$s $i | %2$s; done; %3$s", "case $1 in\n %4$s|%5$s) %1$s;;\n *) %2$s x && %3$s;;\nesac", "if %1$s %4$s; then %2$s; else %3$s; fi",
        "( %1$s; { %2$s %4$s; } ) && %3$s", "%1$s \"$(%4$s %5$s)\" `%5$s` ; %2$s 'f() { x; }' && %3$s", "while %1$s; do case %4$s in %5$s) %2$s x ;; esac; done; %3$s",
    )
    out, kind = F.lit(None).cast("string"), F.col("i") % len(made)
    for k, form in enumerate(made):
        out = F.when(kind == k, F.format_string(form, *"abcde")).otherwise(out)
    p = toolcalls.with_programs(sixes(s, d).select("doc_id", "i", out.alias("command")), "command")
    return p.select("doc_id", "i", F.array_join("programs", ",").alias("programs"))


@query("X7_wrappers_and_labels", _SIX + " SELECT doc_id, i, CASE kind WHEN 0 THEN 'sudo -u ' || a WHEN 1 THEN a || '=1 nohup' ELSE '' END AS before, CASE kind WHEN 0 THEN concat_ws(',', b, c, e) WHEN 1 THEN concat_ws(',', b, d) WHEN 2 THEN concat_ws(',', 'cat', d, e) ELSE concat_ws(',', 'git ' || a, 'python -m ' || b) END AS labels FROM x_s", fixture=False)
def _(s, d):
    p = toolcalls.with_programs(_commands(s, d), "command")
    return p.select("doc_id", "i", F.array_join("wrappers", " ").alias("before"), F.array_join("programs", ",").alias("labels"))


@query("X5_program_names", "WITH x_w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '[ \n\t]+'), lambda w: regexp_full_match(w, '[a-z]+'))) AS w FROM documents) SELECT w, CASE length(w) % 4 WHEN 0 THEN w WHEN 1 THEN w WHEN 2 THEN 'python' ELSE CASE w WHEN 'py' THEN 'python' WHEN 'nodejs' THEN 'node' ELSE w END END AS name FROM x_w", fixture=False)
def _(s, d):
    w = table(s, d, "documents").select(F.explode(strings.words(F.col("text"))).alias("w")).filter(F.col("w").rlike("^[a-z]+$")).distinct()
    k = F.length("w") % 4
    path = F.when(k == 0, F.concat(F.lit("/usr/bin/"), "w")).when(k == 1, F.concat(F.lit("C:\\tools\\"), "w", F.lit(".exe"))).when(k == 2, F.concat(F.lit("/opt/"), "w", F.lit("/python3.11"))).otherwise(F.col("w"))
    return w.select("w", shell.program_name(path).alias("name"))


def _joined(k):
    return F.transform("programs", lambda p, i: F.when(i == 0, "").otherwise(F.when(k, "|").otherwise("&&")))


_PURPOSES = "CASE " + " ".join(f"WHEN list_contains({RULES.purposes[p]}, string_split(p, ' ')[1]) THEN '{RULES.categories[p]}'" for p in RULES.order) + " ELSE 'Other' END"
_IGNORED = [*RULES.setup, *RULES.plumbing]


@query("X16_categories", f"""x_p AS (SELECT session_id, step, call_index, list_filter(programs, lambda x: NOT list_contains({_IGNORED}, string_split(x, ' ')[1])) AS w FROM fx_tool_calls WHERE programs IS NOT NULL),
    x_d AS (SELECT *, CASE WHEN step % 2 = 1 THEN w[1] ELSE w[-1] END AS p FROM x_p) SELECT session_id, step, call_index, CASE WHEN step % 13 = 0 THEN '*Wait/Poll' WHEN p IS NULL THEN '*File Ops' ELSE {_PURPOSES} END AS category FROM x_d""")  # fmt: skip
def _(s, d):
    """Pipelines at odd steps, lists at even ones, every thirteenth under nohup."""
    c = fx.tool_calls(s, d).filter("programs is not null")
    wrappers = F.when(F.col("step") % 13 == 0, F.array(F.lit("nohup")))
    return c.select("session_id", "step", "call_index", toolcalls.category(F.lit("shell"), F.col("programs"), _joined(F.col("step") % 2 == 1), F.lit(False), RULES, wrappers).alias("category"))


def _named(s, d):
    """Names made of all words of documents: as they are, of an MCP server, with a keyword in front or behind."""
    w = fx.words(s, d).select("word").distinct().filter(F.col("word").rlike("^[a-z]+$"))
    k = F.length("word") % 5
    raw = F.when(k == 0, F.initcap("word")).when(k == 1, F.concat(F.lit("mcp__"), "word")).when(k == 2, F.concat("word", F.lit("_Shell"))).when(k == 3, F.concat(F.lit("  browser-"), "word")).otherwise(F.concat(F.lit("re"), "word"))
    return w.select("word", raw.alias("raw"))


def _starts(words):
    return "|".join("[^a-z0-9]+".join(x.split("_")) for x in words)


_NAME = "CASE " + " ".join(f"WHEN list_contains({words}, clean) THEN '{name}'" for name, words in RULES.aliases.items()) + " " + " ".join(f"WHEN regexp_matches(clean, '(^|[^a-z0-9])({_starts(words)})') THEN '{name}'" for name, words in RULES.keywords.items()) + " ELSE clean END"
_FAMILY = f"CASE WHEN list_contains({RULES.spawn}, low) THEN 'subagent' " + " ".join(f"WHEN list_contains({names}, name) THEN '{family}'" for family, names in reversed(RULES.families.items())) + f" WHEN list_contains({RULES.ask_user}, low) THEN 'ask_user' WHEN contains(name, 'mcp') OR contains(name, '__') THEN 'mcp' ELSE 'other' END"
_NAMED = """WITH x_w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[ \n\t]+')) AS word FROM documents), x_r AS (SELECT word, CASE length(word) % 5 WHEN 0 THEN upper(word[1]) || word[2:] WHEN 1 THEN 'mcp__' || word WHEN 2 THEN word || '_Shell' WHEN 3 THEN '  browser-' || word ELSE 're' || word END AS raw FROM x_w WHERE regexp_full_match(word, '[a-z]+')),
    x_c AS (SELECT *, lower(raw) AS low, lower(trim(raw)) AS clean FROM x_r)"""


@query("X13_names_and_families", f"{_NAMED}, x_n AS (SELECT *, {_NAME} AS name FROM x_c) SELECT word, name, {_FAMILY} AS family FROM x_n", fixture=False)
def _(s, d):
    n = _named(s, d).withColumn("name", toolcalls.canonical_name(F.col("raw"), RULES))
    return n.select("word", "name", toolcalls.family(F.col("raw"), F.col("name"), RULES).alias("family"))


def _responses(s, d):
    """Responses with the calls of each request, in one shape or the other."""
    c = fx.tool_calls(s, d).groupBy("session_id", "step").agg(F.sort_array(F.collect_list("call_index")).alias("calls"))
    ident = lambda i: F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws(":", "session_id", "step")), 1, 12), F.lit("_"), i.cast("string"))
    a = F.to_json(F.struct(F.array(F.struct(F.struct(F.transform("calls", lambda i: F.struct(ident(i).alias("id"), F.struct(F.lit("bash").alias("name"), F.concat(F.lit('{"command":"ls '), i.cast("string"), F.lit('"}')).alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))
    b = F.to_json(F.struct(F.concat(F.array(F.struct(F.lit("text").alias("type"), F.lit("t").alias("id"), F.lit(None).cast("string").alias("name"), F.struct(F.lit(None).cast("string").alias("cmd")).alias("input"))), F.transform("calls", lambda i: F.struct(F.lit("tool_use").alias("type"), ident(i).alias("id"), F.lit("bash").alias("name"), F.struct(F.concat(F.lit("ls "), i.cast("string")).alias("cmd")).alias("input")))).alias("content"), F.lit("tool_use").alias("stop_reason")))
    return c.select("session_id", "step", F.when(F.col("step") % 2 == 0, a).otherwise(b).alias("response"))


@query("X22_calls_of_responses", "SELECT session_id, step, call_index, 'bash' AS raw_name, 'ls ' || call_index AS command FROM fx_tool_calls")
def _(s, d):
    c = toolcalls.calls_of_responses(_responses(s, d))
    return c.select("session_id", "step", "call_index", "raw_name", toolcalls.command_of(F.col("arguments")).alias("command"))


@query("J13_match_results", "SELECT session_id, step, call_index, call_index AS result_index FROM fx_tool_calls WHERE call_index % 3 < 2")
def _(s, d):
    c = settled(toolcalls.calls_of_responses(_responses(s, d)).select("session_id", "step", "call_index", "raw_id"), "calls")
    # two of three calls have a result in the next request; some ids come back with a prefix. All ids of a request share their stem
    r = c.filter("call_index % 3 < 2").select("session_id", (F.col("step") + 1).alias("step"), F.col("call_index").alias("result_index"), F.when(F.col("call_index") % 3 == 1, F.concat(F.lit("toolu"), "raw_id")).otherwise(F.col("raw_id")).alias("raw_id"))
    return toolcalls.match_results(c, r)


@query("A37_tool_turn_audit", "SELECT harness, count(*) AS tool_turns, count(*) FILTER (WHERE coalesce(b, 0) = 0) AS without_call FROM (SELECT *, lag(n_tool_calls) OVER (PARTITION BY session_id ORDER BY step) AS b FROM fx_requests) WHERE step_trigger = 'tool' GROUP BY harness")
def _(s, d):
    return toolcalls.audit(fx.base_requests(s, d))


@query("C14_released_requests", "SELECT substr(sha256('k' || 'session:' || session_id), 1, 32) AS session_id, step, substr(sha256('k' || 'user:' || user_id), 1, 16) AS user_id, CASE provider WHEN 'A' THEN 'W' WHEN 'B' THEN 'X' WHEN 'C' THEN 'Y' WHEN 'D' THEN 'Z' END AS provider FROM fx_requests")
def _(s, d):
    return release.released_requests(fx.base_requests(s, d).select("session_id", "step", "user_id", "provider"), dict(zip("ABCD", "WXYZ", strict=True)), "k")


@query("C17_release_sessions", _FAM + ", x_1 AS (SELECT session_id, session_id AS t, 0 AS depth FROM x_fam WHERE parent_session_id IS NULL), x_2 AS (SELECT c.session_id, t, 1 AS depth FROM x_fam c JOIN x_1 ON parent_session_id = x_1.session_id), x_3 AS (SELECT c.session_id, t, 2 AS depth FROM x_fam c JOIN x_2 ON parent_session_id = x_2.session_id) SELECT session_id, t AS trace_id, depth FROM (SELECT * FROM x_1 UNION ALL SELECT * FROM x_2 UNION ALL SELECT * FROM x_3)")
def _(s, d):
    f = settled(_family(s, d), "family")
    return release.release_sessions(f, f.filter("parent_session_id is null"), f.filter("parent_session_id is not null").select(F.col("parent_session_id").alias("parent"), F.col("session_id").alias("child")))


@query("A36_session_rows", "SELECT session_id, min(harness) AS harness, count(*) AS requests, sum(n_tool_calls)::BIGINT AS tool_calls, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM fx_requests GROUP BY session_id")
def _(s, d):
    return release.session_rows(fx.base_requests(s, d))


def _exports(s, d):
    r = fx.base_requests(s, d).select("session_id", F.col("step").cast("string").alias("request_id"), F.substring("user_id", 2, 20).cast("long").alias("u"), "step")
    ours = r.filter("u % 5 <> 0 and not (u % 5 = 1 and step = 0)")
    other = r.filter("u % 5 <> 4 and not (u % 5 = 2 and step = 0)").withColumn("request_id", F.when((F.col("u") % 5 == 3) & (F.col("step") == 0), "x").otherwise(F.col("request_id")))
    return ours.select("session_id", "request_id"), other.select("session_id", "request_id")


_CMP = """x_r AS (SELECT session_id, step, CAST(substr(user_id, 2) AS BIGINT) AS u FROM fx_requests), x_n AS (SELECT session_id, u, count(*) AS n FROM x_r GROUP BY ALL),
    x_o AS (SELECT session_id, CASE u % 5 WHEN 0 THEN 'only_other' WHEN 4 THEN 'only_ours' WHEN 1 THEN CASE WHEN n = 1 THEN 'only_other' ELSE 'fewer' END WHEN 2 THEN CASE WHEN n = 1 THEN 'only_ours' ELSE 'more' END ELSE 'differs' END AS outcome FROM x_n)"""


@query("J21_reference_outcomes", _CMP + " SELECT * FROM x_o")
def _(s, d):
    return release.compare(*_exports(s, d))


@query("A39_outcome_shares", _CMP + ", x_m AS (SELECT outcome, substr(session_id, length(session_id) - 9, 7) AS month FROM x_o) SELECT outcome, coalesce(month, 'all') AS month, count(*) AS n FROM x_m GROUP BY GROUPING SETS ((outcome, month), (outcome))")
def _(s, d):
    return release.outcome_shares(release.compare(*_exports(s, d)).withColumn("month", F.expr("substr(session_id, length(session_id) - 9, 7)")))


@query("A41_differing_numbers", "x_a AS (SELECT category, count(*) AS n, sum(result_tokens) AS t FROM fx_tool_calls GROUP BY category), x_b AS (SELECT category, count(*) AS n, sum(result_tokens) AS t FROM fx_tool_calls WHERE outcome IS NOT NULL GROUP BY category) SELECT category, 'calls' AS name, a.n::DOUBLE AS before, b.n::DOUBLE AS after FROM x_a a LEFT JOIN x_b b USING (category) WHERE a.n IS DISTINCT FROM b.n UNION ALL SELECT category, 'tokens', a.t::DOUBLE, b.t::DOUBLE FROM x_a a LEFT JOIN x_b b USING (category) WHERE a.t IS DISTINCT FROM b.t")
def _(s, d):
    c = fx.tool_calls(s, d)
    of = lambda x: x.groupBy("category").agg(F.count("*").alias("calls"), F.sum("result_tokens").alias("tokens"))
    return release.differing(of(c), of(c.filter("outcome is not null")), ["category"], ["calls", "tokens"])


@query("A14_share_by_category", "SELECT category, sum(result_tokens) / sum(sum(result_tokens)) OVER () AS share FROM fx_tool_calls GROUP BY category")
def _(s, d):
    n = fx.tool_calls(s, d).groupBy("category").agg(F.sum("result_tokens").alias("t"))
    return n.join(F.broadcast(n.agg(F.sum("t").alias("a"))), F.lit(True)).select("category", (F.col("t") / F.col("a")).alias("share"))


@query("A35_categories_per_request", "SELECT session_id, step, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories FROM fx_tool_calls GROUP BY ALL")
def _(s, d):
    return fx.tool_calls(s, d).groupBy("session_id", "step").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


@query("A49_trajectory_ends", """x_b AS (SELECT session_id, step, least(floor(10 * (row_number() OVER (PARTITION BY session_id, turn ORDER BY step) - 0.5) / count(*) OVER (PARTITION BY session_id, turn)), 9)::INT AS bin FROM fx_waited WHERE n_tool_calls > 0),
    x_g AS (SELECT bin, category IN ('Edit', 'Write') OR (category = '*File Ops' AND list_contains(programs, 'mkdir')) AS w FROM fx_tool_calls JOIN x_b USING (session_id, step)) SELECT bin, avg(w::INT) AS write_share FROM x_g WHERE bin IN (0, 9) GROUP BY bin""")  # fmt: skip
def _(s, d):
    return tools.trajectory_mix(fx.tool_calls(s, d), fx.requests(s, d)).filter("bin in (0, 9) and `group` = 'Write/Edit'").select("bin", F.col("share").alias("write_share"))


@query("A55_mean_width_and_band", "x_r AS (SELECT session_id, step, max((category = 'Ask User')::INT) AS asks, any_value(width) AS width, any_value(tool_wait_s) AS t FROM fx_calls GROUP BY ALL), x_q AS (SELECT quantile_cont(t, 0.9) AS p FROM x_r WHERE asks = 0 AND t IS NOT NULL AND width > 1 GROUP BY least(width, 8)) SELECT min(p) AS low, max(p) AS high FROM x_q")
def _(s, d):
    c = tools.calls_frame(fx.tool_calls(s, d), fx.requests(s, d))
    return tools.latency_by_width(c).filter("width > 1").agg(F.min("p90").alias("low"), F.max("p90").alias("high"))


@query("X34_finish_reasons", "SELECT event_id, CASE event_type WHEN 'click' THEN 'stop' WHEN 'view' THEN 'tool_calls' WHEN 'error' THEN 'other' WHEN 'purchase' THEN 'length' END AS finish_reason FROM fx_requests")
def _(s, d):
    stated = F.when(F.col("event_type") == "click", "end_turn").when(F.col("event_type") == "view", "tool_use").when(F.col("event_type") == "error", "boom").when(F.col("event_type") == "purchase", "max_tokens")
    return fx.base_requests(s, d).select("event_id", strings.finish_reason(stated).alias("finish_reason"))


@query("R6_header_fields", "SELECT event_id, 'u' || user_id AS account, CAST(k AS VARCHAR) AS build FROM fx_e")
def _(s, d):
    e = fx.base_requests(s, d)
    m = F.str_to_map(F.concat(F.lit("account="), "user_id", F.lit(";build="), "k"), F.lit(";"), F.lit("="))
    return e.select("event_id", m["account"].alias("account"), m["build"].alias("build"))


@query("T1_weekly_windows", "SELECT strftime(CAST(week AS DATE), '%Y-%m-%d') AS week, count(*) AS rows FROM fx_e GROUP BY 1")
def _(s, d):
    """The streaming window over the whole table, as a batch: the same expression serves both."""
    e = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy(F.window("ts", "7 days", "7 days", "3 days")).agg(F.count("*").alias("rows")).select(F.date_format("window.start", "yyyy-MM-dd").alias("week"), "rows")


@query("A56_hit_ratio_by_waited_for", "SELECT waited_for, avg(hit_ratio) AS mean_hit_ratio FROM fx_waited WHERE wait_s >= 0 AND waited_for IS NOT NULL AND hit_ratio IS NOT NULL GROUP BY waited_for")
def _(s, d):
    from ..operators import tokens

    r = fx.requests(s, d).select("waited_for", turns.wait_s().alias("w"), tokens.hit_ratio().alias("h")).filter("w >= 0 and waited_for is not null and h is not null")
    return r.groupBy("waited_for").agg(F.avg("h").alias("mean_hit_ratio"))


_FORMED = """WITH x_w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '[ \n\t]+'), lambda w: regexp_full_match(w, '[a-z]+'))) AS w FROM documents), x_k AS (SELECT w, length(w) AS n, (length(w) + ascii(w)) % {k} AS kind FROM x_w)"""


def _formed(s, d, k):
    """All distinct words of documents, with a kind by length and first letter."""
    w = table(s, d, "documents").select(F.explode(strings.words(F.col("text"))).alias("w")).filter(F.col("w").rlike("^[a-z]+$")).distinct()
    return w.withColumn("n", F.length("w")).withColumn("kind", (F.col("n") + F.ascii("w")) % k)


@query("X10_typed_words", _FORMED.replace("{k}", "11") + """ SELECT w, CASE kind WHEN 0 THEN '--' || w || '=<value>' WHEN 1 THEN '-' || w[1] || '=<value>' WHEN 2 THEN '-' || n WHEN 3 THEN '<assign>' WHEN 4 THEN '<var>' WHEN 5 THEN '> <path>' WHEN 6 THEN '<num>' WHEN 7 THEN '<path>' WHEN 8 THEN '<str>' WHEN 9 THEN '-' || w ELSE n || '>&1' END AS typed FROM x_k""", fixture=False)
def _(s, d):
    from ..functions import arguments

    forms = ("--%1$s=80", "-%1$s7x", "-%2$s", "%1$s=1", "$%1$s", ">%1$s.txt", "%2$s.5", "src/%1$s", "%1$s", "-%1$s", "%2$s>&1")
    made = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        made = F.when(F.col("kind") == k, F.format_string(form, "w", "n")).otherwise(made)
    return _formed(s, d, 11).select("w", arguments.type_word(made).alias("typed"))


@query("X9_value_types", _FORMED.replace("{k}", "8") + " SELECT w, ['<bool>', '<num>', '<null>', '<list>', '<object>', '<num>', '<path>', '<str>'][kind + 1] AS type FROM x_k", fixture=False)
def _(s, d):
    from ..functions import arguments

    forms = ("true", "%2$s.5", "null", '["%1$s"]', '{"%1$s":1}', '"%2$s"', '"%1$s/b"', '"%1$s"')
    made = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        made = F.when(F.col("kind") == k, F.format_string(form, "w", "n")).otherwise(made)
    j = _formed(s, d, 8).select("w", F.parse_json(F.concat(F.lit('{"v":'), made, F.lit("}"))).alias("j"))
    return j.select("w", arguments.value_type(F.try_variant_get("j", "$.v", "variant")).alias("type"))


@query("R5_ordered_pairs", "SELECT event_id, '{\"b\":' || k || ',\"a\":\"' || event_type || '\",\"b\":null}' AS text, 3 AS n FROM fx_requests")
def _(s, d):
    from ..functions import arguments

    e = fx.base_requests(s, d).select("event_id", F.concat(F.lit('{"b": '), "k", F.lit(', "a": "'), "event_type", F.lit('", "b": null}')).alias("t")).select("event_id", arguments.ordered_pairs("t").alias("p"))
    return e.select("event_id", arguments.pairs_text(F.col("p")).alias("text"), F.size("p").alias("n"))


@query("R4_last_assistant", "SELECT conv_id, max(i) FILTER (WHERE role = 'assistant')::INT AS last FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id", fixture=False)
def _(s, d):
    from ..functions import arguments

    c = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return c.select("conv_id", arguments.last_position(F.transform("m", lambda x: x["role"]), "assistant").alias("last"))
