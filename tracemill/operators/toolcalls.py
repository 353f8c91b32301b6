"""Tool-call job: responses to calls, commands to programs, names to families and categories, calls to results."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arguments, shell, strings

# ---- rule tables: a parameter. The defaults are a short part of what a user would load from files with load_rules


@dataclass
class Rules:
    aliases: dict[str, list[str]] = field(default_factory=lambda: {"read": ["read", "read_file", "view", "cat"], "write": ["write", "write_file"], "edit": ["edit", "edit_file", "apply_diff"], "shell": ["shell", "bash", "terminal", "execute_command"], "grep": ["grep", "search"], "list": ["glob", "list", "ls"]})
    keywords: dict[str, list[str]] = field(default_factory=lambda: {"browser": ["browser", "playwright"], "shell": ["execute_shell", "shell", "bash", "exec"], "read": ["read_file", "read"], "write": ["write_file"], "edit": ["edit", "patch"]})
    families: dict[str, list[str]] = field(default_factory=lambda: {"shell": ["shell"], "read": ["read", "grep", "list"], "edit": ["edit"], "write": ["write"], "browser": ["browser", "web_fetch", "web_search"], "mcp": ["mcp"]})
    spawn: list[str] = field(default_factory=lambda: ["task", "agent", "subagent", "spawn_agent"])
    ask_user: list[str] = field(default_factory=lambda: ["question", "ask_user", "ask_followup_question"])
    mcp: list[str] = field(default_factory=lambda: ["mcp", "__"])
    order: list[str] = field(default_factory=lambda: ["waiting", "build_test", "git", "search", "network", "packages", "interpreter", "files"])
    purposes: dict[str, list[str]] = field(default_factory=lambda: {
        "waiting": ["sleep", "nohup"], "build_test": ["pytest", "make", "cmake", "test", "build"], "git": ["git", "gh"], "search": ["grep", "rg", "find", "awk", "sed"], "network": ["curl", "wget", "ssh"],
        "packages": ["npm", "pip", "uv", "cargo", "apt"], "interpreter": ["python", "node", "java"], "files": ["cat", "ls", "cd", "mkdir", "rm", "cp", "mv", "head", "tail", "echo"],
    })
    setup: list[str] = field(default_factory=lambda: ["cd", "echo", "printf", "true", "false", "date", "sleep", "which", "export", "source", "pwd", "wait"])
    plumbing: list[str] = field(default_factory=lambda: ["cat", "head", "tail", "wc", "sort", "uniq", "cut", "tr", "tee", "less", "more", "column", "nl", "xargs"])
    run: list[str] = field(default_factory=lambda: ["run", "start", "dev", "exec", "x", "serve", "watch"])
    nouns: list[str] = field(default_factory=lambda: ["content", "item", "path"])
    categories: dict[str, str] = field(default_factory=lambda: {
        "read": "Read", "browser": "Browser", "edit": "Edit", "write": "Write", "mcp": "MCP", "subagent": "Subagent", "ask_user": "Ask User", "files": "*File Ops", "interpreter": "*Interpreter", "search": "*Search",
        "waiting": "*Wait/Poll", "git": "*Git/VCS", "build_test": "*Build/Test", "packages": "*Packages", "network": "*Network", "other": "Other",
    })


#: Where a rule file may hold a field: under the field's own name, or as (table, key) of a file by subject.
FILED = {
    "spawn": ("spawn", "tools"), "ask_user": ("ask_user", "tools"), "families": ("tool_families", None), "mcp": ("mcp", "name_contains"), "purposes": ("shell_purposes", None), "order": ("shell_rules", "purpose_order"),
    "setup": ("shell_rules", "setup_programs"), "plumbing": ("shell_rules", "plumbing_programs"), "run": ("shell_rules", "run_subcommands"), "nouns": ("shell_rules", "powershell_file_nouns"),
}


def load_rules(*paths: str, spark: SparkSession | None = None) -> Rules:
    """Rules from TOML files, read through Spark if a session is given, (tool names, categories) with a table or list for each field; what no file holds keeps its
    default. Tables and keys must be known, phrases in lower case, and every family and purpose of a category known."""
    given: dict = {}
    for path in paths:
        held = Path(path).read_text(encoding="utf-8") if spark is None else spark.read.text(path, wholetext=True).first().value
        for name, value in tomllib.loads(held).items():
            if name in given and name != "version":
                raise ValueError(f"{name} is in more than one file")
            given[name] = value
    given.pop("version", None)
    out = {}
    for name in Rules.__dataclass_fields__:
        at, key = FILED.get(name, (name, None))
        value = given.get(at)
        if key and isinstance(value, dict):
            if key in value:
                out[name] = value.pop(key)
        elif at in given:
            out[name] = given.pop(at)
        elif name in given:
            out[name] = given.pop(name)
    unknown = [name for name, value in given.items() if value or not isinstance(value, dict)]
    if unknown:
        raise ValueError(f"unknown rule tables: {sorted(unknown)}")
    for name, entries in out.items():
        for x in entries.values() if isinstance(entries, dict) and name != "categories" else [entries]:
            for phrase in x if isinstance(x, list) else []:
                if phrase != phrase.lower():
                    raise ValueError(f"{name}: {phrase!r} is not in lower case")
    return Rules(**out)


def canonical_name(raw: Column, rules: Rules) -> Column:
    """Alias, else the first rule with a keyword that starts a word, else the cleaned name."""
    clean = F.lower(F.trim(raw))
    out = clean
    for name, words in reversed(rules.keywords.items()):
        pattern = "|".join("[^a-z0-9]+".join(re.escape(p) for p in re.split("[^a-z0-9]+", w)) for w in words)
        out = F.when(clean.rlike(f"(^|[^a-z0-9])({pattern})"), name).otherwise(out)
    for name, words in reversed(rules.aliases.items()):
        out = F.when(clean.isin(*words), name).otherwise(out)
    return F.when(raw.isNull() | (F.trim(raw) == ""), "unknown").otherwise(out)


def family(raw: Column, canonical: Column, rules: Rules) -> Column:
    low = F.lower(raw)
    out = F.lit("other")
    for mark in rules.mcp:
        out = F.when(F.contains(canonical, F.lit(mark)), "mcp").otherwise(out)
    out = F.when(low.isin(*rules.ask_user), "ask_user").otherwise(out)
    for name, names in rules.families.items():
        out = F.when(canonical.isin(*names), name).otherwise(out)
    return F.when(F.coalesce(low, F.lit("")).isin(*rules.spawn), "subagent").otherwise(out)


def _first_word(label: Column) -> Column:
    return F.lower(F.split(F.trim(label), r"\s+")[0])


def deciding_program(programs: Column, joined_by: Column, rules: Rules) -> Column:
    """In the last pipeline that has one, the first program that neither sets up nor plumbs; null if there is none."""
    start = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("pipe"), F.lit(-1).alias("best_pipe"), F.lit(None).cast("string").alias("label"))

    def step(a, x):
        pipe = F.when((a["i"] < 0) | (x["j"] != "|"), a["pipe"] + 1).otherwise(a["pipe"])
        counts = ~_first_word(x["p"]).isin(*rules.setup, *rules.plumbing) & (pipe > a["best_pipe"])
        return F.struct((a["i"] + 1).alias("i"), pipe.alias("pipe"), F.when(counts, pipe).otherwise(a["best_pipe"]).alias("best_pipe"), F.when(counts, x["p"]).otherwise(a["label"]).alias("label"))

    return F.aggregate(F.zip_with(programs, joined_by, lambda p, j: F.struct(p.alias("p"), j.alias("j"))), start, step, lambda a: a["label"])


def purpose(label: Column, rules: Rules) -> Column:
    """The first purpose in order that lists a word of the label; code is the interpreter's, a PowerShell file noun is files."""
    words = F.split(F.lower(F.trim(label)), r"\s+")
    noun = F.regexp_extract(F.get(words, 0), r"^[a-z]+-([a-z]+)$", 1)
    out = F.when(noun.isin(*rules.nouns), "files").otherwise("other")
    for name in reversed(rules.order):
        listed = F.arrays_overlap(words, F.array(*map(F.lit, rules.purposes.get(name, [""]))))
        value = F.when(F.get(words, 1).isin(*rules.run), "interpreter").otherwise(name) if name == "packages" else F.lit(name)
        out = F.when(listed, value).otherwise(out)
    return F.when(F.endswith(label, F.lit("(code)")), "interpreter").otherwise(out)


def category(fam: Column, programs: Column, joined_by: Column, background: Column, rules: Rules, wrappers: Column | None = None) -> Column:
    """wrappers: the words before programs (`nohup`), which make a command wait as program words do."""
    words = F.flatten(F.transform(programs, lambda p: F.split(F.lower(p), r"\s+")))
    if wrappers is not None:
        words = F.concat(words, F.transform(F.coalesce(wrappers, F.array().cast("array<string>")), F.lower))
    waits = background | F.arrays_overlap(words, F.array(*map(F.lit, rules.purposes.get("waiting", [""]))))
    by_program = strings.let(deciding_program(programs, joined_by, rules), lambda d: F.when(d.isNull(), "files").otherwise(purpose(d, rules)))
    key = F.when(fam == "shell", F.when(F.size(programs) == 0, None).when(waits, "waiting").otherwise(by_program)).otherwise(fam)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in rules.categories.items() for x in kv))[key], F.lit("Other"))


def with_programs(calls: DataFrame, command: str) -> DataFrame:
    """calls with programs, joined_by, background, wrappers and parse_status of the command column; null where there is no command."""
    return calls.withColumn("__p", shell.programs(F.col(command))).select(*calls.columns, "__p.*")


# ---- calls of a response


# fixed values
FUNCTION_CALL = (r"(?s)<function=([A-Za-z0-9_.\-]+)\s*>(.*?)(?:</function>|\z)", r"(?s)<parameter=([A-Za-z0-9_.\-]+)\s*>(.*?)</parameter>")
INVOKE_CALL = (r'(?s)<invoke name="([^"]+)"\s*>(.*?)(?:</invoke>|\z)', r'(?s)<parameter name="([^"]+)"\s*>(.*?)</parameter>')
CHILD_ELEMENT = r"(?s)<([A-Za-z_][\w-]*)>(.*?)</\1>"
FENCED_BLOCK = r"(?s)```[^\n`]*\n(.*?)\n[ \t]*```"
FENCED_NAME = "bash"

_CALLS = "choices array<struct<message:struct<tool_calls:array<struct<function:struct<arguments:string>>>>>>, content array<struct<input:string>>"
_CALL = "array<struct<raw_name:string,raw_id:string,arguments:string>>"


def _named_texts(text: Column, pattern: str) -> Column:
    """(key, value) of a pattern's two groups, values trimmed."""
    all_of = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    return F.zip_with(all_of(1), all_of(2), lambda k, v: F.struct(k.alias("key"), F.regexp_replace(v, r"(?U)^\s+|\s+$", "").alias("value")))


def text_calls(text: Column) -> Column:
    """Calls written inside a text: each opener's name, its parameters as a JSON object. One grammar's calls come before the other's."""

    def of(call: str, parameter: str) -> Column:
        names, inside = (F.regexp_extract_all(text, F.lit(call), F.lit(k)) for k in (1, 2))
        return F.zip_with(names, inside, lambda n, i: F.struct(n.alias("raw_name"), F.lit(None).cast("string").alias("raw_id"), arguments.object_text(_named_texts(i, parameter)).alias("arguments")))

    return F.when(F.contains(text, F.lit("<function=")) | F.contains(text, F.lit('<invoke name="')), F.concat(of(*FUNCTION_CALL), of(*INVOKE_CALL)))


def named_elements(text: Column, name: Column) -> Column:
    """Inner texts of a text's elements of this name, in order; one left open runs to the end."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)<"), name, F.lit(">(.*?)(?:</"), name, F.lit(r">|\z)")), F.lit(1))


def child_elements(text: Column) -> Column:
    """Child elements as a JSON object."""
    return arguments.object_text(_named_texts(text, CHILD_ELEMENT))


def fenced_command(text: Column) -> Column:
    """The command of a text's only fenced block, as arguments; null if there is none or another."""
    blocks = F.regexp_extract_all(text, F.lit(FENCED_BLOCK), F.lit(1))
    return strings.let(blocks, lambda b: F.when(F.size(b) == 1, arguments.object_text(F.array(F.struct(F.lit("command").alias("key"), F.regexp_replace(b[0], r"(?U)^\s+|\s+$", "").alias("value"))))))


def _is_text(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"


def _visible(v: Column) -> Column:
    get = F.try_variant_get
    blocks = F.filter(get(v, "$.content", "array<variant>"), lambda b: (get(b, "$.type", "string") == "text") & _is_text(b, "$.text"))
    joined = F.when(F.size(blocks) > 0, F.array_join(F.transform(blocks, lambda b: get(b, "$.text", "string")), ""))
    first = F.when(_is_text(v, "$.choices[0].message.content"), get(v, "$.choices[0].message.content", "string"))
    return F.when(get(v, "$.choices", "variant").isNotNull(), first).when(get(v, "$.stop_reason", "variant").isNotNull() | (get(v, "$.type", "string") == "message"), joined)


def visible_text(response: Column) -> Column:
    """What a response says: the first choice's text, or its text blocks with nothing between; null for another shape."""
    return strings.let(F.try_parse_json(response), _visible)


def calls_of_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """responses with one row a call: call_index, raw_name, raw_id, arguments (JSON text, keys as sent). Two shapes of response are read: choices with
    tool_calls, of which the first that has calls counts, and content blocks of type tool_use. A response without either gives the calls written in its text."""
    get = F.try_variant_get
    none = F.array().cast("array<variant>")

    def call(v: Column, name: str, given: str, raw: Column) -> Column:
        kept = F.when(_is_text(v, given), get(v, given, "string")).when(get(v, given, "variant").isNotNull() & ~F.coalesce(F.is_variant_null(get(v, given, "variant")), F.lit(False)), arguments.spaced_json(F.coalesce(raw, F.to_json(get(v, given, "variant")))))
        return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.struct(F.when(_is_text(v, name), get(v, name, "string")).alias("raw_name"), F.when(_is_text(v, "$.id"), get(v, "$.id", "string")).alias("raw_id"), kept.alias("arguments")))

    v = responses.withColumn("__v", F.try_parse_json(text)).withColumn("__raw", F.from_json(text, _CALLS))
    listed = F.transform(F.coalesce(get("__v", "$.choices", "array<variant>"), none), lambda c, i: F.struct(i.alias("i"), F.coalesce(get(c, "$.message.tool_calls", "array<variant>"), none).alias("calls")))
    v = v.withColumn("__k", F.get(F.filter(listed, lambda x: F.size(x["calls"]) > 0), 0)).withColumn("__blocks", F.coalesce(get("__v", "$.content", "array<variant>"), none))
    of_choice = F.transform("__k.calls", lambda c, i: call(c, "$.function.name", "$.function.arguments", F.get(F.get("__raw.choices", F.col("__k.i"))["message"]["tool_calls"], i)["function"]["arguments"]))
    block = lambda b, i: F.when(get(b, "$.type", "string") == "tool_use", call(b, "$.name", "$.input", F.get("__raw.content", i)["input"]))
    whole = get("__v", "$.stop_reason", "variant").isNotNull() | (get("__v", "$.type", "string") == "message")
    sent = F.when(get("__v", "$.choices", "variant").isNotNull(), of_choice).when(whole, F.transform("__blocks", block))
    v = v.withColumn("__sent", F.coalesce(F.filter(sent, lambda c: c.isNotNull()), F.array().cast(_CALL)))
    written = text_calls(_visible(F.col("__v")))
    v = v.withColumn("__c", F.when(F.size("__sent") > 0, F.col("__sent")).otherwise(written))
    return v.select(*responses.columns, F.posexplode("__c").alias("call_index", "__x")).select(*responses.columns, "call_index", "__x.raw_name", "__x.raw_id", "__x.arguments")


def command_of(arguments: Column) -> Column:
    """The command a call's arguments hold, under any of its names; a list is run line by line."""
    listed = F.from_json(F.get_json_object(arguments, "$.commands"), "array<string>")
    at = F.coalesce(F.array_join(listed, "\n"), F.get_json_object(arguments, "$.commands"))
    return F.coalesce(F.get_json_object(arguments, "$.command"), at, F.get_json_object(arguments, "$.cmd"))


def match_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call's result in the next request: by its id as written first, then, for calls without one, by its id without a
    sequence suffix; one result a call and one call a result.

    calls: session_id, step, call_index, raw_id; results: session_id, step (of the request that brings it), result_index, raw_id, text.
    Both are exploded to keys; within a phase calls choose in order, each the first free result."""
    at = ["session_id", "step"]
    brought = results.select("session_id", (F.col("step") - 1).alias("step"), "result_index", "raw_id")

    def keyed(rows: DataFrame, index: str, own: Column, other: Column) -> DataFrame:
        of = lambda phase, keys: F.transform(keys, lambda k: F.struct(F.lit(phase).alias("phase"), k.alias("key")))
        return rows.select(*at, index, F.explode(F.concat(of(0, own), of(1, other))).alias("k")).select(*at, index, "k.*")

    # both phases in one join
    raw = F.col("raw_id")
    own = strings.own_keys(raw)
    c = keyed(calls, "call_index", own, F.array_except(strings.emitted_keys(raw), own))
    pairs = c.join(keyed(brought, "result_index", own, strings.replayed_keys(raw)), [*at, "phase", "key"])

    # a row is one request's calls
    rows = pairs.groupBy(*at).agg(F.sort_array(F.collect_set(F.struct("phase", "call_index", "result_index"))).alias("pairs"))
    none = F.array().cast("array<struct<call_index:int,result_index:int>>")

    def choose(chosen: Column, x: Column) -> Column:
        free = ~F.exists(chosen, lambda y: (y["call_index"] == x["call_index"]) | (y["result_index"] == x["result_index"]))
        return F.when(free, F.array_append(chosen, F.struct(x["call_index"].alias("call_index"), x["result_index"].alias("result_index")))).otherwise(chosen)

    return rows.select(*at, F.explode(F.aggregate("pairs", none, choose)).alias("x")).select(*at, "x.call_index", "x.result_index")


def audit(requests: DataFrame) -> DataFrame:
    """Tool turns per harness, and those that follow no call. requests: session_id, step, harness, step_trigger, n_tool_calls."""
    from .turns import in_session

    r = requests.withColumn("__b", F.lag("n_tool_calls").over(in_session())).filter("step_trigger = 'tool'")
    return r.groupBy("harness").agg(F.count("*").alias("tool_turns"), F.count_if(F.coalesce("__b", F.lit(0)) == 0).alias("without_call"))
