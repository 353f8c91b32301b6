"""Request and response bodies: messages, results, linking signals, declared tools, token counts and system prompts.

A prompt is the JSON text of an object with `messages` (and maybe `system` and `tools`), or of a list of messages. A body is parsed
once (`rendering.messages`) into typed records of its messages; all that follows is column expressions over them.
A body of another shape has no messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arguments, rendering, strings
from ..functions.strings import let
from ..operators import toolcalls

# fixed values
OUTPUT_AS_TEXT = (r"(?ms)^\[[a-z_]+(?: for '.{0,2000}?')?\] Result:", r"(?m)^<returncode>\d+</returncode>", r"\*\*Background job \w+: bg_[0-9a-f]{6,}\*\*")
NAMED_RESULT = r"(?s)^\[([A-Za-z_][\w-]*)(?: for '.*?')?\] Result:"
INTRO_MESSAGES, INTRO_CHARACTERS = 6, 20_000
NEW_CONTENT_CHARACTERS = 4_000
MIN_VISIBLE_WORDS = 8
PROMPT_ARGUMENTS = ("prompt", "task", "task_description", "message", "goal", "description")
MIN_PROMPT_WORDS, MIN_TASKS, PROMPT_CHARACTERS, OPENING_CHARACTERS, ROOT_CHARACTERS = 3, 40, 20_000, 1_500, 30_000
TOKEN_SOURCES = {
    "prompt_tokens": ("$.prompt_tokens", "$.usage.prompt_tokens", "$.usage.input_tokens"),
    "completion_tokens": ("$.completion_tokens", "$.usage.completion_tokens", "$.usage.output_tokens"),
    "reasoning_tokens": ("$.reasoning_tokens", "$.usage.reasoning_tokens"),
    "cache_read_tokens": ("$.cache_read_tokens", "$.usage.prompt_tokens_details.cached_tokens", "$.usage.cache_read_input_tokens"),
    "cache_write_tokens": ("$.cache_write_tokens", "$.usage.cache_creation_input_tokens"),
}

_NONE = "array<variant>"


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _text_of(v: Column, path: str) -> Column:
    """A field that is text; null for another type."""
    return F.when(F.schema_of_variant(_at(v, path)) == "STRING", _at(v, path, "string"))


def messages(prompt: Column) -> Column:
    """The messages of a prompt in order, as an array of records (`rendering.MESSAGE`)."""
    return rendering.messages(prompt)


def last_assistant(ms: Column) -> Column:
    """Place (from 0) of the last assistant message; null without one."""
    return arguments.last_position(F.transform(ms, lambda m: m["role"]), "assistant")


def new_messages(ms: Column) -> Column:
    """The messages after the last assistant message; all of them without one."""
    return let(ms, lambda a: F.filter(F.slice(a, F.coalesce(last_assistant(a), F.lit(-1)) + 2, F.greatest(F.size(a), F.lit(1))), lambda m: m["is_object"]))


def intro_window(prompt: Column) -> Column:
    """System and user text among the first messages, cut and in lower case, which names the harness."""
    shown = let(messages(prompt), lambda a: F.transform(F.filter(F.slice(a, 1, INTRO_MESSAGES), lambda m: m["role"].isin("system", "user")), lambda m: m["plain"]))
    return F.lower(F.substring(F.array_join(shown, "\n"), 1, INTRO_CHARACTERS))


def _content_kind(new: Column) -> Column:
    text = F.substring(F.array_join(F.filter(F.transform(new, lambda m: m["plain"]), lambda t: t != ""), "\n"), 1, NEW_CONTENT_CHARACTERS)
    as_text = let(text, lambda t: t.rlike(OUTPUT_AS_TEXT[0]) | t.rlike(OUTPUT_AS_TEXT[1]) | t.rlike(OUTPUT_AS_TEXT[2]))
    return F.when(F.size(new) == 0, "nothing").when(F.exists(new, lambda m: m["has_result"]), "tool_result").when(as_text, "tool_output_as_text").otherwise("user_message")


def new_content_kind(prompt: Column) -> Column:
    """What follows the last assistant message."""
    return let(new_messages(messages(prompt)), _content_kind)


def fresh_results(requests: DataFrame, prompt: str = "prompt") -> DataFrame:
    """A row for each result that a request's new messages bring: result_index, raw_id, text, is_error. Tool messages carry one,
    tool_result blocks of user messages one each; without an assistant message nothing is fresh."""
    return requests.select(*requests.columns, F.posexplode(rendering.fresh(F.col(prompt))).alias("result_index", "__r")).select(*requests.columns, "result_index", "__r.*")


def text_results(requests: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Results written into new user text: place, the tool a line names (null for a return code), its occurrence among results of that
    name, and the text."""
    texts = F.flatten(F.transform(new_messages(messages(F.col(prompt))), lambda m: m["user_texts"]))
    t = requests.select(*requests.columns, F.posexplode(texts).alias("place", "text")).filter(F.col("text").rlike(NAMED_RESULT) | F.col("text").rlike(r"^\s*<returncode>-?\d+</returncode>"))
    t = t.withColumn("name", F.nullif(F.regexp_extract("text", NAMED_RESULT, 1), F.lit("")))
    return t.withColumn("occurrence", F.row_number().over(Window.partitionBy("request_id", "name").orderBy("place")) - 1)


def calls_named_by_results(replies: DataFrame, results: DataFrame) -> DataFrame:
    """The calls that replies wrote as text, as results name them. replies: request_id, reply; results: of the next request under this
    request_id, name, occurrence. The k-th result of a name takes the reply's k-th element of that name, or, where the reply has none, its
    k-th `use_` element; an element left open runs to the end, and its child elements are the arguments. A result without a name
    (a return code) takes the reply's one fenced block."""
    r = results.join(replies, "request_id")
    has = F.contains("reply", F.concat(F.lit("<"), "name", F.lit(">")))
    named = r.filter("name is not null").withColumn("raw_name", F.when(has, F.col("name")).otherwise(F.concat(F.lit("use_"), "name")))
    element = F.get(toolcalls.named_elements(F.col("reply"), F.col("raw_name")), F.col("occurrence"))
    named = named.withColumn("arguments", F.when(element.isNotNull(), toolcalls.child_elements(element)))
    fenced = r.filter("name is null and occurrence = 0").withColumn("raw_name", F.lit(toolcalls.FENCED_NAME)).withColumn("arguments", toolcalls.fenced_command(F.col("reply")))
    return named.unionByName(fenced).filter("arguments is not null").select("request_id", "name", "raw_name", "occurrence", "arguments")


def first_user_text(prompt: Column) -> Column:
    """The first user message's own text, as spawn prompts are looked for in it: cut, on one line, in lower case."""
    users = F.filter(messages(prompt), lambda m: m["role"] == "user")
    return strings.normalise(F.substring(F.coalesce(F.get(users, 0)["own_text"], F.lit("")), 1, ROOT_CHARACTERS))


def delegation(call_arguments: Column) -> Column:
    """The prompt a spawn call hands on: the first of its usual arguments that is a text of three words or more, else a long `tasks` text."""

    def of(v: Column) -> Column:
        long = F.filter(F.array(*(_text_of(v, f"$.{name}") for name in PROMPT_ARGUMENTS)), lambda t: t.isNotNull() & (F.size(strings.words(F.regexp_replace(t, r"(?U)\s+", " "))) >= MIN_PROMPT_WORDS))
        tasks = _text_of(v, "$.tasks")
        return F.coalesce(F.get(long, 0), F.when(F.length(tasks) > MIN_TASKS, tasks))

    return let(F.try_parse_json(call_arguments), of)


def opening(call_arguments: Column) -> Column:
    """The start of a spawn call's prompt that its child's first user text must hold; null without a prompt."""
    return F.substring(strings.normalise(F.substring(delegation(call_arguments), 1, PROMPT_CHARACTERS)), 1, OPENING_CHARACTERS)


def tool_names(definitions: Column, path: str = "$") -> Column:
    """A name for each tool of a JSON list (or of the list at a path), under either shape; null for a tool without one, and for no list."""
    return let(F.try_parse_json(definitions), lambda v: F.transform(_at(v, path, _NONE), lambda t: F.coalesce(_text_of(t, "$.function.name"), _text_of(t, "$.name"))))


def declared_tools(body: Column) -> Column:
    """Names of the tools a prompt declares, in order; tools without a name are left out."""
    return F.coalesce(F.filter(tool_names(body, "$.tools"), lambda n: n.isNotNull()), F.array().cast("array<string>"))


def input_entries(requests: DataFrame, prompt: str = "prompt", system: Column | None = None, tools: Column | None = None) -> DataFrame:
    """The input in order, a row an entry: tool definitions, the top-level system prompt, then the messages. position, role as released, and
    the text the model read. system and tools: JSON texts; without them the body's own fields are read."""
    null = F.lit(None).cast("string")
    e = rendering.input_entries(F.col(prompt), null if system is None else system, null if tools is None else tools)
    return requests.select("request_id", F.posexplode(e).alias("position", "e")).select("request_id", "position", "e.*")


def system_prompts(records: DataFrame, payload: str = "prompt") -> DataFrame:
    """Rows whose payload has a top-level system prompt that is not empty, with the text it starts with: its own, or its first block's."""
    v = records.withColumn("__v", F.try_parse_json(payload)).withColumn("__s", _at(F.col("__v"), "$.system"))
    empty = F.to_json("__s").isin('""', "[]", "{}", "null", "false", "0")
    v = v.filter(F.col("__s").isNotNull() & ~F.is_variant_null("__s") & ~F.coalesce(empty, F.lit(False)))
    return v.withColumn("system_text", F.coalesce(_text_of(F.col("__v"), "$.system"), _text_of(F.col("__v"), "$.system[0].text"), F.lit(""))).drop("__v", "__s")


def token_counts(record: Column) -> Column:
    """The five counts of a record (VARIANT): its own field first, then the usage of its response, given as JSON text."""
    with_usage = lambda v: F.try_parse_json(_at(v, "$.response", "string"))

    def number(v: Column, path: str) -> Column:
        kind = F.schema_of_variant(_at(v, path))
        return F.when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), _at(v, path, "double").try_cast("bigint"))

    def of(v: Column) -> Column:
        return let(with_usage(v), lambda u: F.struct(*(F.coalesce(*(number(u if p.startswith("$.usage") else v, p) for p in paths)).alias(name) for name, paths in TOKEN_SOURCES.items())))

    return let(record, of)


def signals(requests: DataFrame) -> DataFrame:
    """requests: request_id, user_id, end_ms, prompt, response. What lineage links by: ids emitted and replayed, phrases of the answer
    (with its calls, where it is short) and of the last assistant message of the input; and what new content came."""
    calls = toolcalls.calls_of_responses(requests.select("request_id", "response"))
    written = F.transform(F.array_sort(F.collect_list(F.struct("call_index", "raw_name", "arguments"))), lambda c: F.concat_ws(" ", F.coalesce(c["raw_name"], F.lit("")), F.coalesce(c["arguments"], F.lit(""))))
    keys = calls.groupBy("request_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(strings.emitted_keys(F.col("raw_id")))))).alias("emitted_ids"), F.array_join(written, " ").alias("__calls"))
    r = requests.join(keys, "request_id", "left").withColumn("__m", messages(F.col("prompt")))
    r = r.withColumn("__last", F.get("__m", last_assistant(F.col("__m")))).withColumn("__said", F.coalesce(toolcalls.visible_text(F.col("response")), F.lit("")))
    few = (F.size(strings.words(F.col("__said"))) < MIN_VISIBLE_WORDS) & F.col("__calls").isNotNull()
    none = F.array().cast("array<string>")
    return r.select(
        "request_id", "user_id", "end_ms", F.coalesce("emitted_ids", none).alias("emitted_ids"), F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("__last.call_ids", strings.replayed_keys)))), none).alias("replayed_ids"),
        strings.shingles(F.when(few, F.concat_ws(" ", "__said", "__calls")).otherwise(F.col("__said"))).alias("answer_shingles"), F.coalesce(F.when(F.col("__last").isNotNull(), strings.shingles(F.col("__last.plain"))), none).alias("replayed_shingles"), let(new_messages(F.col("__m")), _content_kind).alias("new_content_kind"),
    )
