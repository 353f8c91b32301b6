"""Public words by the k-accounts rule, stand-ins, block ids and the gate before publishing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings

K_ACCOUNTS = 3
RAW_ID_CHARACTERS = 12


def public_words(entries: DataFrame, k: int = K_ACCOUNTS) -> DataFrame:
    """entries: account, word. Words that k accounts or more use; the count is exact, for it bounds what is told of anyone.

    Pairs are made distinct before words are counted, so a word everyone uses is pre-aggregated."""
    return entries.filter(F.col("account").isNotNull()).groupBy("word", "account").agg(F.lit(1).alias("__one")).groupBy("word").agg(F.count("*").alias("accounts")).filter(F.col("accounts") >= k)


def with_stand_ins(labels: DataFrame, public: DataFrame, stand_in: str = "<word>") -> DataFrame:
    """labels: label. The longest prefix of words that is public, then a stand-in; all of it where it is public. No prefix has more
    words than the longest public entry, so a long label is not read once a word."""
    w = F.split("label", " ")
    most = public.agg(F.coalesce(F.max(F.size(F.split("word", " "))), F.lit(1)).alias("most"))  # one row
    prefixes = labels.select("label").distinct().join(most, F.lit(True)).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(w), "most")), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(w, 1, i), " ").alias("prefix")))).alias("p")).select("label", "p.*")
    best = prefixes.join(public.select(F.col("word").alias("prefix")), "prefix").groupBy("label").agg(F.max("n").alias("n"))
    shown = F.when(F.col("n") == F.size(w), F.col("label")).otherwise(F.concat_ws(" ", F.nullif(F.array_join(F.slice(w, 1, F.coalesce("n", F.lit(0))), " "), F.lit("")), F.lit(stand_in)))
    return labels.join(best, "label", "left").withColumn("shown", shown).drop("n")


# fixed values
WORD, PROGRAM, KEY = "<word>", "<program>", "<key>"
LONG_FLAG, SHORT_FLAG, VALUE = "--<flag>", "-<flag>", "=<value>"
FLAGS = (LONG_FLAG, SHORT_FLAG, LONG_FLAG + VALUE, SHORT_FLAG + VALUE)
TYPES = ("<path>", "<num>", "<str>", "<bool>", "<null>", "<list>", "<object>", "<code>", "<unparsed>")
SCRIPT = r"(?i)\.(sh|bash|py|js|mjs|cjs|ts|ps1|rb|pl|bat|cmd|php|lua)$"


def typed_stand_in(label: Column, rules) -> Column:
    """`<purpose>` of a hidden label whose purpose is known, else `<script>.<ending>` of a script, else null."""
    from .toolcalls import purpose

    ending = F.lower(F.regexp_extract(F.split(F.trim(label), r"\s+")[0], SCRIPT, 1))
    return strings.let(purpose(label, rules), lambda p: F.when(p != "other", F.concat(F.lit("<"), p, F.lit(">"))).when(ending != "", F.concat(F.lit("<script>."), ending)))


def released_labels(labels: DataFrame, public: DataFrame, stand_ins: list[str], rules) -> DataFrame:
    """labels: label. What each ships as: itself where public; its longest public prefix and `<word>`; its typed stand-in, if that is
    listed; else `<program>`. Distinct labels are few beside calls, and meet public words by a join."""
    w = F.split(F.trim("label"), r"\s+")
    parts = F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(w, 1, i), " ").alias("word")))
    prefixes = labels.select("label").distinct().select("label", F.size(w).alias("size"), F.explode(parts).alias("p")).select("label", "size", "p.*")
    best = prefixes.join(public.select("word"), "word").groupBy("label").agg(F.max_by("word", "n").alias("prefix"), F.max(F.col("n") == F.col("size")).alias("whole"))
    typed = typed_stand_in(F.col("label"), rules)
    shown = F.when(F.col("whole"), F.col("label")).when(F.col("prefix").isNotNull(), F.concat_ws(" ", "prefix", F.lit(WORD))).when(typed.isin(*stand_ins), typed).otherwise(PROGRAM)
    return labels.join(best, "label", "left").withColumn("released_label", shown).drop("prefix", "whole")


def _is_command(key: Column, value: Column) -> Column:
    return ~value.isin(*TYPES) & (key != "subagent_type")


def _parsed_skeletons(skeletons: DataFrame) -> DataFrame:
    """Distinct skeletons (skeleton), written with a number that stands for them (__id) and their pairs (__p): key, value, and for commands the words,
    each with whether a program stands there, which is in each command the first word that is no wrapper, placeholder or flag."""
    from ..functions import arguments, shell
    from .lineage import settled

    def step(a: Column, w: Column) -> Column:
        operator = w.isin(*arguments.OPERATORS)
        program = ~operator & a["open"] & ~w.isin(*shell.WRAPPERS, *arguments.PLACEHOLDERS) & ~w.startswith("-")
        return F.struct((operator | (a["open"] & ~program)).alias("open"), F.array_append(a["out"], F.struct(w.alias("token"), program.alias("program"))).alias("out"))

    start = F.struct(F.lit(True).alias("open"), F.array().cast("array<struct<token:string,program:boolean>>").alias("out"))
    words = lambda p: F.when(_is_command(p["key"], p["value"]), F.aggregate(F.split(F.trim(p["value"]), r"\s+"), start, step, lambda a: a["out"]))
    s = skeletons.select("skeleton").distinct().withColumn("__q", arguments.skeleton_pairs(F.col("skeleton")))
    pairs = F.transform("__q", lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"), words(p).alias("words")))
    return settled(s.select("skeleton", F.monotonically_increasing_id().alias("__id"), pairs.alias("__p")), "skeletons")


def _plain(token: Column) -> Column:
    return F.regexp_replace(token, "=<value>$", "")


# fixed values
KEY_MARK, WORD_MARK, TYPE_MARK = "k", "w", "t"
SALTS = 32


def _marked(mark: str, word: Column) -> Column:
    return F.concat(F.lit(mark), word)


def _with_listed(parsed: DataFrame, listed: DataFrame, types: bool) -> DataFrame:
    """parsed skeletons with __known, which of their marked keys, words and subagent types are in listed (word). Entries meet the list beside nothing
    but the number, and a word that nearly every skeleton holds is dealt over SALTS tasks."""
    from ..functions import arguments

    def asked(p: Column) -> Column:
        plain = F.filter(p["words"], lambda w: ~w["token"].isin(*arguments.PLACEHOLDERS, *arguments.OPERATORS))
        kind = F.filter(F.array(_marked(TYPE_MARK, p["value"])), lambda x: F.lit(types) & p["words"].isNull() & (p["key"] == "subagent_type"))
        return F.concat(F.array(_marked(KEY_MARK, p["key"])), F.coalesce(F.transform(plain, lambda w: _marked(WORD_MARK, _plain(w["token"]))), F.array().cast("array<string>")), kind)

    salt = F.pmod(F.hash("__id"), F.lit(SALTS)).alias("__salt")
    entries = parsed.select("__id", salt, F.explode(F.array_distinct(F.flatten(F.transform("__p", asked)))).alias("word"))
    dealt = listed.distinct().select("word", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    known = entries.join(dealt, ["word", "__salt"], "left_semi").groupBy("__id").agg(F.collect_list("word").alias("__known"))
    return parsed.join(known, "__id", "left").withColumn("__known", F.coalesce("__known", F.array().cast("array<string>")))


def _listed(**words: DataFrame) -> DataFrame:
    marks = {"keys": KEY_MARK, "words": WORD_MARK, "types": TYPE_MARK}
    return reduce(DataFrame.union, (df.select(_marked(marks[name], F.col("word")).alias("word")) for name, df in words.items())).filter("word is not null")


def released_skeletons(calls: DataFrame, keys: DataFrame, words: DataFrame, stand_ins: list[str], rules) -> DataFrame:
    """calls: skeleton (and subagent_type, public_type where those are to ship). A key that is not in keys becomes `<key>`; a command word
    that is neither a placeholder, an operator nor in words becomes its stand-in: a program's typed one if listed, else `<program>`; a
    flag's with its dashes; else `<word>`. keys, words: word. Works on distinct skeletons, whose words meet the lists by joins."""
    from ..functions import arguments

    s = _with_listed(_parsed_skeletons(calls), _listed(keys=keys, words=words), types=False)
    known = lambda mark, x: F.array_contains("__known", _marked(mark, x))

    def shown(w: Column) -> Column:
        token = w["token"]
        typed = strings.let(typed_stand_in(token, rules), lambda x: F.when(x.isin(*stand_ins), x).otherwise(PROGRAM))
        end = F.when(F.endswith(token, F.lit(VALUE)), VALUE).otherwise("")
        hidden = F.when(w["program"], typed).when(F.startswith(token, F.lit("--")), F.concat(F.lit(LONG_FLAG), end)).when(F.startswith(token, F.lit("-")), F.concat(F.lit(SHORT_FLAG), end)).otherwise(WORD)
        return F.when(token.isin(*arguments.PLACEHOLDERS, *arguments.OPERATORS) | known(WORD_MARK, _plain(token)), token).otherwise(hidden)

    def pair(p: Column) -> Column:
        value = F.when(p["words"].isNotNull(), F.array_join(F.transform(p["words"], shown), " ")).otherwise(F.when(_is_command(p["key"], p["value"]) | p["value"].isin(*TYPES), p["value"]).otherwise(WORD))
        return F.struct(F.when(known(KEY_MARK, p["key"]), p["key"]).otherwise(KEY).alias("key"), value.alias("value"), (p["key"] == "subagent_type").alias("kind"))

    rows = s.filter(F.size("__p") > 0).select("skeleton", F.transform("__p", pair).alias("__p"))
    typed_pair = lambda p: F.struct(p["key"].alias("key"), (F.when(p["kind"] & F.col("__type").isNotNull() & (p["value"] == "<str>"), F.col("__type")).otherwise(p["value"])).alias("value"))
    kind = F.when(F.col("public_type"), F.col("subagent_type")) if {"public_type", "subagent_type"} <= set(calls.columns) else F.lit(None).cast("string")
    out = calls.withColumn("__type", kind).join(rows, "skeleton", "left")
    return out.withColumn("released_skeleton", F.when(F.col("__p").isNull(), F.col("skeleton")).otherwise(arguments.skeleton_text(F.transform("__p", typed_pair)))).drop("__p", "__type")


def allowed_labels(values: DataFrame, public: DataFrame, stand_ins: list[str]) -> DataFrame:
    """values: value, with whether it may ship as a program label: public, a public prefix and `<word>`, `<program>` or a listed stand-in."""
    v = values.withColumn("__w", F.regexp_replace("value", r" <word>$", "")).join(public.select(F.col("word").alias("__w"), F.lit(True).alias("__p")), "__w", "left")
    return v.withColumn("allowed", F.coalesce(F.col("__p"), F.lit(False)) | F.col("value").isin(PROGRAM, *stand_ins)).drop("__w", "__p")


def allowed_skeletons(skeletons: DataFrame, keys: DataFrame, words: DataFrame, stand_ins: list[str], types: DataFrame) -> DataFrame:
    """Distinct skeletons with whether they may ship: keys public or `<key>`, values placeholders, public subagent types or commands of
    public words, placeholders, operators and stand-ins; anything but an object or `<unparsed>` may not."""
    from ..functions import arguments

    s = _with_listed(_parsed_skeletons(skeletons), _listed(keys=keys, words=words, types=types), types=True)
    marks = [WORD, PROGRAM, *FLAGS, *stand_ins, *arguments.PLACEHOLDERS, *arguments.OPERATORS]
    known = lambda mark, x: F.array_contains("__known", _marked(mark, x))
    value = lambda p: F.when(p["words"].isNull(), ((p["key"] == "subagent_type") & known(TYPE_MARK, p["value"])) | p["value"].isin(*TYPES)).otherwise(F.forall(p["words"], lambda w: w["token"].isin(*marks) | known(WORD_MARK, _plain(w["token"]))))
    sound = F.forall("__p", lambda p: F.coalesce(((p["key"] == KEY) | known(KEY_MARK, p["key"])) & value(p), F.lit(False)))
    whole = F.coalesce((F.col("skeleton") == "<unparsed>") | arguments.ordered_pairs(F.col("skeleton")).isNotNull(), F.lit(False))
    return s.select("skeleton", (whole & F.coalesce(sound, F.lit(True))).alias("allowed"))


def raw_ids(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct ids of a week's requests (request_id, session_id, user_id) and sessions (session_id, trace_id, user_id): one exploded pass
    over each table."""
    ids = lambda df, *columns: df.select(F.explode(F.array(*columns)).alias("id"))
    return ids(requests, "request_id", "session_id", "user_id").union(ids(sessions, "session_id", "trace_id", "user_id")).filter(F.col("id").isNotNull()).distinct()


def released_name(df: DataFrame, name: str, public: DataFrame) -> DataFrame:
    p = public.select(F.col("word").alias("__w")).withColumn("__p", F.lit(True))
    return df.join(p, F.lower(name) == F.col("__w"), "left").withColumn("released_name", F.when(F.col(name).isNotNull(), F.when(F.col("__p"), F.lower(name)).otherwise("other"))).drop("__w", "__p")


def block_local_ids(reads: DataFrame) -> DataFrame:
    """Dense id of each block by its first read in (session, step, position) order of its week; the rank comes from range partitions."""
    from .tokens import rank_within

    first = reads.groupBy("week", "block_id").agg(F.min(F.struct("session_id", "step", "pos")).alias("f")).select("week", "block_id", "f.*")
    return rank_within(first, "week", ["session_id", "step", "pos", "block_id"], "local_id").select("week", "block_id", "local_id")


def string_values(table: DataFrame, name: str) -> DataFrame:
    """Distinct (table, column, value) of every string and list-of-strings column."""
    parts = []
    for field in table.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "string":
            parts.append(table.select(F.lit(field.name).alias("column"), F.col(field.name).alias("value")))
        elif kind == "array<string>":
            parts.append(table.select(F.lit(field.name).alias("column"), F.explode(field.name).alias("value")))
    return reduce(DataFrame.union, parts).filter(F.col("value").isNotNull()).distinct().withColumn("table", F.lit(name))


def gate(values: DataFrame, raw_ids: DataFrame, allowed: dict[str, Column]) -> DataFrame:
    """Violations: values that hold a raw id of 12 characters or more as a whole, an address, or are not of their column's form."""
    ids = raw_ids.filter(F.length("id") >= RAW_ID_CHARACTERS).select(F.col("id").alias("value")).distinct()
    leaked = values.join(ids, "value", "left_semi").withColumn("violation", F.lit("raw_id"))
    address = values.filter(strings.holds_ip(F.col("value"))).withColumn("violation", F.lit("address"))
    form = reduce(lambda w, kv: w.when(F.col("column") == kv[0], kv[1]), allowed.items(), F.when(F.lit(False), True)).otherwise(True)
    bad = values.filter(~F.coalesce(form, F.lit(False))).withColumn("violation", F.lit("form"))
    cols = ["table", "column", "value", "violation"]
    return leaked.select(*cols).union(address.select(*cols)).union(bad.select(*cols))


def exclusion_reasons(sessions: DataFrame, by_harness: dict[str, str], by_id: DataFrame) -> DataFrame:
    """session_id and why it is left out: its harness, its own entry, else that of its nearest excluded spawner."""
    from .lineage import settled

    own = sessions.join(by_id.select("session_id", F.col("reason").alias("__id")), "session_id", "left")
    h = F.create_map(*(F.lit(x) for kv in by_harness.items() for x in kv))[F.col("harness")] if by_harness else F.lit(None).cast("string")
    s = settled(own.select("session_id", F.col("parent_session_id").alias("up"), F.coalesce(h, F.col("__id")).alias("reason")), "exclusions")
    for _ in range(64):
        open_ = s.filter("reason is null and up is not null")
        if not open_.limit(1).count():
            break
        above = s.select(F.col("session_id").alias("up"), F.col("up").alias("up2"), F.col("reason").alias("reason2"))
        s = settled(s.join(above, "up", "left").select("session_id", F.when(F.col("reason").isNull(), F.col("up2")).alias("up"), F.coalesce("reason", "reason2").alias("reason")), "exclusions")
    return s.filter("reason is not null").select("session_id", "reason")
