"""Rule tables from a user's files: who sent a request, how a result ended, what notes a compaction leaves, what is left out, which words are public.

A file is read through Spark, so it may lie where the data lies, and becomes rows. What is wrong with a table is rows too (`faults`), so a
user sees all of it at once; `checked` stops on any. Texts meet a table as one array of its rows, which is as large as the file: no
chain of conditions grows with it.
"""

from __future__ import annotations

import tomllib
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import strings

ROWS = "table string, place int, name string, field string, text string, reason string"
# fixed values
UNRECOGNISED = "other-agent"
WORD_LISTS = ("names", "programs", "argument_keys", "skeleton_words", "subagent_types", "stand_ins")


class RuleError(ValueError):
    """A rule table must not be used as it is."""


def read_file(spark: SparkSession, path: str) -> dict:
    """A TOML file; its version is no rule."""
    held = tomllib.loads(spark.read.text(path, wholetext=True).first().value)
    held.pop("version", None)
    return held


def _rows(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(table, k, *r) for k, r in enumerate(rows)], ROWS)


def harnesses(spark: SparkSession, path: str) -> DataFrame:
    """A row for each phrase and user agent of each entry, in the file's order."""
    return _rows(spark, "harnesses", [(name, field, text, None) for name, entry in read_file(spark, path).items() for field in ("phrases", "user_agent") for text in entry.get(field, [])])


def compaction_notes(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, "compaction_notes", [(",".join(n.get("harnesses", [])), "phrase", n.get("phrase"), None) for n in read_file(spark, path).get("note", [])])


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Harnesses by name and sessions by their released id, with reasons."""
    held = read_file(spark, path)
    return _rows(spark, "exclusions", [(e.get(key), kind, e.get(key), e.get("reason")) for kind, key in (("harness", "name"), ("session", "id")) for e in held.get(kind, [])])


def public_words(spark: SparkSession, path: str) -> DataFrame:
    """Counted words and those added by hand, by list."""
    held = read_file(spark, path)
    added = held.pop("added", {})
    unknown = sorted({*held, *added} - set(WORD_LISTS))
    if unknown:
        raise RuleError(f"unknown lists of words: {unknown}")
    return _rows(spark, "public_words", [(name, "word", w, None) for name in WORD_LISTS for w in dict.fromkeys([*held.get(name, []), *added.get(name, [])])])


def outcome_rules(spark: SparkSession, path: str) -> strings.OutcomeRules:
    """Markers and lengths by which an outcome is read; every one must be there, and none else."""
    held = read_file(spark, path)
    names = {f.name for f in fields(strings.OutcomeRules)}
    if set(held) != names:
        raise RuleError(f"outcome rules that are missing or unknown: {sorted(set(held) ^ names)}")
    return strings.OutcomeRules(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})


def faults(table: DataFrame) -> DataFrame:
    """table, place, name, text and fault of each rule that is wrong: empty, without a reason, not in lower case where texts are, or what an
    earlier rule of its field and table (of words: of its list) says already."""
    lower = F.col("table").isin("harnesses")
    scope = F.when(F.col("table") == "public_words", F.col("name")).otherwise(F.lit(""))
    first = F.min("place").over(Window.partitionBy("table", "field", scope, "text"))
    found = F.array_compact(F.array(
        F.when(F.coalesce(F.col("text"), F.lit("")) == "", "empty"), F.when((F.col("table") == "exclusions") & (F.coalesce(F.col("reason"), F.lit("")) == ""), "no_reason"), F.when(lower & (F.col("text") != F.lower("text")), "not_lower_case"),
        F.when((F.col("text") != "") & (F.col("place") > F.col("__first")), "repeated"),
    ))
    return table.withColumn("__first", first).select("table", "place", "name", "text", F.explode(found).alias("fault"))


def checked(table: DataFrame) -> DataFrame:
    """The table, if nothing is wrong with it."""
    bad = faults(table).orderBy("place").limit(20).collect()
    if bad:
        raise RuleError("; ".join(f"{r.table}: {r.name} {r.text!r} is {r.fault}" for r in bad))
    return table


def _with_rules(df: DataFrame, table: DataFrame, field: str, name: str) -> DataFrame:
    """df with the table's (place, name, text) of a field as one array."""
    one = table.filter(F.col("field") == field).agg(F.array_sort(F.collect_list(F.struct("place", "name", "text"))).alias(name))
    return df.join(F.broadcast(one), F.lit(True))  # one row, as large as the file


def with_first_phrase(df: DataFrame, text: Column, table: DataFrame, name: str = "first_phrase") -> DataFrame:
    """df with the name of the entry whose phrase starts earliest in the text (of those at one place, the one listed first); null without one."""
    d = _with_rules(df, table, "phrases", "__phrases").withColumn("__text", text)
    found = F.transform(F.filter("__phrases", lambda p: F.contains(F.col("__text"), p["text"])), lambda p: F.struct(F.instr(F.col("__text"), p["text"]).alias("at"), p["place"].alias("place"), p["name"].alias("name")))
    return d.withColumn(name, F.array_min(found)["name"]).drop("__phrases", "__text")


def with_harness(df: DataFrame, text: Column, agent: Column, table: DataFrame, name: str = "harness") -> DataFrame:
    """df with the harness of each request: by earliest phrase, else by the first listed user agent, else other-agent."""
    d = _with_rules(df, table, "user_agent", "__agents").withColumn("__agent", F.lower(agent))
    d = with_first_phrase(d, text, table, "__phrase")
    by_agent = F.get(F.filter("__agents", lambda a: F.contains(F.col("__agent"), a["text"])), 0)["name"]
    return d.withColumn(name, F.coalesce("__phrase", by_agent, F.lit(UNRECOGNISED))).drop("__agents", "__agent", "__phrase")


def with_note(df: DataFrame, texts: Column, table: DataFrame, name: str = "notes") -> DataFrame:
    """df with whether each text of an array holds a compaction note."""
    d = _with_rules(df, table, "phrase", "__notes").withColumn("__texts", texts)
    return d.withColumn(name, F.transform("__texts", lambda t: F.exists(F.col("__notes"), lambda n: F.contains(t, n["text"])))).drop("__notes", "__texts")


def reasons_excluded(sessions: DataFrame, table: DataFrame, released_id: Column) -> DataFrame:
    """sessions with why each is left out by the table: its harness's reason, else that of its released id; null if it stays."""
    of = lambda kind, key: table.filter(F.col("field") == kind).select(F.col("text").alias(key), F.col("reason").alias(f"__{kind}"))
    s = sessions.withColumn("__released", released_id).join(of("harness", "harness"), "harness", "left").join(of("session", "__released"), "__released", "left")
    return s.withColumn("reason", F.coalesce("__harness", "__session")).select(*sessions.columns, "reason")
