"""Context transitions: classification of consecutive inputs, and what mutations cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens, whatif
from .lineage import settled

# fixed values
TABLE_ROWS = ("append", "mutation", "injection", "system_prompt", "tool_definitions", "dropped_turns", "compaction", "tool_result", "other")


def transition_rows(requests: DataFrame, misses: DataFrame) -> DataFrame:
    r = requests.filter(F.col("transition").isNotNull() & (F.col("transition") != "switch"))
    r = r.select("session_id", "step", "transition", "cause", tokens.hit_ratio().alias("hit_ratio"))
    return r.join(misses.select("session_id", "step", "missed_tokens"), ["session_id", "step"], "left")


def mutation_table(rows: DataFrame) -> DataFrame:
    """Share of steps, sessions and missed tokens per transition and cause; append's sessions are those without any mutation.

    A mutation counts in its transition's row and in its cause's, so each row gives an array of names."""
    names = F.array_compact(F.array("transition", "cause"))
    total = rows.agg(F.count("*").alias("steps"), F.count_distinct("session_id").alias("sessions"), F.sum("missed_tokens").alias("missed"), F.count_distinct(F.when(F.col("transition") == "mutation", F.col("session_id"))).alias("mutated"))
    g = rows.select("session_id", "missed_tokens", F.explode(names).alias("row")).groupBy("row").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("s"), F.sum("missed_tokens").alias("m"))
    all_rows = rows.sparkSession.createDataFrame([(r,) for r in TABLE_ROWS], "row string")
    t = all_rows.join(g, "row", "left").join(F.broadcast(total), F.lit(True))
    sessions = F.when(F.col("row") == "append", F.col("sessions") - F.col("mutated")).otherwise(F.coalesce("s", F.lit(0)))
    return t.select("row", (F.coalesce("n", F.lit(0)) / F.col("steps")).alias("steps_share"), (sessions / F.col("sessions")).alias("sessions_share"), F.try_divide(F.coalesce("m", F.lit(0)), "missed").alias("prefill_share"))


def hit_ratio_after(rows: DataFrame) -> DataFrame:
    return rows.groupBy("transition").agg(F.percentile("hit_ratio", F.lit(0.5)).alias("median_hit_ratio"))


def transition_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("cause", "transition").alias("kind")).agg(F.count("*").alias("n"))


def one_span_apart(a: Column, b: Column) -> Column:
    """Whether the shorter text is the longer one without one span: a prefix of it and a suffix."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    prefix = whatif.common_prefix(F.split(short, ""), F.split(long, ""))
    return F.when(F.length(short) == 0, True).otherwise(F.endswith(long, F.substring(short, prefix + 1, F.length(short))))


def classify(inputs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """inputs: session_id, step, model, provider, roles, hashes, notes (arrays). One row for each step after the first of
    its session: transition, cause by the first rule that holds, and the break position.

    Only where two user messages meet at the break do texts count: they are looked up in texts (session_id, hash, text) for those rows
    alone, so no input carries the texts of its context. Without it, inputs has an array texts of its own."""
    w = Window.partitionBy("session_id").orderBy("step")
    p = inputs
    for c in ("model", "provider", "roles", "hashes", "notes", *(("texts",) if texts is None else ())):
        p = p.withColumn(f"b_{c}", F.lag(c).over(w))
    p = p.filter(F.col("b_hashes").isNotNull()).withColumn("at", whatif.common_prefix(F.col("b_hashes"), F.col("hashes")))
    at = F.col("at")
    get = lambda c: F.get(c, at)
    tail = lambda c, k: F.slice(c, at + 1 + k, F.greatest(F.size(c) - at - k, F.lit(0)))
    any_note = lambda c: F.exists(tail(c, 0), lambda n: n)
    cause = (
        F.when(any_note("notes") & ~any_note("b_notes"), "compaction")
        .when((get("b_roles") == "tool_definitions") | F.coalesce(get("roles") == "tool_definitions", F.lit(False)), "tool_definitions")
        .when(get("b_roles") == "system", "system_prompt")
        .when(at == F.size("hashes"), "other")
        .when(F.array_contains(tail("b_hashes", 1), get("hashes")), "dropped_turns")
        .when(F.array_contains(tail("hashes", 1), get("b_hashes")), "injection")
        .when((get("b_roles") == "tool") & (get("roles") == "tool"), "tool_result")
        .when((get("b_roles") == "user") & (get("roles") == "user"), ASK_TEXTS)
        .otherwise("other")
    )
    kind = F.when(~F.col("model").eqNullSafe(F.col("b_model")) | ~F.col("provider").eqNullSafe(F.col("b_provider")), "switch").when(at == F.size("b_hashes"), "append").otherwise("mutation")
    p = p.withColumn("transition", kind).withColumn("cause", F.when(F.col("transition") == "mutation", cause))
    held = (get("b_hashes"), get("hashes")) if texts is not None else (get("b_texts"), get("texts"))
    p = p.select("session_id", "step", "transition", "cause", at.alias("break_position"), *(F.when(F.col("cause") == ASK_TEXTS, x).alias(name) for x, name in zip(held, ("b", "a"), strict=True)))
    by_text = lambda before, now: F.when(F.coalesce(one_span_apart(before, now), F.lit(False)), "injection").otherwise("other")
    if texts is None:
        return p.withColumn("cause", F.when(F.col("cause") == ASK_TEXTS, by_text(F.col("b"), F.col("a"))).otherwise(F.col("cause"))).drop("a", "b")
    p = settled(p, "transitions")
    of = lambda name: texts.select("session_id", F.col("hash").alias(name), F.col("text").alias(f"text_{name}")).dropDuplicates(["session_id", name])
    asked = p.filter(F.col("cause") == ASK_TEXTS).join(of("b"), ["session_id", "b"], "left").join(of("a"), ["session_id", "a"], "left").withColumn("cause", by_text(F.col("text_b"), F.col("text_a")))
    told = p.filter(F.col("cause").isNull() | (F.col("cause") != ASK_TEXTS))
    return told.drop("a", "b").unionByName(asked.select("session_id", "step", "transition", "cause", "break_position"))


#: Stands for a cause until the two texts are compared.
ASK_TEXTS = "?"
