"""Quality rules with host-level verdicts, in DataFrame functions alone.

Every document gets counts and a verdict of its own rules (base_failed). Failures are then
aggregated by host, each host's failure rate is shrunk towards the rate of all hosts with a beta
prior fitted to them, and the host's verdict is joined back: a document is kept if its own rules
pass and its host's shrunk rate is below the limit.

Defined results: a null text has no words (so it fails the base rules); null hosts form one host;
repeated rows are judged each; an empty table gives an empty table; other columns are carried along
if asked for and never clash, for all own columns live in one struct until the end. Texts are read
whole; the work on a text grows as n log n with its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected from this shrunk failure rate on.
MAX_HOST_RATE = 0.6
#: Strength of the prior (in documents) where the hosts' rates do not differ enough to fit one.
PRIOR_DOCUMENTS = 20.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(grams: Column) -> Column:
    """grams: sorted structs (h, i) of the 3-word windows. Words covered by windows that occur twice or more."""
    same = lambda g, at: F.coalesce(F.get(grams, at)["h"] == g["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(grams, lambda g, j: same(g, j + 1) | ((j > 0) & same(g, j - 1))), lambda g: g["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column __rules of the five counts and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    df = docs.withColumn("__w", words_of(F.col(text))).withColumn("__l", lines)
    n = F.size("__w")
    w = F.col("__w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("__g", F.sort_array(grams))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__g")).alias("n_repeat_words"),
    )
    df = df.withColumn("__c", counts).drop("__w", "__l", "__g")
    failed = (F.col("__c.n_words") < MIN_WORDS) | (100 * F.col("__c.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__c.n_words"))
    return df.withColumn("__rules", F.struct("__c.*", failed.alias("base_failed"))).drop("__c")


def host_rates(ruled: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, failures, and the failure rate shrunk by a beta prior fitted by moments to all hosts."""
    hosts = ruled.groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n"), F.count_if(F.col("__rules.base_failed")).alias("failed"))
    hosts = stored(hosts, "host-rates")
    m, v, mean_part = hosts.agg(F.avg(F.col("failed") / F.col("n")), F.var_samp(F.col("failed") / F.col("n")), F.avg(1 / F.col("n"))).first()
    m = 0.0 if m is None else m
    # the rates differ by chance as well: m(1-m)/n of their variance
    between = (v or 0.0) - m * (1 - m) * (mean_part or 0.0)
    strength = max(1.0, m * (1 - m) / between - 1) if between > 0 else PRIOR_DOCUMENTS
    strength = min(strength, 1e6)
    return hosts.withColumn("host_rate", (F.col("failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength)))


def quality_rules(docs: DataFrame, columns: list[str], host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """columns of docs, and a struct __rules: the counts, base_failed, host_rate and kept.

    The counts are stored once and used twice: by host and by document. The hosts are joined by
    Spark's own choice, so their table is broadcast only below spark.sql.autoBroadcastJoinThreshold."""
    need = list(dict.fromkeys([*columns, host, text]))
    ruled = with_counts(docs.select(*need), text)
    ruled = stored(ruled.select(*dict.fromkeys([*columns, host]), "__rules"), "rules")
    rates = host_rates(ruled, host).select("__host", "host_rate")
    joined = ruled.join(rates, F.col(host).eqNullSafe(F.col("__host")), "left")
    kept = ~F.col("__rules.base_failed") & (F.col("host_rate") < max_host_rate)
    return joined.select(*columns, F.struct("__rules.*", "host_rate", kept.alias("kept")).alias("__rules"))
