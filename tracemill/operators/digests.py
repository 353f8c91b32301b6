"""Digest job: what each request sent, as counts and hashes instead of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rendering, strings
from ..sources import bodies

# fixed values
ROLES = ("system", "user", "assistant", "tool", "tool_definitions")


def word_tokens(texts: Column) -> Column:
    return F.transform(texts, strings.words)


def request_digests(requests: DataFrame, salt: str = "", tokens: Callable[[Column], Column] = word_tokens, notes: tuple[str, ...] = (), system: Column | None = None, tools: Column | None = None) -> DataFrame:
    """requests: request_id, prompt. Of each request's entries as rendered: roles, counts of tokens, salted hashes, whether an entry holds a
    compaction note (tool definitions never do); the chained block hashes of all its tokens, and the names of its tools (null for one without).

    tokens: from an array of texts to an array of their tokens. A request is a row from end to end: nothing is shuffled."""
    null = F.lit(None).cast("string")
    system, tools = (null if c is None else c for c in (system, tools))
    d = requests.withColumn("__e", rendering.input_entries(F.col("prompt"), system, tools)).withColumn("__t", tokens(F.transform("__e", lambda e: e["text"])))
    noted = lambda e: (e["role"] != "tool_definitions") & (F.exists(F.array(*map(F.lit, notes)), lambda n: F.contains(e["text"], n)) if notes else F.lit(False))
    return d.select(
        "request_id", F.transform("__e", lambda e: e["role"]).alias("roles"), F.transform("__t", lambda t: F.size(t).cast("long")).alias("tokens"), F.transform("__e", lambda e: F.sha2(F.concat(F.lit(salt), e["text"]), 256)).alias("hashes"),
        F.transform("__e", noted).alias("notes"), strings.chained_blocks(F.flatten("__t"), salt).alias("block_hashes"), F.coalesce(bodies.tool_names(tools), bodies.tool_names(F.col("prompt"), "$.tools")).alias("tool_definition_names"),
    )


def input_facts(digests: DataFrame) -> DataFrame:
    """Of each request: messages (tool definitions are none), tokens of each role as a map and of an unknown role null, and its tools' names.
    A request with an entry of another role is told by unknown_role, the first such."""
    pairs = F.arrays_zip("roles", "tokens")
    of = lambda role: F.aggregate(F.filter(pairs, lambda p: p["roles"] == role), F.lit(0).cast("long"), lambda n, p: n + p["tokens"])
    by_role = F.create_map(*(x for r in ROLES for x in (F.lit(r), of(r))))
    return digests.select("request_id", F.size(F.filter("roles", lambda r: r != "tool_definitions")).cast("long").alias("n_messages"), by_role.alias("role_tokens"), "tool_definition_names", F.get(F.filter("roles", lambda r: ~r.isin(*ROLES)), 0).alias("unknown_role"))
