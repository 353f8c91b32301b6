"""Nested trace lines: one JSON line a top-level session, spawned sessions nested under their call, and back.

A session line cannot be given one Spark type, for it holds itself; both ways go level by level over
VARIANT, from the deepest sessions up or from the lines down, until a level is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators.lineage import new_path, settled


def _depths(sessions: DataFrame) -> DataFrame:
    known = sessions.filter(F.col("parent_session_id").isNull()).select("session_id", F.lit(0).alias("depth"))
    levels, level, d = [known], known, 0
    while True:
        d += 1
        level = settled(sessions.join(level.select(F.col("session_id").alias("parent_session_id")), "parent_session_id", "left_semi").select("session_id", F.lit(d).alias("depth")), "depths")
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def _by_depth(rows: DataFrame, depths: DataFrame, what: str) -> DataFrame:
    """The sessions' rows, made once and written in a folder a depth, so that each level reads its own."""
    path = new_path(rows.sparkSession, what)
    out = rows.join(depths.select("session_id", F.col("depth").alias("__depth")).distinct(), "session_id")
    out.write.partitionBy("__depth").parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def nest(sessions: DataFrame, requests: DataFrame, calls: DataFrame) -> DataFrame:
    """day, start_ms, session_id, line of every top-level session. sessions: session_id, harness, user_id, parent_session_id,
    spawned_by_step, spawned_by_call_index. Other columns of requests and calls are written as they are."""
    sessions = settled(sessions, "given-sessions")
    depths = settled(sessions.join(_depths(sessions), "session_id"), "sessions")
    deepest = depths.agg(F.max("depth")).first()[0]
    requests, calls = _by_depth(requests, depths, "requests"), _by_depth(calls, depths, "calls")
    keys = ["session_id", "step"]
    own = [c for c in calls.columns if c not in (*keys, "__depth")]
    request_fields = [c for c in requests.columns if c not in ("session_id", "__depth")]
    below = None
    for d in range(deepest or 0, -1, -1):
        level = depths.filter(F.col("depth") == d)
        at_depth = F.col("__depth") == d
        c = calls.filter(at_depth).drop("__depth")
        c = c.join(below, ["session_id", "step", "call_index"], "left") if below is not None else c.withColumn("subagent", F.lit(None).cast("string"))
        c = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("call_index", *(x for x in own if x != "call_index"), F.parse_json("subagent").alias("subagent")).alias("c")), lambda a, b: a["call_index"] - b["call_index"]).alias("tool_calls"))
        r = requests.filter(at_depth).drop("__depth").join(c, keys, "left")
        r = r.groupBy("session_id").agg(F.min("start_ms").alias("start"), F.array_sort(F.collect_list(F.struct("step", *(x for x in request_fields if x != "step"), "tool_calls")), lambda a, b: a["step"] - b["step"]).alias("requests"))
        s = level.join(r, "session_id").withColumn("line", F.to_json(F.struct("session_id", "harness", "user_id", "requests")))
        below = settled(s.select(F.col("parent_session_id").alias("session_id"), F.col("spawned_by_step").alias("step"), F.col("spawned_by_call_index").alias("call_index"), F.col("line").alias("subagent"), F.col("start").alias("__start"), F.col("session_id").alias("__id")), "nested")
        top = below
        below = below.drop("__start", "__id")
    return top.select(F.to_date(F.timestamp_millis("__start")).alias("day"), F.col("__start").alias("start_ms"), F.col("__id").alias("session_id"), F.col("subagent").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder a day, lines in order of start and session."""
    lines.repartition("day").sortWithinPartitions("day", "start_ms", "session_id").select("day", F.col("line").alias("value")).write.partitionBy("day").text(path)


def _fields(spark, schema: str, leave_out: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], schema).schema.fields if f.name not in leave_out]


def flatten(lines: DataFrame, line: str = "value", requests: str = schemas.REQUESTS, calls: str = schemas.TOOL_CALLS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """sessions, requests and calls of nested lines with the columns of the schemas given, and the lines that hold no session (not an
    object, or without session_id)."""
    get = lambda v, p, t: F.try_variant_get(v, p, t)
    spark = lines.sparkSession
    of_request, of_call = _fields(spark, requests, ("session_id",)), _fields(spark, calls, ("session_id", "step"))
    parsed = lines.select(F.col(line).alias("__line"), F.try_parse_json(line).alias("v")).withColumn("session_id", get(F.col("v"), "$.session_id", "string"))
    bad = parsed.filter(F.col("session_id").isNull()).select(F.col("__line").alias("line"))
    none = F.lit(None)
    level = parsed.filter(F.col("session_id").isNotNull()).select("session_id", "v", none.cast("string").alias("parent_session_id"), none.cast("int").alias("spawned_by_step"), none.cast("int").alias("spawned_by_call_index"))

    def call(c):
        v = get(c, "$.subagent", "variant")
        below = F.when(get(v, "$.session_id", "string").isNotNull(), F.to_json(v))
        return F.struct(F.struct(*(get(c, f"$.{name}", kind).alias(name) for name, kind in of_call)).alias("row"), get(c, "$.call_index", "int").alias("place"), below.alias("below"))

    out: list[list[DataFrame]] = [[], [], []]
    while True:
        # a level is read once: a row a request with its session's facts, typed fields and calls; what is nested in these goes on as text
        session = F.struct("session_id", get(F.col("v"), "$.harness", "string").alias("harness"), get(F.col("v"), "$.user_id", "string").alias("user_id"), "parent_session_id", "spawned_by_step", "spawned_by_call_index")
        # rows of requests carry no line
        rows = level.select(session.alias("s"), get(F.col("v"), "$.requests", "array<variant>").alias("q")).select("s", F.posexplode_outer("q").alias("at", "r"))
        typed = F.struct(*(get(F.col("r"), f"$.{name}", kind).alias(name) for name, kind in of_request))
        rows = settled(rows.select("s", "at", typed.alias("r"), get(F.col("r"), "$.step", "int").alias("step"), F.transform(get(F.col("r"), "$.tool_calls", "array<variant>"), call).alias("calls")), "level")
        if not rows.limit(1).count():
            break
        out[0].append(rows.filter("at is null or at = 0").select("s.*"))
        out[1].append(rows.filter("at is not null").select("s.session_id", "r.*"))
        c = rows.select("s.session_id", "step", F.explode("calls").alias("c"))
        out[2].append(c.select("session_id", "step", "c.row.*"))
        sub = c.filter("c.below is not null").withColumn("v", F.parse_json("c.below"))
        level = sub.select(get(F.col("v"), "$.session_id", "string").alias("session_id"), "v", F.col("session_id").alias("parent_session_id"), F.col("step").alias("spawned_by_step"), F.col("c.place").alias("spawned_by_call_index"))
    return (*(reduce(DataFrame.unionByName, x) for x in out), bad)


def find_weeks(tables: DataFrame, asked: list[str], column: str = "week") -> DataFrame:
    """The asked weeks that are not there."""
    wanted = tables.sparkSession.createDataFrame([(w,) for w in asked], f"{column} string")
    return wanted.join(tables.select(column).distinct(), column, "left_anti")


def checked_files(spark, path: str, manifest: DataFrame) -> DataFrame:
    """Files whose sha256 is not that of the manifest (path, sha256), or that are missing."""
    held = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("found"))
    return manifest.join(held, "path", "full").filter(~F.col("sha256").eqNullSafe(F.col("found")))
