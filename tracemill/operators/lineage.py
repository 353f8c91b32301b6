"""Sessions from raw requests: parent links, chains, spawned sessions and closures."""

from __future__ import annotations

import heapq
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values
LOOKBACK = 128
SHARED_TENTHS = 9
SPAWN_BEFORE_MS, SPAWN_AFTER_MS = 30_000, 600_000
TOOL_OUTPUT_KINDS = ("tool_result", "tool_text")


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, a temporary folder serves in local mode alone; a
    cluster's machines would each write to their own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """The rows as a written table, with lineage cut."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def links(signals: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Parent of each request among the account's `lookback` requests before it: the nearest that emitted a tool-call id it
    replays, else the nearest whose answer's phrases it holds to nine tenths. signals: request_id, user_id, end_ms,
    emitted_ids, replayed_ids, answer_shingles, replayed_shingles. A null account is one account. A repeated
    request_id is an error."""
    from .tokens import rank_within

    # ids and times alone are ranked, in ranges of them: an account with a third of all requests is ranked by many tasks
    slim = signals.select("request_id", F.coalesce("user_id", F.lit("\x00")).alias("account"), "end_ms")
    ranked = rank_within(slim, "account", ["end_ms", "request_id"], "rn").select("request_id", "account", (F.col("rn") + 1).alias("rn"))
    same = F.count("*").over(Window.partitionBy("request_id"))
    ranked = ranked.withColumn("rn", F.when(same > 1, F.raise_error(F.concat(F.lit("repeated request_id "), "request_id")).cast("int")).otherwise(F.col("rn").cast("int")))
    # read five times below, so its phrases are made once
    s = settled(signals.select("request_id", "emitted_ids", "replayed_ids", "answer_shingles", "replayed_shingles").join(ranked, "request_id"), "ranked-signals")
    near = (F.col("c.rn") - F.col("p.rn")).between(1, lookback)
    # parents stand in the child's band of numbers or the one before, so a common key meets few rows at a time
    band = F.floor(F.col("rn") / lookback).cast("int")

    def exploded(rows: DataFrame, array: str, alias: str, *more) -> DataFrame:
        bands = F.array(band) if alias == "p" else F.array(band, band - 1)
        return rows.select("request_id", "account", "rn", *more, F.explode(F.array_distinct(array)).alias("key"), bands.alias("bands")).withColumn("band", F.explode("bands")).drop("bands").alias(alias)

    on = (F.col("c.account") == F.col("p.account")) & (F.col("c.key") == F.col("p.key")) & (F.col("c.band") == F.col("p.band")) & near
    tool = exploded(s, "replayed_ids", "c").join(exploded(s, "emitted_ids", "p"), on).groupBy(F.col("c.request_id").alias("request_id")).agg(F.max_by(F.col("p.request_id"), F.col("p.rn")).alias("tool_parent"))
    child = exploded(s.join(tool, "request_id", "left_anti"), "replayed_shingles", "c")
    parent = exploded(s, "answer_shingles", "p", F.size(F.array_distinct("answer_shingles")).alias("size"))
    shared = child.join(parent, on).groupBy(F.col("c.request_id").alias("request_id"), F.col("p.request_id").alias("parent"), F.col("p.rn").alias("prn")).agg(F.count("*").alias("n"), F.first("p.size").alias("size"))
    text = shared.filter(10 * F.col("n") >= SHARED_TENTHS * F.col("size")).groupBy("request_id").agg(F.max_by("parent", "prn").alias("text_parent"))
    out = s.select("request_id").join(tool, "request_id", "left").join(text, "request_id", "left")
    return out.select("request_id", F.coalesce("tool_parent", "text_parent").alias("parent_request_id"), F.when(F.col("tool_parent").isNotNull(), "tool_id").when(F.col("text_parent").isNotNull(), "text").alias("link"))


def roots(nodes: DataFrame, node: str = "request_id", parent: str = "parent_request_id") -> DataFrame:
    """node, root and depth by pointer doubling: a logarithm of the depth in self joins, each written out. A pointer to a node
    that is not there ends at that node; a cycle is an error."""
    n = nodes.count()
    p = settled(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"), F.col(node).alias("root")), "pointers")
    p = p.withColumn("root", F.coalesce("up", "root"))
    for _ in range(64):
        p = settled(p, "pointers")
        if not p.filter("up is not null").limit(1).count():
            break
        # no path is longer than there are nodes, but the doubled jumps of a cycle are
        if p.agg(F.max("depth")).first()[0] > n:
            raise ValueError(f"{parent} holds a cycle, at {p.filter(F.col('depth') > n).first().node}")
        above = p.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        p = p.join(above, "up", "left").select("node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root"))
    return p.select(F.col("node").alias(node), "root", "depth")


def chains(requests: DataFrame) -> DataFrame:
    """requests: request_id, parent_request_id, link, end_ms, harness, new_content_kind. Session, step, main chain, turn and
    agent flag of each. The main chain is the path to the deepest request (later end, then greater id)."""
    r = roots(requests).withColumnRenamed("root", "session_id").withColumnRenamed("depth", "step")
    r = settled(requests.join(r, "request_id"), "chains")
    tip = r.groupBy("session_id").agg(F.max_by("request_id", F.struct("step", "end_ms", "request_id")).alias("tip"))
    on_chain = ancestors(r.select("request_id", "parent_request_id"), tip.select(F.col("tip").alias("request_id")))
    turn = F.when(F.col("link") == "tool_id", "tool").when((F.col("link") == "text") & F.col("new_content_kind").isin(*TOOL_OUTPUT_KINDS), "tool").otherwise("user")
    r = r.join(on_chain.withColumn("on_main_chain", F.lit(True)), "request_id", "left").withColumn("on_main_chain", F.coalesce("on_main_chain", F.lit(False)))
    r = r.withColumn("turn", F.when(F.col("on_main_chain"), turn))
    flags = r.groupBy("session_id").agg(F.count_if(F.col("turn") == "tool").alias("t"), F.count_if(F.col("turn") == "user").alias("u"), F.max_by("harness", -F.col("step")).alias("h"))
    agent = (F.col("t") >= 1) & ((F.col("h") == "eval:swe-bench") | (F.col("u") >= 2))
    return r.join(flags.select("session_id", agent.alias("is_agent_session")), "session_id").select("request_id", "session_id", "step", "on_main_chain", "turn", "is_agent_session")


def ancestors(pointers: DataFrame, tips: DataFrame) -> DataFrame:
    """The tips and everything above them, by jumps that double: those reached so far reach on through the 2^k-th ancestors."""
    jump = settled(pointers.select(F.col("request_id").alias("node"), F.col("parent_request_id").alias("up")).filter("up is not null"), "jumps")
    reached = settled(tips.select(F.col("request_id").alias("node")).distinct(), "reached")
    while jump.limit(1).count():
        reached = settled(reached.union(reached.join(jump, "node").select(F.col("up").alias("node"))).distinct(), "reached")
        further = jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up"))
        jump = settled(further, "jumps")
    return reached.select(F.col("node").alias("request_id"))


def spawn_candidates(spawns: DataFrame, session_roots: DataFrame, before_ms: int = SPAWN_BEFORE_MS, after_ms: int = SPAWN_AFTER_MS) -> DataFrame:
    """Spawn calls with the session roots of the account that may be their child, in arrival range and of another session. Accounts
    join with time buckets as wide as the range, so a busy account is not one group."""
    width = before_ms + after_ms
    c = spawns.filter(F.col("user_id").isNotNull()).withColumn("b", F.explode(F.sequence(F.floor((F.col("end_ms") - before_ms) / width), F.floor((F.col("end_ms") + after_ms) / width))))
    r = session_roots.filter(F.col("user_id").isNotNull()).select("user_id", F.col("session_id").alias("child"), F.col("start_ms").alias("child_start"), "first_user_text", F.floor(F.col("start_ms") / width).alias("b"))
    in_range = F.col("child_start").between(F.col("end_ms") - before_ms, F.col("end_ms") + after_ms) & (F.col("child") != F.col("session_id"))
    return c.join(r, ["user_id", "b"]).filter(in_range).drop("b")


def match_spawns(spawns: DataFrame, session_roots: DataFrame, before_ms: int = SPAWN_BEFORE_MS, after_ms: int = SPAWN_AFTER_MS) -> DataFrame:
    """Each spawn call's child: the nearest unclaimed candidate whose first text contains the opening, in completion order.
    Only text matches go to the greedy step. Spawns of an account that are further apart than the range share no
    candidate, so an account is cut into islands, and the step streams each island's rows in order, which Spark sorts and
    spills, holding only claimed children that later spawns may still reach."""
    c = spawn_candidates(spawns, session_roots, before_ms, after_ms)
    n = c.groupBy("session_id", "request_id", "call_index").agg(F.count("*").alias("n_candidates"))
    fit = c.filter(F.col("opening").isNotNull() & (F.col("opening") != "") & F.contains("first_user_text", "opening")).select("user_id", "session_id", "request_id", "call_index", "end_ms", "child", "child_start")
    last = session_roots.groupBy("user_id", F.col("session_id").alias("child")).agg(F.max("start_ms").alias("last_start"))
    # an island is a run of occupied time buckets as wide as the range
    width = before_ms + after_ms
    fit = fit.withColumn("bucket", F.floor(F.col("end_ms") / width))
    by_user = Window.partitionBy("user_id").orderBy("bucket")
    islands = fit.select("user_id", "bucket").distinct().withColumn("new", F.when(F.col("bucket") - F.lag("bucket").over(by_user) == 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_user)).drop("new")
    fit = fit.join(islands, ["user_id", "bucket"]).join(last, ["user_id", "child"]).select("user_id", "island", "end_ms", "request_id", "call_index", F.abs(F.col("child_start") - F.col("end_ms")).alias("d"), "child_start", "child", "session_id", "last_start")

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = key = session = None
        taken, reach, claimed = set(), [], False
        for batch in batches:
            out = []
            for u, island, end, request, call, _, _, child, of, until in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (u, island) != place:
                    place, key, taken, reach = (u, island), None, set(), []
                if (end, request, call) != key:
                    key, session, claimed = (end, request, call), of, False
                    while reach and reach[0][0] < end - before_ms:
                        taken.discard(heapq.heappop(reach)[1])
                if not claimed and child not in taken:
                    claimed = True
                    taken.add(child)
                    heapq.heappush(reach, (until, child))
                    out.append((session, request, call, child))
            yield pa.RecordBatch.from_pylist([dict(zip(won_as.names, x, strict=True)) for x in out], schema=won_as)

    won_as = pa.schema([("session_id", pa.string()), ("request_id", pa.string()), ("call_index", pa.int32()), ("child_session_id", pa.string())])
    ordered = fit.repartition("user_id", "island").sortWithinPartitions("user_id", "island", "end_ms", "request_id", "call_index", "d", "child_start", "child")
    won = ordered.mapInArrow(claim, "session_id string, request_id string, call_index int, child_session_id string")
    keys = ["session_id", "request_id", "call_index"]
    return spawns.select(*keys, F.col("opening").isNotNull().alias("has_prompt")).join(n, keys, "left").join(won, keys, "left").fillna(0, ["n_candidates"])


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """start (session_id) and every session reached over edges (parent, child); cycles end by the visited set."""
    seen = settled(start.select("session_id").distinct(), "closure")
    new = seen
    while True:
        new = settled(edges.join(new, F.col("parent") == F.col("session_id"), "left_semi").select(F.col("child").alias("session_id")).distinct().join(seen, "session_id", "left_anti"), "closure")
        if not new.limit(1).count():
            return seen
        seen = settled(seen.union(new), "closure")


def unreached(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """Sessions that no top-level session reaches."""
    top = sessions.filter(F.col("parent_session_id").isNull())
    return sessions.select("session_id").join(closure(top, edges), "session_id", "left_anti")
