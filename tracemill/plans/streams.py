"""Queries of streams over the given tables, read as several files in micro-batches, and of the ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import lineage
from ..sources import ledger
from ..streaming import linking, windows
from .more import _IN, inputs
from .registry import query, table


@query("T3_stream_links", "WITH " + _IN + " SELECT * FROM x_link", fixture=False)
def _(s, d):
    """The links of C1, with state over micro-batches of requests in no order; a last row far ahead moves the watermark past all."""
    path = lineage.new_path(s, "stream-links")
    signals = inputs(s, d).select("request_id", "user_id", "end_ms", "emitted_ids", "replayed_ids", "answer_shingles", "replayed_shingles")
    signals.repartition(3, F.col("request_id")).write.parquet(f"{path}/in")
    none = F.array().cast("array<string>")
    past = s.range(1, 3).select(F.concat(F.lit("past-"), "id").alias("request_id"), F.lit("past").alias("user_id"), (F.lit(10**12) * F.col("id")).alias("end_ms"), *(none.alias(c) for c in signals.columns[3:]))
    for k in (1, 2):
        past.filter(F.col("id") == k).drop("id").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = s.readStream.schema(signals.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = linking.linked(stream, "3650 days").writeStream.option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(linking.LINKS).parquet(f"{path}/out").filter(~F.startswith("request_id", F.lit("past-")))


@query("T2_rows_of_other_weeks", "SELECT count(*) FILTER (WHERE user_id % 7 > 0 AND week = (SELECT max(week) FROM fx_e)) AS week, count(*) FILTER (WHERE user_id % 7 > 0 AND week <> (SELECT max(week) FROM fx_e)) AS other, count(*) FILTER (WHERE user_id % 7 = 0) AS undated FROM fx_e")
def _(s, d):
    """Counts of the stream's batches, after the last batch was run a second time."""
    path = lineage.new_path(s, "stream-weeks")
    e = table(s, d, "events").select("event_id", F.when(F.col("user_id") % 7 > 0, F.col("ts").cast("timestamp")).alias("ts"))
    last = table(s, d, "events").agg(F.date_format(F.date_sub(F.next_day(F.to_date(F.max("ts")), "SUN"), 7), "yyyy-MM-dd")).first()[0]
    e.repartition(3).write.parquet(f"{path}/in")
    stream = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    windows.route_late(stream, f"{path}/out", last, "ts", f"{path}/checkpoint").awaitTermination()
    _forget_last_batch(s, f"{path}/checkpoint/commits")
    windows.route_late(stream, f"{path}/out", last, "ts", f"{path}/checkpoint").awaitTermination()
    return windows.late_counts(s, f"{path}/out")


def _forget_last_batch(s, commits: str) -> None:
    """Takes away the mark that the last batch is done, as if the run had died before it."""
    folder = s._jvm.org.apache.hadoop.fs.Path(commits)
    files = folder.getFileSystem(s._jsparkSession.sessionState().newHadoopConf())
    last = max((f.getPath() for f in files.listStatus(folder) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    files.delete(last, True)


_OUTPUTS = [ledger.Output("report", ("links", "calls"), "1"), ledger.Output("links", ("log",), "1"), ledger.Output("calls", ("log", "rules"), "1")]


@query("T4_work_list", """x_w AS (SELECT DISTINCT week, week = (SELECT max(week) FROM fx_e) AS changed, week = (SELECT min(week) FROM fx_e) AS lost FROM fx_e)
    SELECT week, output, CASE WHEN lost AND output <> 'links' THEN 'blocked' ELSE 'stale' END AS status FROM (SELECT *, unnest(['links', 'calls', 'report']) AS output FROM x_w) WHERE changed OR (lost AND output <> 'links') OR output IN ('calls', 'report')""")  # fmt: skip
def _(s, d):
    """All was made once. Then the last week's log changes, the first week's rules are lost, and the operator of calls gets a new version: links of other weeks stay."""
    weeks = fx.base_requests(s, d).groupBy("week").agg(F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).cast("string").alias("sum"))
    source = lambda name, digest: weeks.select("week", F.lit(name).alias("source"), F.sha2(digest, 256).alias("sha256"))
    sources = source("log", F.col("sum")).union(source("rules", F.lit("rules")))
    path = f"{lineage.new_path(s, 'ledger')}/{uuid.uuid4().hex}"
    ledger.commit(ledger.work_list(sources, _OUTPUTS, ledger.read_ledger(s, path)), path)
    first, last = weeks.agg(F.min("week"), F.max("week")).first()
    now = sources.filter((F.col("week") != first) | (F.col("source") != "rules")).withColumn("sha256", F.when((F.col("week") == last) & (F.col("source") == "log"), "other").otherwise(F.col("sha256")))
    outputs = [*_OUTPUTS[:2], ledger.Output("calls", ("log", "rules"), "2")]
    return ledger.work_list(now, outputs, ledger.read_ledger(s, path)).select("week", "output", "status")
