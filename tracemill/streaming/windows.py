"""Streaming forms: weekly windows, and rows of another week kept apart and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PARTS = ("week", "other", "undated")
METRICS = "week_rows"


def weekly_counts(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows per Sunday-aligned week. 1970-01-04 was a Sunday, so windows start three days after the epoch."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "7 days", "7 days", "3 days"), *keys).agg(F.count("*").alias("rows"))


def part_of(time: str, week: str) -> Column:
    """Where a row belongs: to the week (a Sunday), to another one, or to none."""
    own = F.date_format(F.date_sub(F.next_day(F.to_date(time), "SUN"), 7), "yyyy-MM-dd") == week
    return F.when(F.col(time).isNull(), "undated").when(own, "week").otherwise("other")


def _counts(part: Column) -> list[Column]:
    return [F.count_if(part == name).alias(name) for name in PARTS]


def observed(stream: DataFrame, time: str, week: str) -> DataFrame:
    """The same rows, with counts of the week's, other weeks' and undated ones in each batch's progress."""
    return stream.observe(METRICS, *_counts(part_of(time, week)))


class WeekRows(StreamingQueryListener):
    """Adds up what `observed` streams count, each batch of a query once however often it is run or told."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(METRICS)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = {name: row[name] for name in PARTS}

    def total(self) -> dict[str, int]:
        return {name: sum(b[name] for b in self.batches.values()) for name in PARTS}


def route_late(stream: DataFrame, path: str, week: str, time: str, checkpoint: str) -> StreamingQuery:
    """Each row once under path/rows/batch=N/part=(week, other or undated), and the batch's counts under path/counts/batch=N, which are written last. A batch
    that runs again, after a failure or a restart, overwrites its own folders and nothing else."""

    def put(batch: DataFrame, number: int) -> None:
        seen = Observation(METRICS)
        part = part_of(time, week)
        batch.observe(seen, *_counts(part)).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows/batch={number}")
        counts = batch.sparkSession.createDataFrame([tuple(seen.get[name] for name in PARTS)], ", ".join(f"{name} long" for name in PARTS))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each part over all finished batches."""
    schema = ", ".join(f"{name} long" for name in PARTS)
    return spark.read.schema(schema + ", batch long").parquet(f"{path}/counts").agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in PARTS))
