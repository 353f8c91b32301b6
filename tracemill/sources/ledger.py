"""What each output was made from, and what is stale.

An output's fingerprint is a digest of its operator's version and of what it is made from: digests of source files and fingerprints of
other outputs. So a changed file or version changes the fingerprints of all that depends on it and of nothing else, and what is
stale is what the ledger does not hold under its present fingerprint.

The ledger is a table under a path. A commit writes its rows as new files and then creates the file `_commits/N` that names them, which a
file system does for one writer only; readers see the files of the commits. A run that dies before that leaves nothing to be read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits

ROWS = "week string, output string, fingerprint string, commit long"


@dataclass(frozen=True)
class Output:
    """A table made for each week: its inputs are names of sources or of outputs."""

    name: str
    inputs: tuple[str, ...]
    version: str


def in_order(outputs: list[Output]) -> list[Output]:
    """Outputs after those they are made from; a cycle or a repeated name is an error."""
    by_name = {o.name: o for o in outputs}
    if len(by_name) < len(outputs):
        raise ValueError("an output is named twice")
    done: dict[str, Output] = {}
    while len(done) < len(outputs):
        ready = [o for o in outputs if o.name not in done and all(i not in by_name or i in done for i in o.inputs)]
        if not ready:
            raise ValueError(f"outputs depend on each other: {sorted(set(by_name) - set(done))}")
        done |= {o.name: o for o in ready}
    return list(done.values())


def fingerprints(sources: DataFrame, outputs: list[Output]) -> DataFrame:
    """(week, output, place, fingerprint) of every output of every week; null where a source is missing. sources: week, source, sha256. place: the
    order in which outputs can be made."""
    weeks = sources.groupBy("week").agg(F.map_from_entries(F.collect_list(F.struct("source", "sha256"))).alias("held"))
    known: dict[str, Column] = {}
    for o in in_order(outputs):
        given = [known[i] if i in known else F.try_element_at("held", F.lit(i)) for i in o.inputs]
        weeks = weeks.withColumn(f"__{o.name}", F.sha2(F.concat(*(x for g in [F.lit(f"{o.name}@{o.version}"), *given] for x in (g, F.lit("|")))), 256))
        known[o.name] = F.col(f"`__{o.name}`")
    rows = F.array(*(F.struct(F.lit(name).alias("output"), F.lit(k).alias("place"), c.alias("fingerprint")) for k, (name, c) in enumerate(known.items())))
    return weeks.select("week", F.explode(rows).alias("o")).select("week", "o.*")


def work_list(sources: DataFrame, outputs: list[Output], ledger: DataFrame) -> DataFrame:
    """(week, output, place, fingerprint, status) of what is to be made, in order of place: new, stale, or blocked where a source is missing."""
    last = ledger.groupBy("week", "output").agg(F.max_by("fingerprint", "commit").alias("made"))
    j = fingerprints(sources, outputs).join(last, ["week", "output"], "left")
    status = F.when(F.col("fingerprint").isNull(), "blocked").when(F.col("made").isNull(), "new").otherwise("stale")
    return j.filter(~F.coalesce(F.col("made") == F.col("fingerprint"), F.lit(False))).select("week", "output", "place", "fingerprint", status.alias("status"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all commits: week, output, fingerprint, commit."""
    names = commits.read_all(spark, f"{path}/_commits")
    if not names:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(*(f"{path}/{name}" for _, name in sorted(names.items())))


def commit(made: DataFrame, path: str) -> int:
    """Adds rows (week, output, fingerprint) as one commit, all or nothing, and returns its number."""
    spark = made.sparkSession
    while True:
        number = max(commits.numbers(spark, f"{path}/_commits"), default=0) + 1
        name = f"rows-{number}-{uuid.uuid4().hex}"
        made.select("week", "output", "fingerprint", F.lit(number).cast("long").alias("commit")).coalesce(1).write.parquet(f"{path}/{name}")
        if commits.create(spark, f"{path}/_commits", number, name):
            return number


def stale(sources: DataFrame, ledger: DataFrame, files: list[str]) -> DataFrame:
    """(week, file) whose recorded source hash is not the week's present one. sources: week, sha256; ledger: week, file, sha256."""
    wanted = sources.withColumn("file", F.explode(F.array(*map(F.lit, files))))
    return wanted.join(ledger, ["week", "file", "sha256"], "left_anti").select("week", "file")


def week_status(weeks: DataFrame, manifests: DataFrame, first: str, last: str) -> DataFrame:
    """Every Sunday from first to last: complete, partial or missing. manifests: week, complete."""
    spark = weeks.sparkSession
    calendar = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 7 day)) AS d").select(F.date_format("d", "yyyy-MM-dd").alias("week"))
    m = manifests.groupBy("week").agg(F.min(F.col("complete").cast("int")).alias("c"))
    return calendar.join(m, "week", "left").select("week", F.when(F.col("c").isNull(), "missing").when(F.col("c") == 1, "complete").otherwise("partial").alias("status"))
