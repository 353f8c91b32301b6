"""Published tables: readers that check what they read, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas


def load(spark: SparkSession, root: str, weeks: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sessions, requests and calls under root/<table>/week=<sunday>; weeks that are asked for and not there are an error.

    A week filter prunes folders, and the explicit schema reads no file to infer one."""
    out = []
    for name in ("SESSIONS", "REQUESTS", "TOOL_CALLS"):
        df = spark.read.schema(f"{getattr(schemas, name)}, week string").parquet(f"{root}/{name.lower()}")
        if weeks is not None:
            have = {r.week for r in df.select("week").distinct().filter(F.col("week").isin(*weeks)).collect()}  # as many rows as weeks asked for
            if missing := sorted(set(weeks) - have):
                raise ValueError(f"{name.lower()}: no week {missing}")
            df = df.filter(F.col("week").isin(*weeks))
        out.append(df)
    return tuple(out)


def checked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns named, structs flattened by a dot; other columns, or missing ones, are an error."""
    if set(df.columns) != set(columns):
        raise ValueError(f"columns missing {sorted(set(columns) - set(df.columns))}, unknown {sorted(set(df.columns) - set(columns))}")
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        out += [F.col(f"{c}.{x.name}").alias(f"{c}_{x.name}") for x in kind.fields] if isinstance(kind, T.StructType) else [F.col(c)]
    return df.select(*out)


# fixed values
GROUP_ROWS = 10_000


def write_table(df: DataFrame, path: str, week: str | None = None) -> None:
    """zstd Parquet by week, in row groups of at most GROUP_ROWS rows."""
    writer = df.write.mode("append").option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_ROWS)
    (writer.partitionBy(week) if week else writer).parquet(path)


def _inside(path: Column) -> Column:
    return F.regexp_extract(path, r"((?:[^/=]+=[^/]*/)*[^/]+)$", 1)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path (within the table), bytes and sha256 of each Parquet file of a table, whole or not. A file is hashed as one row, so it must stay under
    2 GB: bound it with maxRecordsPerFile when it is written."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select(_inside(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """path (within the table), bytes, sha256 and rows of each Parquet file of a table (see file_digests)."""
    read = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    rows = read.parquet(path).groupBy(_inside(F.url_decode(F.input_file_name())).alias("path")).agg(F.count("*").alias("rows"))
    return file_digests(spark, path).join(rows, "path", "left").fillna(0, ["rows"])


def check_manifest(manifests: DataFrame, version: int, sources: DataFrame) -> DataFrame:
    """Weeks that must not be read, with the reason: another format, or tables made from another manifest of the logs than the present one.
    manifests: week, format_version, built_from; sources: week, sha256."""
    j = manifests.join(sources, "week", "left")
    reason = F.when(~F.col("format_version").eqNullSafe(F.lit(version)), "format").when(~F.col("built_from").eqNullSafe(F.col("sha256")), "built_from_other_logs")
    return j.select("week", reason.alias("reason")).filter("reason is not null")


def missing_keys(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that are wanted and not held."""
    return wanted.select(*keys).distinct().join(held.select(*keys), keys, "left_anti")


def column_of(big: DataFrame, ids: DataFrame, key: str, column: str) -> DataFrame:
    """One column of the big table for some ids; bodies of other rows are never shuffled with theirs."""
    return big.select(key, column).join(ids.select(key).distinct(), key, "left_semi")


def public_words_table(found: DataFrame, added: DataFrame) -> DataFrame:
    """Counted and hand-added words, each once, in order of list and word. Columns: list, word."""
    return found.select("list", "word").union(added.select("list", "word")).distinct().orderBy("list", "word")


def block_reads(requests: DataFrame, parts: int | None = None, part: int = 0) -> DataFrame:
    """A row for each block id of each request, with its place; of parts, only those whose id leaves part as remainder. The replay
    takes these rows, with the request's other columns."""
    rows = requests.select(*(c for c in requests.columns if c != "block_ids"), F.posexplode("block_ids").alias("pos", "block_id"))
    return rows if parts is None else rows.filter(F.pmod("block_id", F.lit(parts)) == part)


def aligned(rows: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the position that order gives their keys; keys that only one of the two has, or has twice, are an error."""
    j = rows.withColumn("__r", F.lit(1)).join(order.select(*keys, "position").withColumn("__o", F.lit(1)), keys, "full")
    once = F.count("*").over(Window.partitionBy(*keys)) == 1
    wrong = F.concat_ws(" ", F.lit("keys differ:"), *(F.col(k).cast("string") for k in keys))
    held = F.when(F.col("__r").isNull() | F.col("__o").isNull() | ~once, F.raise_error(wrong).cast("long")).otherwise(F.col("position"))
    return j.select(*rows.columns, held.alias("position"))


def write_result(df: DataFrame, path: str, form: str = "csv") -> None:
    """A small result table as CSV with a header, or JSON lines, in one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
