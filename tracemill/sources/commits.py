"""Numbered commits in a folder: files that a file system creates for one writer only. What a commit names is read; what none names is not there."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def numbers(spark: SparkSession, folder: str) -> list[int]:
    files, path = _at(spark, folder)
    return sorted(int(f.getPath().getName()) for f in files.listStatus(path) if f.getPath().getName().isdigit()) if files.exists(path) else []


def create(spark: SparkSession, folder: str, number: int, text: str) -> bool:
    """Writes a commit; False where another writer was first. The text goes to a file of its own first, and takes its name by a rename, so a
    commit is whole or not there."""
    files, path = _at(spark, folder)
    files.mkdirs(path)
    new = spark._jvm.org.apache.hadoop.fs.Path
    final, own = new(path, str(number)), new(path, f"_{number}-{spark._jvm.java.util.UUID.randomUUID()}")
    out = files.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(final):
        done = False
    else:
        done = files.rename(own, final)  # refused where the name is taken
    if not done:
        files.delete(own, False)
        if number not in numbers(spark, folder):
            raise OSError(f"no commit could be made in {folder}")
    return done


def read_all(spark: SparkSession, folder: str) -> dict[int, str]:
    """Text of each commit by its number; commits are few and small."""
    found = [f"{folder}/{n}" for n in numbers(spark, folder)]
    if not found:
        return {}
    rows = spark.read.text(found, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)$", 1).cast("int").alias("n")).collect()
    return {r.n: r.value for r in rows}
