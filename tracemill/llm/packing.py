"""Best-fit packing planned on the histogram of lengths.

The plan needs only how many pieces there are of each length (at most `size` numbers), so it is made
on the driver by best-fit over counts: lengths in falling order, each put into the tightest open bins,
whole groups of equal bins at a time. Its size follows the number of distinct lengths, not of
documents. The pieces then take planned slots by joining on their rank within their length. Ranks
are counted in salted groups, whose offsets are added, so no length goes to one task.

Defined results: a null text is empty and has only the end token; an empty table gives an empty table;
repeated rows are packed each; ties of length are ranked by salt, id and piece; other columns
are ignored. Only documents longer than `size` are cut, into pieces of `size` and a rest.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, stored
from .tokens import tokenizer

SIZE = 4096
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, salt int"


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, salts: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids_of = tokenizer(tokenizer_path).ids(batch.column(1).fill_null("").to_pylist())
            for k, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), ids_of, strict=True)):
                ids = np.append(ids, end_id).astype("<u4")
                for p, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((doc, p, at, len(part), zlib.crc32(part.tobytes()), (zlib.crc32(repr((doc, p)).encode()) + k) % salts))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, pieces a sequence, offset of the first in each).

    Open bins are groups (first sequence, number) by free space; a length goes to the tightest space that
    takes it, as many times as it fits there, then to the next; what is left opens new bins."""
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    spaces: list[int] = []  # rising spaces that have open bins
    out, sequences = [], 0

    def put(space: int, group: tuple[int, int]) -> None:
        if space > 0:
            if not free[space]:
                spaces.insert(int(np.searchsorted(spaces, space)), space)
            free[space].append(group)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]

        def fill(first: int, bins: int, space: int) -> None:
            """Puts pieces into so many equal bins, and what remains of these back among the open ones."""
            nonlocal rank, left
            each = space // length
            whole = min(bins, left // each)
            if whole:
                out.append((length, rank, rank + whole * each, first, each, size - space))
                rank, left = rank + whole * each, left - whole * each
                put(space - each * length, (first, whole))
            if left and whole < bins:
                out.append((length, rank, rank + left, first + whole, left, size - space))
                put(space - left * length, (first + whole, 1))
                rank, left, whole = rank + left, 0, whole + 1
            if whole < bins:
                put(space, (first + whole, bins - whole))

        while left:
            k = int(np.searchsorted(spaces, length))
            if k < len(spaces):
                space = spaces[k]
                first, bins = free[space].pop()
                if not free[space]:
                    spaces.pop(k)
                fill(first, bins, space)
            else:
                bins = -(-left // (size // length))
                first, sequences = sequences, sequences + bins
                fill(first, bins, size)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = SIZE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    salts = shuffle_partitions(spark)
    pieces = stored(pieces_of(docs, tokenizer_path, end_id, size, salts, id_column, text_column), "pieces")
    groups = stored(pieces.groupBy("length", "salt").count(), "lengths")
    histogram = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("count")).collect()}  # at most `size` rows
    slots = plan(histogram, size)
    planned = spark.createDataFrame(slots, "p_length int, p_from long, p_to long, p_first long, p_each long, p_offset long")

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "salt", "ahead")
    within = Window.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    # the plan has a few rows for each of at most `size` lengths
    at = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to"))
    k = F.col("rank") - F.col("p_from")
    return ranked.join(F.broadcast(planned), at).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("p_first") + F.floor(k / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + F.pmod(k, F.col("p_each")) * F.col("length")).cast("long").alias("offset"),
    )
