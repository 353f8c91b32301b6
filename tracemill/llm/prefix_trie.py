"""The prefix trie of rebuilt conversations, by collapse of whole sequences.

Turns are numbered and summed in one range-partitioned order: of each prefix of a conversation there is a 127-bit sum of turn digests
times powers of a fixed base, which can be cut and put together (the part of a sum between two prefixes, moved by a power, is the sum of
that part elsewhere). So a conversation that holds a third of all turns is spread over many tasks, and a rebuilt
conversation, a head of one and a tail of another, gets the sums of its prefixes without its turns being copied.

Rebuilt conversations with one length and sum are one sequence with a weight and a list of ends. Only one conversation of each gives
prefixes. Sequences that are proper prefixes of others fall out by an anti-join, which leaves the leaves. Weighted prefixes are then summed
by node: members, leaves, and bytes. Bytes below a node are those of the leaves' tails, each node being counted for the
least leaf that runs through it.

Defined results: turns of one number are ordered by role, then by digest; repeated rows are turns of their own; rows of a null conv_id belong to no conversation; null roles and texts
are empty; an empty table gives no node; very long texts are only digested, where they are read; other
columns are ignored, whatever their names. The remainder c % 5 has the sign of c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

#: Heads are shorter than this.
HEADS = 9
PRIME = (1 << 127) - 1
BASE = 0x3C6EF372FE94F82BA54FF53A5F1D36F1
#: Ids of one list that are put together as one text.
CHUNK = 4096
_NONE = bytes(16)

SUMS = "part int, conv_id long, pos long, bytes long, sum binary, sum_before binary, cum long"


def _big(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def _raw(number: int) -> bytes:
    return number.to_bytes(16, "big")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to running sums per conversation, from the first turn of it in this task."""
    now, pos, total, power, cum = None, 0, 0, 1, 0
    for batch in batches:
        out = [[], [], [], [], []]
        for conv, digest, size in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            if conv != now:
                now, pos, total, power, cum = conv, 0, 0, 1, 0
            before = _raw(total)
            total = (total + _big(digest) % PRIME * power) % PRIME
            power = power * BASE % PRIME
            pos, cum = pos + 1, cum + size
            for x, y in zip(out, (pos, _raw(total), before, cum), strict=False):
                x.append(y)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), batch.column(3), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())],
            names=["part", "conv_id", "pos", "bytes", "sum", "sum_before", "cum"],
        )


def _fold(pieces: list) -> list:
    """Pieces (part, turns, sum, cum) of a conversation cut by tasks, to what stands before each."""
    out, turns, total, cum = [], 0, 0, 0
    for p in sorted(pieces, key=lambda p: p["part"]):
        out.append({"part": p["part"], "turns": turns, "sum": _raw(total), "cum": cum})
        total = (total + _big(p["sum"]) * pow(BASE, turns, PRIME)) % PRIME
        turns, cum = turns + p["turns"], cum + p["cum"]
    return out


def _shifted(columns: list[str], moved: list[str]):
    """Sums moved: moved' = to + BASE^by (moved - from), for the columns (to, from, by) that end a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            to, since, by = (batch.column(at[c]).to_pylist() for c in ("__to", "__from", "__by"))
            arrays = [batch.column(at[c]) for c in columns]
            for c in moved:
                new = [_raw((_big(t) + pow(BASE, b, PRIME) * (_big(x) - _big(f))) % PRIME) for x, t, f, b in zip(batch.column(at[c]).to_pylist(), to, since, by, strict=True)]
                arrays[columns.index(c)] = pa.array(new, pa.binary())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


def prefix_sums(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, bytes, sum, sum_before, cum): of each turn its UTF-8 bytes, the sums of the prefixes with and without it, and the bytes of the first."""
    spark = conversations.sparkSession
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    # the role's length parts it from the text; it is part of the order only
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    ordered = turns.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    parts = stored(ordered.select(F.spark_partition_id().alias("part"), "conv_id", "digest", "bytes").mapInArrow(_running, SUMS), "prefix-sums")
    # a conversation is cut only where it is the last of one task and the first of a later one: at most two a task
    ends = parts.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
    cut = ends.select("part", F.explode(F.array_distinct(F.array("first", "last"))).alias("conv_id"))
    cut = cut.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id")
    pieces = parts.join(F.broadcast(cut), "conv_id").groupBy("conv_id", "part").agg(F.max("pos").alias("turns"), F.max_by("sum", "pos").alias("sum"), F.max("cum").alias("cum"))
    fold = F.udf(_fold, "array<struct<part:int,turns:long,sum:binary,cum:long>>")
    before = pieces.groupBy("conv_id").agg(fold(F.collect_list(F.struct("part", "turns", "sum", "cum"))).alias("p")).select("conv_id", F.explode("p").alias("p")).select("conv_id", F.col("p.part").alias("part"), F.col("p.turns").alias("turns"), F.col("p.sum").alias("__to"), F.col("p.cum").alias("more")).filter("turns > 0")
    columns = ["conv_id", "pos", "bytes", "sum", "sum_before", "cum"]
    joined = parts.join(F.broadcast(before), ["conv_id", "part"], "left")
    moved = joined.select("conv_id", (F.col("pos") + F.coalesce("turns", F.lit(0))).alias("pos"), "bytes", "sum", "sum_before", (F.col("cum") + F.coalesce("more", F.lit(0))).alias("cum"), "__to", F.lit(_NONE).alias("__from"), F.col("turns").alias("__by"))
    whole = moved.filter(F.col("__by").isNull()).select(*columns)
    return whole.unionByName(moved.filter(F.col("__by").isNotNull()).mapInArrow(_shifted(columns, ["sum", "sum_before"]), ", ".join(f"{c} {t}" for c, t in zip(columns, ("long", "long", "long", "binary", "binary", "long"), strict=True))))


def rebuilt(sums: DataFrame) -> DataFrame:
    """Of each conversation: length, sum and bytes of the rebuilt one, the turns taken from another (taken), and what moves the sums of its own other turns."""
    head = F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, F.struct("pos", "sum", "sum_before", "cum", "bytes"))))
    own = stored(sums.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max_by("sum", "pos").alias("sum"), F.max("cum").alias("cum"), head.alias("head")), "heads")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    base = own.select(F.col("conv_id").alias("base_id"), F.col("head").alias("base"))
    both = own.withColumns({"h": h, "base_id": F.col("conv_id") - F.col("conv_id") % 5}).join(base, "base_id", "left")
    taken = F.slice(F.coalesce("base", F.array().cast(own.schema["head"].dataType)), F.lit(1), F.col("h"))
    both = both.select("conv_id", "n", "sum", "cum", "h", F.least("h", F.col("n").cast("int")).alias("skipped"), taken.alias("taken"), "head")
    left, last = F.when(F.col("skipped") > 0, F.element_at("head", F.greatest("skipped", F.lit(1)))), F.when(F.size("taken") > 0, F.element_at("taken", -1))
    both = both.select(
        "conv_id", F.col("h").cast("long").alias("h"), "taken", (F.size("taken") + F.col("n") - F.col("skipped")).alias("length"), "sum", F.coalesce(last["sum"], F.lit(_NONE)).alias("__to"), F.coalesce(left["sum"], F.lit(_NONE)).alias("__from"),
        (F.size("taken") - F.col("skipped")).cast("long").alias("shift"), (F.coalesce(last["cum"], F.lit(0)) - F.coalesce(left["cum"], F.lit(0))).alias("cum_shift"), "cum",
    )
    both = both.withColumn("total", F.col("cum") + F.col("cum_shift"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema)
    return stored(both.withColumn("__by", F.col("shift")).mapInArrow(_shifted(both.columns, ["sum"]), schema), "rebuilt")


_NODE = "rep long, length long, weight long, total long, depth long, bytes long, cum long, node binary, parent binary"
_MOVED = ["rep", "length", "weight", "total", "depth", "bytes", "cum", "node", "parent"]


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (length, sum, conv_id) to comma-joined ids, at most CHUNK a row."""
    schema = pa.schema([("length", pa.int64()), ("sum", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    key, ids = None, []
    for batch in batches:
        rows = []
        for length, sum_, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (length, sum_) != key or len(ids) == CHUNK:
                if ids:
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (length, sum_), []
            ids.append(conv)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    if ids:
        yield pa.RecordBatch.from_pylist([{"length": key[0], "sum": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema)


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to one digest a list."""
    schema = pa.schema([("length", pa.int64()), ("sum", pa.binary()), ("ends_sha256", pa.string())])
    key, digest = None, None
    for batch in batches:
        rows = []
        for length, sum_, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (length, sum_) != key:
                if key:
                    rows.append({"length": key[0], "sum": key[1], "ends_sha256": digest.hexdigest()})
                key, digest = (length, sum_), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if key:
        yield pa.RecordBatch.from_pylist([{"length": key[0], "sum": key[1], "ends_sha256": digest.hexdigest()}], schema)


def end_digests(members: DataFrame) -> DataFrame:
    """(length, sum, conv_id) to (length, sum, ends_sha256). Lists are put together in many tasks by ranges of ids; a digest is sequential, so one
    task then reads the texts of one list, CHUNK ids a row, as a stream."""
    n = shuffle_partitions(members.sparkSession)
    keys = ["length", "sum", "conv_id"]
    chunks = members.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_id_chunks, "length long, sum binary, first long, ids string")
    return chunks.repartition(n, "length", "sum").sortWithinPartitions("length", "sum", "first").mapInArrow(_id_digests, "length long, sum binary, ends_sha256 string")


def weighted_prefixes(sums: DataFrame, whole: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of every distinct sequence, as its one conversation (rep) gives it: depth, node (the sum), parent, the bytes of its last turn and of all its turns."""
    reps = whole.join(sequences.select(F.col("rep").alias("conv_id"), "weight"), "conv_id")
    facts = [F.col("conv_id").alias("rep"), "length", "weight", "total"]
    root = reps.select(*facts, F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("cum"), F.lit(_NONE).alias("node"), F.lit(None).cast("binary").alias("parent"))
    t = F.col("t")
    heads = reps.select(*facts, F.explode("taken").alias("t")).select("rep", "length", "weight", "total", t["pos"].alias("depth"), t["bytes"].alias("bytes"), t["cum"].alias("cum"), t["sum"].alias("node"), t["sum_before"].alias("parent"))
    tails = sums.select("conv_id", "pos", "bytes", F.col("sum").alias("node"), F.col("sum_before").alias("parent"), F.col("cum").alias("own_cum")).join(reps.drop("cum", "sum", "taken"), "conv_id").filter(F.col("pos") > F.col("h"))
    tails = tails.select(*facts, (F.col("pos") + F.col("shift")).alias("depth"), "bytes", (F.col("own_cum") + F.col("cum_shift")).alias("cum"), "node", "parent", "__to", "__from", F.col("shift").alias("__by"))
    return root.unionByName(heads).unionByName(tails.mapInArrow(_shifted(_MOVED, ["node", "parent"]), _NODE))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations (see the module)."""
    sums = stored(prefix_sums(conversations), "sums")
    whole = rebuilt(sums)
    sequences = stored(whole.groupBy("length", "sum").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "sequences")
    prefixes = stored(weighted_prefixes(sums, whole, sequences), "prefixes")
    # a sequence that goes on in another is no leaf
    inner = prefixes.filter("depth < length").select(F.col("depth").alias("length"), F.col("node").alias("sum")).distinct()
    leaves = sequences.join(inner, ["length", "sum"], "left_anti").select("rep", F.lit(True).alias("leaf"))
    marked = stored(prefixes.join(leaves, "rep", "left"), "marked")
    before = F.col("cum") - F.col("bytes")
    nodes = stored(
        marked.groupBy("depth", "node").agg(
            F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.sum(F.col("weight") * (F.col("total") - before)).alias("gross"),
            F.min(F.when(F.col("leaf"), F.col("rep"))).alias("owner"), F.min("parent").alias("parent"), F.min(before).alias("before"),
        ),
        "nodes",
    )
    # a leaf counts the bytes of its nodes from the first that no lesser leaf runs through
    owned = nodes.groupBy("owner").agg(F.min("before").alias("since")).select(F.col("owner").alias("rep"), "since")
    distinct = marked.filter("leaf").join(owned, "rep").groupBy("depth", "node").agg(F.sum(F.col("total") - F.greatest("since", before)).alias("net"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ends = end_digests(whole).select(F.col("length").alias("depth"), F.col("sum").alias("node"), "ends_sha256")
    full = nodes.join(distinct, ["depth", "node"], "left").join(children, ["depth", "node"], "left").join(ends, ["depth", "node"], "left")
    full = stored(full.select("depth", "node", "parent", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", (F.col("gross") - F.col("net")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")), "trie")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, ["depth", "parent"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
