"""Token ids in sorted-string-table shards, with binary-search lookup.

A shard file holds documents in rising key order:

    blocks   entries of (shared, unshared, value length: varints; rest of key; value). A key shares
             a prefix with the one before; a block starts afresh. Blocks are zstd-compressed.
    index    last key, offset, stored and plain length of each block
    filter   Bloom filter of the keys, bits a power of two
    footer   fixed size: offsets and lengths of index and filter, documents, ids, magic

A key is one byte (0 null, 1 not) and the id as a big-endian integer with its sign bit turned, so that byte order
is number order. A value is the ids as little-endian integers of the shard's width (2 or 4 bytes).

Documents are range-partitioned and sorted by id; each task writes one shard beside its place and
then renames it, so a task that runs again replaces equal bytes. Only the manifest (one row a shard) is
gathered, to add up where each shard's ids start.

Defined results: a null text is empty and has only the end id; null doc_ids come first; repeated ids keep all
their entries, ordered by text; an empty table gives no shard and an empty result; other columns
are ignored; a document is one entry however long it is; an id that does not fit in the width is an error.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored
from .tokens import tokenizer

MAGIC = b"idtable1"
FOOTER = struct.Struct("<QQQQQQQB7x8s")
BLOCK_BYTES = 64 << 10
BITS_PER_KEY = 10
PROBES = 7
CODEC = "zstd"
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) & (bits - 1) for i in range(PROBES)]


class Writer:
    """Entries in rising key order to one open file."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.n_docs = self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} does not fit in {self.width} bytes")
        value = ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(xxhash.xxh3_64_intdigest(key))
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def _end_block(self) -> None:
        if self.block:
            packed = pa.compress(bytes(self.block), CODEC, asbytes=True)
            self.index.append((self.last, self._write(packed), len(packed), len(self.block)))
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        index = b"".join(k + struct.pack("<QII", *rest) for k, *rest in self.index)
        bits = 64
        while bits < BITS_PER_KEY * len(self.keys):
            bits *= 2
        h = np.array(self.keys, np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        held = np.zeros(bits, bool)
        for i in range(PROBES):
            held[(a + np.uint64(i) * b) & np.uint64(bits - 1)] = True
        bloom = np.packbits(held, bitorder="little").tobytes()
        index_at, bloom_at = self._write(index), self._write(bloom)
        self._write(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), len(self.index), self.n_docs, self.n_ids, self.width, MAGIC))


class Reader:
    """One shard: all entries in order, or those of one id."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(source.size() - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, n, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(index_at)
        raw = source.read(index_size)
        self.index = [(raw[k * 25 : k * 25 + 9], *struct.unpack_from("<QII", raw, k * 25 + 9)) for k in range(n)]
        self.last_keys = [x[0] for x in self.index]
        source.seek(bloom_at)
        self.bloom = source.read(bloom_size)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, plain = self.index[k]
        self.source.seek(at)
        data = memoryview(pa.decompress(self.source.read(size), decompressed_size=plain, codec=CODEC, asbytes=True))
        at, key = 0, b""
        while at < plain:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at + rest)
            at += rest + size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry of doc_id: the filter first, then binary search in the index, then one block or a few."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom))):
            return []
        out = []
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.index)):
            entries = list(self._block(k))
            out += [ids for x, ids in entries if x == key]
            if entries[-1][0] > key:
                break
        return out


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark resolves it, with its scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()


def open_shard(path: str) -> Reader:
    files, at = _place(path)
    return Reader(files.open_input_file(at))


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, width: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the shards and returns their manifest. A folder without a scheme is where Spark has it: in the cluster's default file system."""
    folder = qualified(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        files, at = _place(folder)
        files.create_dir(at, recursive=True)
        own, final = f"{at}/.{shard}-{task.taskAttemptId()}", f"{at}/{shard:06d}.ids"
        writer, first, last = None, None, None
        out = None
        for batch in batches:
            ids_of = tokenizer(tokenizer_path).ids(batch.column(1).fill_null("").to_pylist())
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                if writer is None:
                    out = files.open_output_stream(own)
                    writer, first = Writer(out, width), doc
                writer.add(key_of(doc), np.append(ids, end_id))
                last = doc
        if writer is not None:
            writer.close()
            out.close()
            files.move(own, final)
            row = {"shard": shard, "path": f"{folder}/{shard:06d}.ids", "n_docs": writer.n_docs, "n_ids": writer.n_ids, "first_id": first, "last_id": last}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    n = shuffle_partitions(docs.sparkSession)
    keys = [F.col("doc_id").asc_nulls_first()]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    parted = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first())
    manifest = stored(parted.mapInArrow(write, MANIFEST), "manifest")
    files, at = _place(folder)
    # what attempts that did not end have left
    for info in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if info.base_name.startswith("."):
            files.delete_file(info.path)
    return manifest


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. The manifest has one row a shard."""
    shards = manifest.select("shard", "path", "n_ids").orderBy("shard").collect()
    spark: SparkSession = manifest.sparkSession
    starts, at = [], 0
    for r in shards:
        starts.append((r["path"], at))
        at += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc, ids in open_shard(path):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)

    paths = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))
    return paths.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids stored for one document, from the shards whose range holds it."""
    rows = manifest.filter((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)).select("path").collect()
    return [ids for r in rows for ids in open_shard(r["path"]).lookup(doc_id)]
