"""SimHash near-duplicates by tiled exact comparison.

Each document gets a 64-bit fingerprint of its shingles. Distinct fingerprints are sorted by their population
counts and cut into tiles; two tiles meet only if their population counts can be within the radius, and inside a
pair of tiles, stretches are skipped by the counts of each 16-bit quarter. What is left is compared whole with
numpy exclusive-or and bit counts. A pair of tiles gives a spanning forest of its links, not all
pairs, and components come from distributed union-find over fingerprints.

The comparison is exact, so its work grows with the square of the number of distinct fingerprints (divided
by what the counts skip); copies cost nothing beyond their first.

Defined results: no words give fingerprint zero, which links like any other; fewer words than a
shingle give one shingle of all words; a null text is empty; repeated rows share a fingerprint; null
doc_ids are members, but never name a component unless it has no other; an empty table gives an
empty table; very long texts are hashed whole, some megabytes at a time; other columns are ignored or carried along,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import shuffle_partitions, stored
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 4096
STRETCH = 128
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        n = len(starts)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, columns: list[str], text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """columns of docs and __fp, the fingerprint as a signed long."""
    fields = docs.select(*columns).schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*columns, "__fp"])

    schema = StructType([*fields.fields, StructField("__fp", LongType())])
    return docs.select(*columns, F.col(text_column).cast("string").alias("__text")).mapInArrow(of, schema)


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct fingerprints of one population count, in tiles sorted by the counts of their quarters."""
    held: dict[int, list[np.ndarray]] = {}
    sizes: dict[int, int] = {}

    def row(pop: int, fps: np.ndarray) -> dict:
        q = _quarters(fps)
        return {"pop": pop, "tile": xxhash.xxh64_intdigest(fps.tobytes()) >> 1, "fps": fps[np.lexsort(q.T[::-1])].tobytes()}

    schema = pa.schema([("pop", pa.int32()), ("tile", pa.int64()), ("fps", pa.binary())])
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        pops = np.bitwise_count(fps)
        for pop in np.unique(pops).tolist():
            held.setdefault(pop, []).append(fps[pops == pop])
            sizes[pop] = sizes.get(pop, 0) + len(held[pop][-1])
            if sizes[pop] >= TILE:
                all_ = np.concatenate(held[pop])
                whole = len(all_) // TILE * TILE
                rows = [row(pop, all_[k : k + TILE]) for k in range(0, whole, TILE)]
                held[pop], sizes[pop] = [all_[whole:]], len(all_) - whole
                yield pa.RecordBatch.from_pylist(rows, schema)
    rows = [row(pop, np.concatenate(x)) for pop, x in held.items() if sizes[pop]]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links a[i] - b[i], those that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = parent[x]
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def tile_links(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within radius between two tiles (or in one)."""
    qx, qy = _quarters(x), _quarters(y)
    cuts = lambda q: (np.arange(0, len(q), STRETCH), np.array([q[k : k + STRETCH].min(axis=0) for k in range(0, len(q), STRETCH)]), np.array([q[k : k + STRETCH].max(axis=0) for k in range(0, len(q), STRETCH)]))
    at_x, low_x, high_x = cuts(qx)
    at_y, low_y, high_y = cuts(qy)
    apart = np.maximum(0, np.maximum(low_x[:, None] - high_y[None], low_y[None] - high_x[:, None])).sum(axis=2)
    near_a, near_b = [], []
    for i in range(len(at_x)):
        own = x[at_x[i] : at_x[i] + STRETCH]
        stretches = [y[at_y[j] : at_y[j] + STRETCH] for j in np.flatnonzero(apart[i] <= radius) if not same or j >= i]
        if not stretches:
            continue
        others = np.concatenate(stretches)
        hit = np.nonzero(np.bitwise_count(own[:, None] ^ others[None]) <= radius)
        if len(hit[0]):
            p, q = own[hit[0]], others[hit[1]]
            differ = p != q
            a, b = _forest(p[differ], q[differ])
            near_a += a
            near_b += b
    return _forest(np.array(near_a, np.uint64), np.array(near_b, np.uint64))


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile_a, x, tile_b, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = tile_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), radius, tile_a == tile_b)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return compare


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints __fp that keep every component within radius together."""
    n = shuffle_partitions(distinct.sparkSession)
    # few tasks make full tiles; those of one population count lie together, so tiles are full at any size
    parted = distinct.select("__fp").repartitionByRange(max(1, n // 4), F.bit_count("__fp"), "__fp")
    tiles = stored(parted.mapInArrow(_tiles, "pop int, tile long, fps binary"), "tiles")
    # pairs are made of the tiles' numbers, over salts, for there are only 65 counts; a pair of tiles of one count is met once
    salt = F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int")
    left = tiles.select(F.col("tile").alias("tile_a"), F.col("pop").alias("pop_a"), F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)).alias("pop")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = left.join(tiles.select("pop", "tile", salt.alias("salt")), ["pop", "salt"]).filter((F.col("pop") > F.col("pop_a")) | (F.col("tile") >= F.col("tile_a")))
    # the bytes of one tile of a pair are shuffled with it, those of the other come by a join that Spark may split
    pairs = pairs.select("tile_a", "tile").join(tiles.select(F.col("tile").alias("tile_a"), F.col("fps").alias("fps_a")), "tile_a").join(tiles.select("tile", "fps"), "tile")
    pairs = pairs.select("tile_a", "fps_a", "tile", "fps").repartition(4 * n, "tile_a", "tile")
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def classes(prints: DataFrame, id_column: str, radius: int) -> DataFrame:
    """(__fp, component_id) of the distinct fingerprints in prints, which has id_column and __fp."""
    by_print = stored(prints.groupBy("__fp").agg(F.min(id_column).alias("least")), "distinct")
    roots = components(fingerprint_links(by_print, radius))
    named = stored(by_print.join(roots, F.col("__fp") == F.col("node"), "left").select("__fp", "least", F.coalesce("root", "__fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.select("__fp", "root").join(least, "root").select("__fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of every row."""
    prints = stored(fingerprints(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), ["doc_id"], "text", shingle), "fingerprints")
    return prints.join(classes(prints, "doc_id", radius), "__fp").select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of docs of each component: that of the least id, of repeated rows the first stored."""
    numbered = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("text"))
    rows = stored(fingerprints(numbered, ["doc", "row"], "text", shingle), "rows")
    prints = stored(rows.select(F.col("doc")[id_column].alias("id"), "row", "__fp"), "fingerprints")
    named = prints.join(classes(prints, "id", radius), "__fp")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row")).alias("f"))
    return rows.join(first.select(F.col("f.row").alias("row")), "row", "left_semi").select(*(F.col("doc")[c].alias(c) for c in docs.columns))
