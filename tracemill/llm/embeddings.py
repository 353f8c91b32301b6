"""Near-duplicates of embeddings by iterative quantisation, multi-index Hamming tables and exact cosine.

A bounded sample of distinct vectors gives rotations: the sample's main axes, turned again and again so that the signs of the
turned vectors lie as close to them as they can (iterative quantisation), which spreads what the vectors tell evenly over the bits. Nothing is centred: cosine is an angle seen from zero, and
bits cut off zero would part a dense group that lies on one side. Each rotation starts from
another seed, and their bits make one code, which is parted into blocks: two codes that differ in fewer bits than there are blocks agree on a whole block.
All vectors go into the tables, one a block; only those that share a block's value with another meet, and what meets is compared by the original
vectors in double precision.

A block has some three bits more than the count of vectors has, so unrelated vectors seldom meet and work grows in proportion. How many
blocks there are follows from the sample: vectors at exactly the threshold's angle from sampled ones are made, towards random and towards other sampled vectors, and blocks are added until RECALL of either kind
share one. Pairs closer than the threshold meet more often.

Equal vectors are one class with a weight. A group of vectors that share a value is compared by one task if it has at most TILE classes; a larger one is
cut into tiles, and pairs of tiles are dealt over all tasks, so no group is held by one and no pair of vectors is a row: a comparison gives the number of links of a
vector and a spanning forest. A pair that meets in several tables counts in the first.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing and are components of their own; so are vectors
of different lengths to each other; repeated rows are vectors each and linked; a null vec_id names no component unless it has no other id;
an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import release, shuffle_partitions, stored
from .components import components
from .simhash import _forest

SIMILARITY = 0.95
RECALL = 0.995
#: Vectors that the rotations are learned from.
SAMPLE = 8192
TURNS = 30
TILE = 256
LEAST_BITS, MOST_BITS, MOST_BLOCKS = 12, 32, 255


def rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """The map of vectors x to as many bits as they have components, by iterative quantisation."""
    d = x.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    v = x @ axes
    for _ in range(TURNS):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return axes @ turn


class Quantiser:
    """Vectors of one length to the values of their blocks."""

    def __init__(self, x: np.ndarray, bits: int, similarity: float, recall: float) -> None:
        sides = [self._at(x, other, similarity) for other in (np.random.default_rng(0).standard_normal(x.shape), x[np.random.default_rng(1).permutation(len(x))])]
        self.bits, self.blocks, self.recall, maps = bits, 0, 0.0, []
        met = np.zeros((2, len(x)), bool)
        flat = np.zeros((3, len(x), 0), bool)
        while self.blocks < MOST_BLOCKS and self.recall < recall:
            while flat.shape[2] < bits:
                maps.append(rotation(x, len(maps)))
                flat = np.concatenate([flat, np.stack([v @ maps[-1] for v in (x, *sides)]) > 0], axis=2)
            met |= (flat[:1, :, :bits] == flat[1:, :, :bits]).all(axis=2)
            flat = flat[:, :, bits:]
            self.blocks += 1
            self.recall = float(met.mean(axis=1).min())
        self.map = np.concatenate(maps, axis=1)

    @staticmethod
    def _at(x: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
        """Of each unit vector one at exactly this cosine, on the side of another vector."""
        other = other - (other * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(other, axis=1, keepdims=True)
        return similarity * x + math.sqrt(1 - similarity**2) * other / np.where(size > 1e-9, size, 1)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors to one number a block."""
        bits = (x @ self.map > 0)[:, : self.blocks * self.bits].reshape(len(x), self.blocks, self.bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))


def _plain(d: int, bits: int, similarity: float, recall: float) -> Quantiser:
    """For a length that the sample lacks: learned from random directions."""
    x = np.random.default_rng(d).standard_normal((512, d))
    return Quantiser(x / np.linalg.norm(x, axis=1, keepdims=True), bits, similarity, recall)


def quantisers(sample: list[np.ndarray], vectors: int, similarity: float, recall: float) -> dict[int, Quantiser]:
    """A quantiser for each length in the sample; block widths follow the number of vectors. A width at which recall can't be reached is narrowed."""
    out = {}
    for d in {len(x) for x in sample}:
        x = np.stack([x for x in sample if len(x) == d])
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(vectors + 1)) + 3))
        q = Quantiser(x, bits, similarity, recall)
        while q.recall < recall and bits > 4:
            bits -= 2
            q = Quantiser(x, bits, similarity, recall)
        out[d] = q
    return out


def unit(raw: bytes, dtype: str) -> np.ndarray | None:
    """A vector's direction in double precision; None if it has none."""
    x = np.frombuffer(raw, dtype).astype(np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    most = np.abs(x).max()
    return x / most / np.linalg.norm(x / most) if most > 0 else None  # no square overflows or vanishes


def _keyed(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, keys = [], []
            for x in batch.column(1):
                x = x.values if x.is_valid else None
                b = None if x is None or x.null_count else np.asarray(x.to_numpy(zero_copy_only=False), dtype).tobytes()
                b = b if b is not None and unit(b, dtype) is not None else None
                raw.append(b)
                keys.append(None if b is None else hashlib.blake2b(b, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "raw"])

    return run


def _coded(learned: dict[int, Quantiser], dtype: str, bits: int, similarity: float, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(r) // np.dtype(dtype).itemsize for r in raw])
            values: list = [None] * len(raw)
            for d in np.unique(sizes).tolist():
                learned[d] = learned.get(d) or _plain(d, bits, similarity, recall)
                rows = np.flatnonzero(sizes == d)
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    for i, v in zip(part.tolist(), learned[d].values(np.stack([unit(raw[i], dtype) for i in part.tolist()])), strict=True):
                        values[i] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) // np.dtype(dtype).itemsize for r in raw], pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["class", "d", "values"])

    return run


def compare(x: np.ndarray, codes_x: np.ndarray, y: np.ndarray, codes_y: np.ndarray, block: int, similarity: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with x[i], y[j] linked whose codes agree in this block and in none before it; i < j if both sides are one."""
    i, j = np.nonzero(x @ y.T >= similarity)
    if same:
        i, j = i[i < j], j[i < j]
    if len(i):
        first = (codes_x[i, : block + 1] == codes_y[j, : block + 1]).argmax(axis=1) == block
        i, j = i[first], j[first]
    return i, j


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _side(ids: list, raws: list, codes: list, weights: list, dtype: str) -> tuple:
    return np.array(ids, np.int64), np.stack([unit(r, dtype) for r in raws]), np.stack([np.array(c, np.int64) for c in codes]), np.array(weights, np.int64)


def _found(left: tuple, right: tuple, block: int, similarity: float, same: bool) -> pa.RecordBatch | None:
    (a, x, cx, wa), (b, y, cy, wb) = left, right
    i, j = compare(x, cx, y, cy, block, similarity, same)
    if not len(i):
        return None
    ids, place = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, place, np.concatenate([wb[j], wa[i]]))
    p, q = _forest(a[i], b[j])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, p]), pa.int64()), pa.array([None] * len(ids) + q, pa.int64()), pa.array(np.concatenate([links, np.zeros(len(p), np.int64)]), pa.int64())], schema=_LINKS)


def _groups(dtype: str, similarity: float):
    """Rows sorted by (d, block, value), whole groups, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                side = _side(*zip(*held, strict=True), dtype)
                if (out := _found(side, side, key[1], similarity, True)) is not None:
                    yield out

        for batch in batches:
            for d, block, value, class_, raw, codes, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, block, value) != key:
                    yield from settle()
                    key, held = (d, block, value), []
                held.append((class_, raw, codes, weight))
        yield from settle()

    return run


def _pairs(dtype: str, similarity: float):
    """Rows (block, tile_a, members_a, tile_b, members_b) to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, tile_a, a, tile_b, b = (batch.column(c)[k].as_py() for c in range(5))
                left, right = (_side(*([m[f] for m in members] for f in ("class", "raw", "values", "weight")), dtype) for members in (a, b))
                if (out := _found(left, right, block, similarity, tile_a == tile_b)) is not None:
                    yield out

    return run


def class_links(classes: DataFrame, dtype: str, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """classes: (class, raw, weight), distinct vectors. Rows (a, null, links) that add up to the links of a class, and (a, b, 0), which join what is linked."""
    spark = classes.sparkSession
    n = shuffle_partitions(spark)
    vectors = classes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(vectors + 1)) + 3))
    sample = classes.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).collect()  # SAMPLE rows at most
    learned = quantisers([unit(bytes(r["raw"]), dtype) for r in sample], vectors, similarity, recall)
    coded = stored(classes.select("class", "raw").mapInArrow(_coded(learned, dtype, bits, similarity, recall), "class long, d long, values array<long>"), "codes")
    keys = ["d", "block", "value"]
    entries = coded.select("class", "d", F.posexplode("values").alias("block", "value"))
    met = entries.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(entries.join(met, keys), "shared")
    whole = classes.join(coded.select("class", "values"), "class")
    small = shared.filter(F.col("n") <= TILE).join(whole, "class").select(*keys, "class", "raw", "values", "weight")
    near = small.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_groups(dtype, similarity), "a long, b long, links long")
    # larger groups: members fall into tiles by hash, tiles meet by number, and their members are joined to the pairs
    wide = shared.filter(F.col("n") > TILE).withColumn("tiles", F.ceil(F.col("n") / (TILE // 2)).cast("int"))
    wide = wide.withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    tiles = stored(wide.join(whole, "class").groupBy(*keys, "tiles", "tile").agg(F.collect_list(F.struct("class", "raw", "values", "weight")).alias("members")), "tiles")
    pairs = tiles.select(*keys, F.col("tile").alias("tile_a"), F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("tile_b"))
    members = lambda side: tiles.select(*keys, F.col("tile").alias(f"tile_{side}"), F.col("members").alias(f"members_{side}"))
    both = pairs.join(members("a"), [*keys, "tile_a"]).join(members("b"), [*keys, "tile_b"]).select("block", "tile_a", "members_a", "tile_b", "members_b", *keys[::2])
    far = both.repartition(4 * n, *keys, "tile_a", "tile_b").select("block", "tile_a", "members_a", "tile_b", "members_b").mapInArrow(_pairs(dtype, similarity), "a long, b long, links long")
    return stored(near.unionByName(far), "class-links")


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable) and kept (vec_id = component_id) of every row."""
    kind = vectors.schema[vector_column].dataType
    dtype = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"
    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<float>" if dtype == "<f4" else "array<double>").alias("embedding"))
    rows = stored(given.mapInArrow(_keyed(dtype), "vec_id long, key binary, raw binary"), "vectors")
    # the shuffle hands over one row a digest and task
    classes = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("raw").alias("raw"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    links = class_links(classes.select("class", "raw", "weight"), dtype, similarity)
    counted = links.filter(F.col("b").isNull()).groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = components(links.filter(F.col("b").isNotNull()).select("a", "b"))
    named = classes.select("key", "class", "weight", "least").join(roots.withColumnRenamed("node", "class"), "class", "left").join(counted, "class", "left")
    named = stored(named.select("key", "least", F.coalesce("root", "class").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = stored(named.join(least, "root").select("key", "n_links", F.col("component_id").alias("named"), F.lit(True).alias("known")), "facts")
    release(named)
    out = rows.select("vec_id", "key").join(facts, "key", "left")
    component = F.when(F.col("known"), F.col("named")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
