"""Benchmark decontamination in DataFrame functions alone.

Texts are lower-cased and cut into words of letters and digits. Benchmark items of n words are compared with
document windows of n words. A window can reach the similarity with an item of its size only if it holds enough of that item's
shingles, so windows that hold enough of no such item need no fingerprint (an exact bound). A window whose start lies before (after)
all alignments of the shingles it shares with an item shares no less when it moves on to the first (back to the last), so the windows
to try are those aligned with an item at a shared shingle, and all between two alignments. Each window left gets a
128-bit SimHash of its shingles in eight 16-bit blocks. By the pigeonhole principle a window and an item within RADIUS differ in at most three bits
of some block: items are indexed by their size under every value within two changed bits of each block, windows look up every value within
one, so each window meets every item of its size within RADIUS, and some 8 % of the others. Two of similarity 0.8 are some 20 bits apart, and
beyond RADIUS in fewer than 1 of 100 cases (measured in the tests).
Pairs within the radius are verified by exact weighted-shingle similarity: sum of least over sum of
greatest multiplicities (shingles are compared by their 64-bit hashes).

Item tables are broadcast only below a checked number of bytes; beyond it Spark's own joins are used, whose skewed keys Spark splits. Documents are never
shuffled whole, and below that size no step groups rows by shingle, so frequent shingles do not gather anywhere.

Defined results: null or blank texts match nothing; items of fewer words than a shingle are too short to be evidence and match
nothing (unsearchable() lists them); null item_ids are ignored; rows of one id and text are reported once, other texts of the id on
their own; very long texts are cut into overlapping stretches, which loses no window; empty tables give an empty result;
several items of equal text are all reported; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHINGLE = 5
SIMILARITY = 0.8
#: Mean distance at SIMILARITY is about 20 of 128 bits. Eight blocks of which each differs in four bits or more are 32 bits apart.
RADIUS = 31
BLOCKS, ITEM_FLIPS, WINDOW_FLIPS = 8, 2, 1
#: Bytes of an item table that are broadcast at most.
BROADCAST_BYTES = 64_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, k: int) -> Column:
    n = F.size(words) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def _simhash(hashes: Column) -> Column:
    """A bit is set if it is set in over half of the hashes."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda out, bit: out.bitwiseOR(bit))


def _fingerprint(hashes: Column) -> Column:
    """Two words of 64 bits, the second of hashes of the hashes."""
    return F.array(_simhash(hashes), _simhash(F.transform(hashes, lambda h: F.xxhash64(h))))


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp[k // 4], 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _lookups(df: DataFrame, fp: str, flips: int) -> DataFrame:
    """A row for each block and each value within so many changed bits: block, mask, value."""
    masks = [m for m in range(1 << 16) if m.bit_count() <= flips]
    blocks = df.select("*", F.posexplode(F.array(*(_block(F.col(fp), k) for k in range(BLOCKS)))).alias("block", "__v"))
    return blocks.select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("value", F.col("__v").bitwiseXOR(F.col("mask"))).drop("__v")


def near_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS, n_items: int | None = None) -> DataFrame:
    """(window, item) of equal size m and fingerprints (fp) within the radius, each once."""
    if radius > RADIUS:
        raise ValueError(f"the index finds pairs within {RADIUS} bits")
    index = _lookups(items.select("item", "m", F.col("fp").alias("ifp")), "ifp", ITEM_FLIPS).drop("mask")
    rows = 1 << 62 if n_items is None else n_items * BLOCKS * sum(math.comb(16, k) for k in range(ITEM_FLIPS + 1))
    met = _lookups(windows.select("window", "m", "fp"), "fp", WINDOW_FLIPS).join(_checked(index, rows), ["m", "block", "value"])
    differ = lambda k: _block(F.col("fp"), k).bitwiseXOR(_block(F.col("ifp"), k))
    less = lambda x: x.bitwiseAND(x - 1)  # noqa: E731  without its lowest bit
    # a pair that meets in several blocks, or in one by several masks, counts once: in its first block, where the window's mask is what two
    # changed bits of the item leave
    first, mask = F.lit(BLOCKS), F.lit(-1)
    for k in reversed(range(BLOCKS)):
        meets = F.bit_count(differ(k)) <= ITEM_FLIPS + WINDOW_FLIPS
        first, mask = F.when(meets, k).otherwise(first), F.when(meets, less(less(differ(k)))).otherwise(mask)
    distance = sum((F.bit_count(F.col("fp")[w].bitwiseXOR(F.col("ifp")[w])) for w in range(2)), F.lit(0))
    return met.filter((F.col("block") == first) & (F.col("mask") == mask) & (distance <= radius)).select("window", "item")


def _checked(df: DataFrame, rows: int, values: int = 0) -> DataFrame:
    """Broadcast if so many rows of some 64 bytes and so many array values of 8 bytes fit."""
    return F.broadcast(df) if 64 * rows + 8 * values <= BROADCAST_BYTES else df


def _similarity(a: Column, b: Column) -> Column:
    """Sum of least over sum of greatest multiplicities of two arrays."""
    times = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(a), F.lit(0), lambda n, v: n + F.least(times(a, v), times(b, v))))
    return shared / (F.size(a) + F.size(b) - shared)


def unsearchable(benchmark: DataFrame, item_column: str = "item_id", item_text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """item_id of the items that have too few words to be looked for."""
    return benchmark.filter(F.col(item_column).isNotNull() & (F.size(_words(F.col(item_text))) < shingle)).select(F.col(item_column).alias("item_id"))


def benchmark_windows(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, row_key (digest of the text), item_id, start (word of the document) and similarity of each window that is an item, or nearly."""
    items = benchmark.select(F.col(item_column).alias("item_id"), _words(F.col(item_text)).alias("w")).filter(F.col("item_id").isNotNull() & (F.size("w") >= shingle))
    items = items.select("item_id", _shingles(F.col("w"), shingle).alias("ih")).dropDuplicates(["item_id", "ih"])
    items = stored(items.select("*", F.size("ih").alias("m"), _fingerprint(F.col("ih")).alias("fp")).withColumn("item", F.xxhash64("item_id", "ih")), "items")
    n_items, n_places, longest = items.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(1))).first()

    # A shared shingle at p and q aligns the item with the window at p - q. Of a run of shared shingles
    # only the first counts, so an exact passage gives one window.
    places = items.select("item", "m", F.posexplode("ih").alias("q", "g"), F.col("ih"))
    places = places.select("item", "m", "q", "g", F.get("ih", F.col("q") - 1).alias("before"))
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column)).alias("row_key"), _words(F.col(text_column)).alias("w"))
    keyed = keyed.select("doc_id", "row_key", _shingles(F.col("w"), shingle).alias("h"))
    # Rows made from one document are buffered together, so none carries all its shingles: documents are cut into
    # stretches that have the longest item's length before them and twice that after them. The outer forms are used, for of the
    # others Spark takes a filter on the size and computes the array twice.
    step = max(256, longest)
    n, h = F.size("h"), F.col("h")

    def stretch(c):
        low = F.greatest(F.lit(0), c * step - longest)
        return F.struct((c * step).alias("base"), low.alias("low"), F.slice(h, low + 1, c * step - low + step + 2 * longest).alias("hs"))

    stretches = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), stretch))
    cut = keyed.select("doc_id", "row_key", n.alias("n"), F.explode_outer(stretches).alias("c")).select("doc_id", "row_key", "n", "c.*")
    hits = cut.select("*", F.posexplode_outer(F.slice("hs", F.col("base") - F.col("low") + 1, F.lit(step))).alias("i", "g")).withColumn("p", F.col("base") + F.col("i")).join(_checked(places.select("item", "m", "q", "g", "before"), n_places), "g")
    hits = hits.filter((F.col("p") == 0) | F.col("before").isNull() | (F.get("hs", F.col("p") - F.col("low") - 1) != F.col("before")))
    # Each hit answers for its own alignment a and for the starts from there to the next alignment in reach, which
    # is looked for only where [a, a + 2m) holds enough of the item's shingles for any window in it.
    hits = hits.join(_checked(items.select("item", "ih"), n_items, n_places), "item").withColumn("a", F.col("p") - F.col("q"))
    m, low, hs = F.col("m"), F.col("low"), F.col("hs")

    def held(first, size):
        return F.size(F.filter(F.slice(hs, F.greatest(F.lit(0), first - low) + 1, size), lambda x: F.array_contains(F.col("ih"), x)))

    def enough(n_held, size):
        return n_held * (1 + similarity) >= similarity * (size + m) - 1e-6

    # a window that the document's ends cut to fewer shingles needs fewer of them
    near = F.col("a").between(1 - m, F.col("n") - 1) & enough(held(F.col("a"), 2 * m), F.least(m, F.col("n")))
    aligned = lambda s: F.exists(F.sequence(F.lit(0), m - 1), lambda j: (s + j >= low) & (F.get(hs, F.greatest(F.lit(0), s + j - low)) == F.get(F.col("ih"), j)))
    further = F.get(F.filter(F.sequence(F.col("a") + 1, F.col("a") + 2 * m), aligned), F.lit(0))
    hits = hits.withColumn("next", F.when(near, further))
    last = F.greatest(F.col("a"), F.least(F.col("next") - 1, F.col("a") + m - 1))
    clipped = lambda s: F.greatest(F.lit(0), F.least(s, F.col("n") - m))
    starts = F.array_distinct(F.transform(F.sequence(F.col("a"), F.when(F.col("next").isNull(), F.col("a")).otherwise(last)), clipped))
    size_at = lambda s: F.least(m, F.col("n") - s)
    hits = hits.withColumn("starts", F.filter(starts, lambda s: enough(held(s, m), size_at(s))))
    windows = hits.select("doc_id", "row_key", "m", "low", "hs", F.explode_outer("starts").alias("start")).filter("start is not null")
    windows = windows.select("doc_id", "row_key", "m", "start", F.slice("hs", F.col("start") - F.col("low") + 1, F.col("m")).alias("wh"))
    # a window that several items or hits led to is one window from here on; it meets any item of its size
    windows = windows.groupBy("doc_id", "row_key", "m", "start").agg(F.first("wh").alias("wh")).withColumn("fp", _fingerprint(F.col("wh")))
    # only numbers are looked up; what a pair's similarity takes is joined to the pairs
    windows = stored(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    near = near_pairs(windows, items, radius, n_items)
    found = near.join(windows.drop("fp", "m"), "window").join(_checked(items.select("item", "item_id", "ih"), n_items, n_places), "item").withColumn("similarity", _similarity(F.col("wh"), F.col("ih")))
    return found.filter(F.col("similarity") >= similarity).select("doc_id", "row_key", "item_id", F.col("start").cast("long").alias("start"), "similarity")


def contaminations(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, start and similarity of the best window of each document (id and text) and item (the first of equals)."""
    found = benchmark_windows(docs, benchmark, **options)
    # similarity, then the earlier start, as one number: numbers alone are aggregated in hash tables, without sorts
    order = F.round(F.col("similarity") * 1_000_000_000).cast("long") * (1 << 32) + ((1 << 31) - 1 - F.col("start"))
    best = found.groupBy("doc_id", "row_key", "item_id").agg(F.max(order).alias("best"), F.max("similarity").alias("similarity"))
    return best.select("doc_id", "item_id", ((1 << 31) - 1 - F.pmod("best", F.lit(1 << 32))).alias("start"), "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    found = stored(benchmark_windows(docs, benchmark, id_column, text_column, **options).select("doc_id", "row_key").distinct(), "contaminated")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = row.join(found, F.col("row")[id_column].eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row")[text_column]) == F.col("row_key")), "left_anti")
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))
