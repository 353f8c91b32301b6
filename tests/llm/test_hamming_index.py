"""The multi-index of benchmark items: everything within the radius, each pair once, few others, and what similarity 0.8 means for it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import decontaminate


@pytest.fixture(scope="module")
def prints(spark):
    """Items of 40 shingles, windows near one (some exactly 0.8 or just over) and windows near none: (id, item or null, similarity, two words)."""
    rng = random.Random(9)
    new = lambda: rng.getrandbits(63)
    items = [(k, [new() for _ in range(40)]) for k in range(60)]
    windows = []
    for k in range(600):
        item, changed = items[k % 60][1], rng.choice([0, 1, 2, 3, 4, 4, 4])
        kept = rng.sample(item, 40 - changed)
        windows.append((k, [*kept, *(new() for _ in range(changed))], k % 60, (40 - changed) / (40 + changed)))
    windows += [(1000 + k, [new() for _ in range(40)], None, 0.0) for k in range(400)]
    it = spark.createDataFrame(items, "item long, ih array<long>").select("item", F.lit(40).alias("m"), decontaminate._fingerprint(F.col("ih")).alias("fp"))
    w = spark.createDataFrame(windows, "window long, wh array<long>, near long, similarity double").select("window", "near", "similarity", F.lit(40).alias("m"), decontaminate._fingerprint(F.col("wh")).alias("fp"))
    return it, w, {r.item: r.fp for r in it.collect()}, [(r.window, r.near, r.similarity, r.fp) for r in w.collect()]


def apart(a, b):
    return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))


def test_all_within_the_radius_each_once(prints):
    items, windows, ifp, wfp = prints
    got = [tuple(r) for r in decontaminate.near_pairs(windows, items, n_items=60).collect()]
    want = {(w, i) for w, _, _, fp in wfp for i, b in ifp.items() if apart(fp, b) <= decontaminate.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want


def test_it_selects(prints):
    """Of pairs of nothing alike, one in ten or fewer share a block's look-up."""
    _, _, ifp, wfp = prints
    blocks = lambda fp: [(x >> (16 * k)) & 0xFFFF for x in fp for k in range(4)]
    far = [(fp, b) for _, near, _, fp in wfp if near is None for b in ifp.values()]
    met = sum(any((x ^ y).bit_count() <= 3 for x, y in zip(blocks(a), blocks(b), strict=True)) for a, b in far)
    assert met <= 0.11 * len(far)


def test_recall_at_the_similarity(prints):
    _, _, ifp, wfp = prints
    near = [(s, apart(fp, ifp[n])) for _, n, s, fp in wfp if n is not None and s >= 0.8]
    at = [d for s, d in near if s < 0.83]
    assert len(at) > 150 and sum(d <= decontaminate.RADIUS for d in at) >= 0.98 * len(at)
    assert sum(d <= decontaminate.RADIUS for _, d in near) >= 0.99 * len(near)


def test_other_sizes_do_not_meet(spark, prints):
    items, windows, *_ = prints
    assert decontaminate.near_pairs(windows.withColumn("m", F.lit(41)), items).count() == 0
    with pytest.raises(ValueError, match="within"):
        decontaminate.near_pairs(windows, items, radius=40)
