"""Periodic runs, the prefix trie and embedding near-duplicates against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tracemill.llm import embeddings, prefix_trie, runs

# ---- periodic runs


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                seen = w[i : i + length]
                if not any(seen[r:] == seen[: length - r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out)


def random_words(rng):
    n, k = rng.randint(0, 130), rng.choice([1, 2, 2, 3, 5, 20])
    w = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.6 and n > 8:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.4:
            w[rng.randrange(n)] = rng.randrange(k)
    return w


def test_runs_are_those_of_a_plain_search():
    rng = random.Random(5)
    for _ in range(600):
        w = random_words(rng)
        assert [tuple(r) for r in runs.find_runs(np.array(w, np.int64)).tolist()] == plain_runs(w), w


def test_range_successor_of_the_wavelet_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 500):
        values = rng.permutation(n)
        tree = runs.Wavelet(values, n)
        low = rng.integers(0, n, 50)
        high = np.minimum(n, low + 1 + rng.integers(0, n, 50))
        x = rng.integers(0, n, 50)
        assert tree.below(low, high, x).tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(low, high, x, strict=True)]
        k = (high - low) // 2
        assert tree.smallest(low, high, k).tolist() == [sorted(values[a:b].tolist())[c] for a, b, c in zip(low, high, k, strict=True)]


def plain_document(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_runs_of_documents(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("abcdefghijklmnopqrst"[x] for x in random_words(rng)) for _ in range(150)]
    texts += [None, "", " \n\t ", "one", "x " * 3000, ("long way home " * 900) + "end", "no break no break no break no break no break", texts[3], "ha " * 6, "ha " * 5, "a b " * 4, "a b a b a b a"]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, "go " * 9, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, words long")
    key = lambda r: repr(r)
    want = sorted((plain_document(r[0], r[1]) for r in rows), key=key)
    assert sorted((tuple(r) for r in runs.periodic_runs(docs).collect()), key=key) == want
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    sliced = "\n".join(texts[k] for k in range(150))  # words across slices
    monkeypatch.setattr(runs, "SLICE", 7)
    words, vocabulary = runs.numbered(sliced)
    assert [vocabulary[k] for k in words] == sliced.encode().split()


# ---- the prefix trie


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: (y[:3], hashlib.md5(f"{len(y[2])}:{y[2]}{y[3]}".encode()).digest()))] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:])
    members, children, out = defaultdict(list), defaultdict(list), {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    for s in sorted(members, key=len, reverse=True):
        ends = ",".join(map(str, sorted(c for c in members[s] if len(built[c]) == len(s))))
        saved = sum(out[k][6] for k in children[s]) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
        out[s] = (min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(children[s]), sum(out[k][5] for k in children[s]) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def conversations(rng):
    rows = []
    for c in [*range(40), 103, 104, 117, 1001, 1002, -7, -3]:
        if c in (20, 35):  # their base is absent
            continue
        for t in range(rng.choice([1, 2, 3, 8, 12])):
            text = rng.choice(["a", "bb", "ü", None, "", "long " * 30]) if rng.random() < 0.8 or t < 2 else str(rng.random())
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), text))
    for c in (200, 201, 202, 203, 204, 300, 301, 401):
        rows += [(c, 0, "user", "x"), (c, 1, "assistant", "y"), (c, 2, "user", "z")]
    rows += [(300, t, "user", f"{t}") for t in range(3, 40)] + [(None, 1, "user", "lost"), rows[0], rows[5], (500, 0, "us", "er:x"), (505, 0, "user", ":x")]
    rng.shuffle(rows)
    return rows


def test_prefix_trie(spark):
    rng = random.Random(3)
    rows = conversations(rng)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, n_convs string")
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr) == plain_trie(rows)


def test_prefix_trie_of_a_conversation_cut_by_tasks(spark):
    """One conversation holds most turns, so its sums go over many tasks; one sequence has most members."""
    rng = random.Random(4)
    rows = [(6, t, "user", f"{t}") for t in range(600)] + [(c, t, "user", f"{t}") for c in range(1000, 1200, 5) for t in range(4)] + [(7, 0, "user", "0"), (9, 3, "user", None)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- embeddings


def direction(v):
    if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
        return None
    x = np.array(v, np.float64) / max(map(abs, v))
    return x / np.linalg.norm(x)


def plain_links(rows, threshold=0.95):
    units = [direction(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], links[i], least.get(root(i)), r[0] == least.get(root(i))) for i, r in enumerate(rows)]


def vectors(rng, d, wide):
    out = []
    for _ in range(40):
        c = rng.standard_normal(d)
        c /= np.linalg.norm(c)
        for _ in range(rng.integers(1, 10)):
            o = rng.standard_normal(d)
            o -= o @ c * c
            s = rng.uniform(0.9, 1)
            out.append((s * c + (1 - s * s) ** 0.5 * o / np.linalg.norm(o)).tolist())
    c = rng.standard_normal(d)
    out += [(c + 0.17 * rng.standard_normal(d)).tolist() for _ in range(wide)]
    return out


@pytest.mark.parametrize("kind", ["double", "float"])
def test_embedding_links(spark, kind):
    """Clusters around the threshold, a dense group over many tiles, copies, and vectors without a direction; at least 0.99 of all links, and none below it."""
    rng = np.random.default_rng(3)
    given = vectors(rng, 24, 600)
    given += [given[0]] * 5 + [[2 * x for x in given[1]], None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [2.0], [-2.0], [5.0], [1e30] * 24, [1e-30] * 24]
    if kind == "float":
        given = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in given]
    rows = [(k, v) for k, v in enumerate(given)] + [(None, given[0]), (None, [7.0, -7.0]), (3, given[3])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, n_links string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=key), sorted(plain_links(rows), key=key)
    assert [r[0] for r in got] == [r[0] for r in want] and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert sum(a[2:] == b[2:] for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)
    plain = {k for k, v in enumerate(given) if direction(v) is None}
    assert all(r[1:] == (0, r[0], True) for r in got if r[0] in plain)


def test_embedding_links_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(1, None), (None, None)], df.schema)).orderBy("vec_id").collect()] == [(None, 0, None, True), (1, 0, 1, True)]


def test_blocks_reach_their_recall_and_narrow_the_search():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = embeddings.quantisers(list(x), len(x), 0.95, 0.995)[64]
    fresh = rng.standard_normal((2000, 64))
    fresh /= np.linalg.norm(fresh, axis=1, keepdims=True)
    near = embeddings.Quantiser._at(fresh, rng.standard_normal(fresh.shape), 0.95)
    a, b = q.values(fresh), q.values(near)
    assert (a == b).any(axis=1).mean() > 0.98
    assert (a[:-1] == a[1:]).any(axis=1).mean() < 0.05  # unrelated vectors seldom meet
    assert abs((fresh @ q.map > 0).mean() - 0.5) < 0.02  # balanced
