"""Each operator against a plain version, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tracemill.llm import chat, classifier, decontaminate, lines, packing, quality_rules, simhash, sstable, substring, token_counts
from tracemill.llm.common import new_folder
from tracemill.llm.components import components
from tracemill.llm.tokens import MemoTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\f\r"


def split_words(text):
    return (text or "").encode().split()


def corpus(seed=1, n=120):
    """Documents with copies, near copies, shared passages, repeated lines, odd texts and nulls."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = sentence(60), sentence(14)
    texts = []
    for k in range(n):
        kind = k % 8
        text = "\n".join(sentence(rng.randint(5, 30)) for _ in range(rng.randint(1, 6)))
        if kind == 1 and texts:
            text = rng.choice([t for t in texts if t])
        elif kind == 2 and texts:
            words = rng.choice([t for t in texts if t]).split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = f"{text}\n{passage}\n{line}"
        elif kind == 4:
            text = f"{line}\n{text}\n{line.upper()}"
        texts.append(text)
    texts += [None, "", " \n\t ", "one", "a b c", "x " * 9000, "Étion ퟿   <|endoftext|> \\<>", "und " * 80, "a  b c　d"]
    return [(k, t, None if k % 9 == 0 else "en", None if k % 11 == 0 else f"s{k % 3}", None) for k, t in enumerate(texts)] + [(3, texts[3], "en", "s0", 1), (None, "no id here", None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("row", "h", "w", "block", "band", "lid", "node", "root", "digest", "fp", "n", "x0", "length", "turn", "__key", "__left", "__copy", "__row", "__fp", "__id", "__gone", "__rules", "left", "kept", "key", "id")}
    return spark.createDataFrame(rows, DOCS).withColumns(extra).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def same(found, wanted):
    assert Counter(map(tuple, found)) == Counter(map(tuple, wanted))


def plain_substrings(rows, window=35):
    seen = Counter()
    words = [split_words(t) for _, t, *_ in rows]
    for w in words:
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])] += 1
    out = []
    for (doc, *_), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings(docs, rows, hot):
    found = substring.dedup_substrings(docs, hot=hot, with_text=False).drop("kept").collect()
    same(found, plain_substrings(rows))
    assert any(r.n_removed for r in found)


def test_substrings_of_nothing(empty):
    assert substring.dedup_substrings(empty).collect() == []


def test_automaton_matches():
    rng = random.Random(3)
    for _ in range(100):
        texts = [[rng.randrange(3) for _ in range(rng.randint(1, 15))] for _ in range(3)]
        automaton = substring.SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        query = [rng.randrange(3) for _ in range(20)]
        for k, (size, _) in enumerate(automaton.matches(query, 6)):
            assert size == max(n for n in range(7) if n <= k + 1 and (n == 0 or tuple(query[k + 1 - n : k + 1]) in held))


def test_classifier(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for k in range(1200):
        good = k % 4 != 0
        words = [word() for _ in range(rng.randint(20, 200))]
        rows.append((k, " ".join(words) + "." if good else " ".join(w.upper() + "!!" if k % 8 else w + "$$$" for w in words)))
        if k % 3:
            labels.append((k, int(good), 0))
    rows += [(None, "text"), (5000, None), (5001, ""), (7, rows[7][1])]
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = classifier.quality_scores(docs, truth).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert classifier.quality_scores(docs.limit(0), truth).collect() == []
    assert {r.score for r in classifier.quality_scores(docs, truth.limit(0)).collect()} == {0.5}


def test_classifier_against_plain_numpy(spark):
    """The same scores from one dense least-squares solution and the min-max form of isotonic regression."""
    rng = random.Random(15)
    rows, labels = [], []
    for k in range(400):
        words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))]
        good = rng.random() < (0.8 if k % 3 else 0.2)
        rows.append((k, " ".join(words) + ("." if k % 3 else " $$$ !!!"), "clash", "clash"))
        labels.append((k, int(good)))
    rows += [(3, rows[3][1], "x", "y"), (400, "word " * 200_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x0 string, y string").repartition(4)
    found = {(r.doc_id, r.held_out): r.score for r in classifier.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    x = np.array([classifier.statistics(t) for _, t, *_ in rows])
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1
    seeded = np.random.default_rng(classifier.SEED)
    w = seeded.normal(size=(x.shape[1], classifier.FEATURES)) / np.sqrt(x.shape[1])
    phase = seeded.uniform(0, 2 * np.pi, classifier.FEATURES)
    z = np.clip((x - x.mean(axis=0)) / scale, -6, 6)
    design = np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / classifier.FEATURES) * np.cos(z @ w + phase)])
    quality = dict(labels)
    fold = np.array([zlib.crc32(str(d).encode()) % 4 for d, *_ in rows])
    y = np.array([quality.get(d, -1) for d, *_ in rows], float)
    teach = (y >= 0) & (fold != 2) & (fold != 3)
    ridge = np.sqrt(classifier.RIDGE * teach.sum()) * np.eye(design.shape[1])
    beta = np.linalg.lstsq(np.vstack([design[teach], ridge]), np.concatenate([y[teach], np.zeros(len(ridge))]), rcond=None)[0]
    raw = design @ beta
    held = (y >= 0) & (fold == 3)
    bins = np.clip(np.round(raw[held] * classifier.BINS), -classifier.BINS, 2 * classifier.BINS)
    at = np.unique(bins)
    n, p = (np.array([f(bins == b) for b in at], float) for f in (np.sum, lambda m: y[held][m].sum()))
    rate = [max(min(p[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]
    groups = [np.flatnonzero(np.isclose(rate, v)) for v in sorted({round(v, 12) for v in rate})]
    centre = np.array([(at[g] * n[g]).sum() / n[g].sum() / classifier.BINS for g in groups])
    wanted = np.interp(raw, centre, [rate[g[0]] for g in groups])
    assert max(abs(found[d, bool(f == 2)] - s) for (d, *_), f, s in zip(rows, fold, wanted, strict=True)) < 1e-6


def test_isotonic():
    at, value = classifier.isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(value) >= 0).all() and at[0] == 0


def norm(line):
    return " ".join(x.decode() for x in line.encode().split()).lower()


def jaccard(a, b, k=5):
    grams = lambda s: {s[i : i + k] for i in range(max(1, len(s) - k + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def plain_lines(rows):
    """Kept lines of each row by exact comparison of all pairs of distinct lines."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    distinct = list(dict.fromkeys(norm(x) for k in order for x in (rows[k][1] or "").split("\n") if norm(x)))
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in distinct]
    for i in range(len(distinct)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    index = {x: k for k, x in enumerate(distinct)}
    seen, out = set(), []
    for k in order:
        kept = []
        for x in (rows[k][1] or "").split("\n"):
            group = root(index[norm(x)]) if norm(x) else None
            if group is None or group not in seen:
                kept.append(x)
            seen.add(group)
        out.append((rows[k][0], hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines(docs, rows, empty):
    unique = [r for k, r in enumerate(rows) if r[0] != 3 or k == 3]  # which of two equal rows stays is not fixed
    found = lines.removed_lines(docs.sparkSession.createDataFrame(unique, DOCS).repartition(3))
    same([(r.doc_id, r.text_sha256) for r in found.collect()], plain_lines(unique))
    deduped = lines.dedup_lines(docs)
    assert deduped.columns == docs.columns and deduped.count() == len(rows)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in deduped.collect())
    texts = [r.text for r in deduped.filter("doc_id = 3").collect()]
    assert sorted(map(bool, texts)) in ([False, False], [False, True])
    assert lines.removed_lines(empty).collect() == [] and lines.dedup_lines(empty).collect() == []


def test_band_recall():
    rng = random.Random(2)
    hits = tries = 0
    for _ in range(150):
        a = "".join(rng.choice("abcdefgh ") for _ in range(300))
        b = list(a)
        for k in rng.sample(range(300), 6):
            b[k] = "z"
        b = "".join(b)
        if jaccard(a, b) >= 0.8:
            keys = lines.band_keys(lines.signatures([a, b]))
            tries += 1
            hits += bool((keys[0] == keys[1]).any())
    assert tries > 50 and hits / tries > 0.97


def test_recall_on_the_documents_table(spark):
    """Removals against all pairs of the distinct lines of the smallest table: at least 0.99 of what brute force removes, and nothing else."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in table.collect()]
    wanted, found = dict(plain_lines(rows)), {r.doc_id: r for r in lines.removed_lines(table).collect()}
    kept = {d: "\n".join(x for x in (t or "").split("\n")) for d, t, *_ in rows}
    changed = [d for d in kept if hashlib.sha256(kept[d].encode()).hexdigest() != wanted[d]]
    right = sum(found[d].text_sha256 == wanted[d] for d in changed)
    assert len(changed) > 50 and right >= 0.99 * len(changed)
    assert all(found[d].n_removed == 0 for d in kept if d not in changed)


def test_signatures_of_short_and_wide_lines():
    texts = ["a", "ab", "abcde", "abcdef", "é" * 9, "中文字符" * 40, "x" * 5000, "\U0001f600 smile"]
    alone = [lines.signatures([x])[0].tolist() for x in texts]
    assert alone == lines.signatures(texts).tolist()
    sets = lines._sets(texts, 5)
    plain = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in texts]
    assert [len(x) for x in sets] == [len(x) for x in plain]
    wide = ["".join(map(chr, range(0x4E00, 0x4E00 + 5000))), "".join(map(chr, range(0x4E01, 0x4E00 + 5000)))]
    assert lines._sets(wide, 5) is None  # compared as plain sets


def template_lines():
    """Lines of one template that are mostly below the similarity, with planted pairs that reach it, and a chain of near copies."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, out = word(60), []
    for _ in range(150):
        own = word(20)
        out += [f"{head} {own}", f"{head} {own[:-8]}{word(8)}"]
    out += [f"{head} {word(20)}" for _ in range(300)] + [f"{word(70)} page {k}" for k in range(20)]
    page = word(70)
    out += [f"{page} page {k} of 90" for k in range(90)]
    return sorted(set(out), key=lambda x: hashlib.md5(x.encode()).digest())


def test_pairs_in_a_template_bucket(spark):
    texts = template_lines()
    grams = [{x[i : i + 5] for i in range(len(x) - 4)} for x in texts]
    keys = lines.band_keys(lines.signatures(texts))
    near = [(a, b) for b in range(len(texts)) for a in range(b) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    banded = [(a, b) for a, b in near if (keys[a] == keys[b]).any()]

    def roots(links):
        parent = {}
        for a, b in links:
            x, y = a, b
            while parent.get(x, x) != x:
                x = parent[x]
            while parent.get(y, y) != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        return [root(x) for x in range(len(texts))]

    plain = roots(near)
    assert len(banded) > 100 and len(set(plain)) > 100
    table = spark.createDataFrame(list(enumerate(texts)), "lid long, line string").repartition(3)
    for options in ({}, {"bucket": 6, "tile": 16}, {"bucket": 6, "tile": 4}):
        found = roots([(r.node, r.root) for r in lines.near_roots(table, **options).collect()])
        assert all(found[a] == found[b] for a, b in banded)
        assert all(plain[x] == plain[r] for x, r in enumerate(found))


def test_large_buckets_across_batches():
    import pyarrow as pa

    bands = [1] * 2 + [2] * 9 + [3] + [4] * 5 + [5] * 3
    cols = [pa.array(bands), pa.array(range(len(bands))), pa.array([0] * len(bands))]
    whole = pa.RecordBatch.from_arrays(cols, names=["band", "lid", "sketch"])
    for size in (1, 2, 3, 100):
        parts = [whole.slice(k, size) for k in range(0, len(bands), size)]
        got = [r for b in lines._propose(3)(iter(parts)) for r in b.to_pylist()]
        large = {(r["a"], r["band"]) for r in got if r["b"] is None}
        pairs = {(r["a"], r["b"]) for r in got if r["b"] is not None}
        assert large == {(k, b) for k, b in enumerate(bands) if b in (2, 4)}
        chain = {(s, k) for s, n in ((2, 9), (12, 5)) for k in range(s + 1, s + n)} | {(k - 1, k) for s, n in ((2, 9), (12, 5)) for k in range(s + 1, s + n)}
        assert pairs == {(0, 1), (17, 18), (17, 19), (18, 19)} | chain


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, 5000 + k) for k in range(1, 200)] + [(None, 3), (7, 7), (1, 2), (1, 2)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    same(found, [(x, root(x)) for x in list(parent)])


def test_token_counts(docs, rows, empty, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    cache = new_folder(spark, "cache")
    wanted = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, *_ in rows]
    same(token_counts.token_counts(docs, path, cache).collect(), wanted)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, *_ in rows})
    same(token_counts.token_counts(docs, path, cache).collect(), wanted)
    assert spark.read.parquet(cache).count() == stored  # the second time all is known
    assert token_counts.token_counts(empty, path, new_folder(spark, "cache")).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_tokenizer(name):
    rng = random.Random(1)
    signs = [*" \t\n\x0b\f\r\x1c\x85\xa0  　᠎​aB9é'ΣßİÀ<|!.-́", "<|endoftext|>", "<|startoftext|>", "'ll", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    memo = MemoTokenizer(public_tokenizers.path(name))
    wanted = [e.ids for e in memo.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in memo.ids(texts)] == wanted
    assert memo.count(texts).tolist() == [len(x) for x in wanted]


def shingle_words(text):
    import re

    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 40)))) for k in range(30)] + [(90, "too short item"), (None, "an item without any id is ignored here"), (91, None)]
    items.append((92, items[0][1]))
    rows = []
    for k in range(200):
        words = [word() for _ in range(rng.randint(0, 80))]
        if k % 3 == 0:
            piece = items[k % 30][1].split()
            if k % 2:
                piece[0 if k % 4 == 1 else -1] = "changed"
            if k % 5 == 0:
                piece.insert(rng.randrange(len(piece)), "extra")
            if k % 7 == 0:
                del piece[rng.randrange(len(piece))]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in piece]
        rows.append((k, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " ".join(word() for _ in range(30_000)) + " " + items[1][1]), (0, rows[0][1]), (0, "another text of this id " + items[0][1]), (None, "no id " + items[3][1])]

    def grams(words):
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    wanted = set()
    for doc, text in set(rows):
        d = shingle_words(text or "")
        known = set(grams(d))
        for item, t in items:
            q = grams(shingle_words(t or ""))
            if item is None or not q or not known & set(q):
                continue
            n = len(q) + 4
            for at in range(max(1, len(d) - n + 1)):
                a, b = Counter(grams(d[at : at + n])), Counter(q)
                if a and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    wanted.add((doc, text, item))
    from pyspark.sql import functions as F

    clash = {c: F.lit("clash") for c in ("item", "item_id", "h", "m", "g", "w", "start", "fp", "row_key", "n", "c", "a", "block", "value", "__id", "__key")}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumn("m", F.lit(1))
    found = decontaminate.contaminations(docs, bench).collect()
    same([(r.doc_id, r.item_id) for r in found], [(d, i) for d, _, i in wanted])
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    same([(r.doc_id, r.text) for r in clean.collect()], [(d, t) for d, t in rows if (d, t) not in {(d, t) for d, t, _ in wanted}])
    assert sorted(r.item_id for r in decontaminate.unsearchable(bench).collect()) == [90, 91]
    assert decontaminate.contaminations(docs.limit(0), bench).collect() == [] == decontaminate.contaminations(docs, bench.limit(0)).collect()


def test_decontamination_between_alignments(spark):
    words = [f"w{k}" for k in range(59)]
    inserted = ["first", *words[1:29], "two", "more", *words[29:58], "last"]
    swapped = [*words[30:], *words[:30]]
    noise = [f"n{k}" for k in range(300)]
    rows = [(k, " ".join([*noise[:at], *piece, *noise[at:]])) for k, (at, piece) in enumerate((at, piece) for piece in (inserted, swapped) for at in (0, 1, 40, 250, 290, 300))]
    rows += [(50, " ".join(inserted)), (51, " ".join(noise))]

    def best(text):
        d, q = shingle_words(text), Counter(tuple(words[i : i + 5]) for i in range(55))
        out = 0
        for at in range(max(1, len(d) - 58)):
            a = Counter(tuple(d[at : at + 59][i : i + 5]) for i in range(len(d[at : at + 59]) - 4))
            out = max(out, sum((a & q).values()) / sum((a | q).values()))
        return out

    wanted = {k: best(text) for k, text in rows}
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = {r.doc_id: r.similarity for r in decontaminate.contaminations(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == pytest.approx({k: v for k, v in wanted.items() if v >= 0.8}) and len(found) > 6


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for d, f in prints:
        if d is not None:
            least[root(f)].append(d)
    wanted = [(d, f"{f:016x}", min(least[root(f)], default=None)) for d, f in prints]
    found = simhash.near_duplicates(docs).collect()
    same(found, wanted)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({root(f) for _, f in prints})
    assert simhash.near_duplicates(empty).collect() == [] == simhash.without_near_duplicates(empty).collect()


def test_tile_links_are_exact():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 60, 30)])
    x = np.unique(np.concatenate([base, near, near ^ np.uint64(7)]))
    q = simhash._quarters(x)
    x = x[np.lexsort(q.T[::-1])]
    a, b = simhash.tile_links(x, x, 4, True)
    parent = {int(v): int(v) for v in x}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for p, r in zip(a, b, strict=True):
        assert (p ^ r).bit_count() <= 4
        parent[max(root(p), root(r))] = min(root(p), root(r))
    for i, p in enumerate(x.tolist()):
        for r in x[:i].tolist():
            assert (p ^ r).bit_count() > 4 or root(p) == root(r)


def plain_counts(text):
    text = text or ""
    words = [w.decode() for w in split_words(text)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    own = [x for x in text.split("\n") if x.strip(SPACES)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(docs, rows, empty):
    found = quality_rules.quality_rules(docs, ["doc_id", "text", "source", "n"]).collect()
    same([(r.doc_id, *(r["__rules"][c] for c in quality_rules.COUNTS), r["__rules"].base_failed) for r in found], [(d, *plain_counts(t)) for d, t, *_ in rows])
    rates = {r.source: r["__rules"].host_rate for r in found}
    for source in rates:
        own = [r for r in found if r.source == source]
        rate = np.mean([r["__rules"].base_failed for r in own])
        overall = np.mean([np.mean([r["__rules"].base_failed for r in found if r.source == s]) for s in rates])
        assert min(rate, overall) - 1e-9 <= rates[source] <= max(rate, overall) + 1e-9
    assert all(r["__rules"].kept == (not r["__rules"].base_failed and r["__rules"].host_rate < quality_rules.MAX_HOST_RATE) for r in found)
    assert quality_rules.quality_rules(empty, ["doc_id"]).collect() == []


def test_bad_host_goes(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good if k % 10 else "short", "good") for k in range(100)] + [(100 + k, good if k % 10 == 0 else "short", "bad") for k in range(100)]
    found = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"]).collect()
    assert {r.source for r in found if r["__rules"].kept} == {"good"}


def test_shards_refuse_ids_that_do_not_fit(spark, docs):
    import io

    writer = sstable.Writer(io.BytesIO(), 2)
    writer.add(sstable.key_of(1), np.array([65_535]))
    with pytest.raises(ValueError, match="65536"):
        writer.add(sstable.key_of(2), np.array([65_536]))


def test_chat_batches_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chat, "BATCH_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), pa.array(["user"] * 5), pa.array(["abcd", None, "abcdef", "x" * 50, ""])], names=["conv_id", "turn", "role", "text"])
    parts = list(chat._bounded(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [3, 1, 1] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()


def test_shards(docs, rows, empty, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = sstable.write_shards(docs, new_folder(spark, "shards"), path, end_id=2)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    wanted, at, ids_of = [], 0, defaultdict(list)
    for d, t, *_ in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        wanted.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids_of[d].append(ids)
        at += len(ids)
    same(sstable.read_shards(manifest).collect(), wanted)
    for doc in (0, 3, 64, 127):
        assert [x.tolist() for x in sstable.lookup(manifest, doc)] == ids_of[doc]
    assert sstable.lookup(manifest, 99_999) == []
    reader = sstable.open_shard(manifest.select("path").first()[0])
    misses = sum(all(reader.bloom[p >> 3] >> (p & 7) & 1 for p in sstable._probes(sstable.key_of(k), 8 * len(reader.bloom))) for k in range(10_000, 12_000))
    assert misses < 200 and reader.lookup(10_000) == []
    assert sstable.read_shards(sstable.write_shards(empty, new_folder(spark, "shards"), path, end_id=2)).collect() == []


def test_keys_keep_order():
    ids = [None, -(1 << 63), -5, -1, 0, 1, 255, 256, 1 << 40, (1 << 63) - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = packing.pack(docs, path, size=256).collect()
    wanted = []
    for d, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        wanted += [(d, k // 256, k, len(p := ids[k : k + 256]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), 256)]
    same([tuple(r)[:5] for r in found], wanted)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.05 * -(-sum(w[3] for w in wanted) // 256) + 1
    assert packing.pack(empty, path).collect() == []


def test_plan_is_best_fit():
    rng = random.Random(8)
    for _ in range(40):
        size = rng.choice([10, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 200))]
        spaces = []  # best fit, one piece at a time
        for x in sorted(lengths, reverse=True):
            fit = [k for k, s in enumerate(spaces) if s >= x]
            if fit:
                spaces[min(fit, key=lambda k: spaces[k])] -= x
            else:
                spaces.append(size - x)
        slots = packing.plan(dict(Counter(lengths)), size)
        bins = {first + (r - a) // each for _, a, b, first, each, _ in slots for r in range(a, b)}
        assert len(bins) == len(spaces)


def test_chats(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a<b>\\"]), rng.choice([None, "", "héllo", "</turn>\n<turn assistant>", "\\", "\\<x>\\\\", "line\nline"])) for c in (*range(30), None) for t in range(rng.randint(1, 9))]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"), (1000, 0, "user", "x" * 300_000)] + [(2000, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(700)] + [rows[0]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as first_turn").repartition(6)
    parts = chat.format_chats(frame)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    found = chat.read_back(parts).collect()
    wanted = []
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1], hashlib.md5(x[2].encode()).hexdigest()))
        said = [t for _, r, t in turns if r == "assistant"]
        marks = sum(len("<turn ></turn>\n") + len(r + t) + sum(x in "\\<>" for x in r + t) for _, r, t in turns)
        wanted.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), marks))
    same(found, wanted)
    assert chat.read_back(chat.format_chats(frame.limit(0))).collect() == []
    with pytest.raises(ValueError):
        chat.parse(b"<turn user>cut")
