"""The corpus pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import jaccard, norm, plain_counts, plain_fingerprint, shingle_words
from tracemill.llm import quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(k, sentence(rng.randint(15, 30))) for k in range(6)]
    common = sentence(20)
    texts = []
    for k in range(70):
        text = "\n".join(sentence(rng.randint(15, 40)) for _ in range(4))
        if k % 7 == 1:
            text = f"{common}\n{text}"
        if k % 7 == 2:
            text = f"{text} {items[k % 6][1]}"
        if k % 7 == 3:
            text = texts[k - 2]
        if k % 7 == 4:
            text = texts[k - 4].replace("a", "b", 1)
        if k % 7 == 5 and k % 2:
            text = "short text"
        texts.append(text)
    texts += [None, "", "same " * 200]
    return [(k, t, "en", f"s{k % 3}", len(t) if t is not None else None) for k, t in enumerate(texts)], items


def plain_quality(rows):
    failed = {d: plain_counts(t)[5] for d, t, *_ in rows}
    by = defaultdict(list)
    for d, _, _, source, _ in rows:
        by[source].append(failed[d])
    rates = [np.mean(x) for x in by.values()]
    m, v, q = np.mean(rates), np.var(rates, ddof=1), np.mean([1 / len(x) for x in by.values()])
    between = v - m * (1 - m) * q
    s = max(1.0, m * (1 - m) / between - 1) if between > 0 else quality_rules.PRIOR_DOCUMENTS
    bad = {k for k, x in by.items() if (sum(x) + m * s) / (len(x) + s) >= quality_rules.MAX_HOST_RATE}
    return [r for r in rows if not failed[r[0]] and r[3] not in bad]


def grouped(count, link):
    parent = list(range(count))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(count):
        for j in range(i):
            if root(i) != root(j) and link(i, j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(count)]


def plain_lines(rows):
    distinct = list(dict.fromkeys(norm(x) for _, t, *_ in rows for x in (t or "").split("\n") if norm(x)))
    root = dict(zip(distinct, grouped(len(distinct), lambda i, j: jaccard(distinct[i], distinct[j]) >= 0.8), strict=True))
    seen, out = set(), []
    for d, t, lang, source, _ in rows:
        kept = []
        for x in (t or "").split("\n"):
            if not norm(x) or root[norm(x)] not in seen:
                kept.append(x)
            if norm(x):
                seen.add(root[norm(x)])
        out.append((d, "\n".join(kept), lang, source, len("\n".join(kept))))
    return out


def plain_near(rows):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = grouped(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    return [r for k, r in enumerate(rows) if roots[k] == k]


def plain_clean(rows, items):
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = []
    for r in rows:
        d, hit = shingle_words(r[1]), False
        for _, t in items:
            b = Counter(grams(shingle_words(t)))
            n = sum(b.values()) + 4
            for at in range(max(1, len(d) - n + 1)):
                a = Counter(grams(d[at : at + n]))
                hit = hit or bool(a) and sum((a & b).values()) >= 0.8 * sum((a | b).values())
        if not hit:
            out.append(r)
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items = corpus()
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"file://{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{sf}/benchmark.parquet")
    return f"file://{sf}", rows, items


def test_stages(spark, tables):
    sf, rows, items = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = rows
    for k, ((name, stage), same) in enumerate(zip(corpus_pipeline.STAGES, (plain_quality, plain_lines, plain_near, lambda r: plain_clean(r, items), None), strict=True)):
        found = stage(spark, docs, sf)
        if same is None:
            break
        before = len(plain)
        plain = same(plain)
        assert found.columns == docs.columns, name
        found.write.parquet(f"{sf}/stage-{k}")
        docs = spark.read.parquet(f"{sf}/stage-{k}")
        assert sorted(map(tuple, docs.collect())) == sorted(plain), name
        assert len(plain) < before or name == "line_dedup"
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = [(d, len(library.encode(t, add_special_tokens=False).ids) + 1) for d, t, *_ in plain]
    assert sorted((r.doc_id, r.length) for r in found.collect()) == sorted(lengths)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.length) for r in whole) == sorted(lengths)


def test_empty(spark, tables):
    sf, *_ = tables
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
