"""Spans of a reference table, against a plain version."""

from __future__ import annotations

import hashlib

import pytest

from tracemill.llm import reference_spans

from .test_operators import DOCS, corpus, split_words

REFERENCE = "body string, doc_id string, automaton int"


def plain(rows, texts, window):
    known = set()
    for t in texts:
        w = split_words(t)
        known |= {tuple(w[k : k + window]) for k in range(len(w) - window + 1)}
    out = []
    for r in rows:
        w = split_words(r[1])
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            if tuple(w[k : k + window]) in known:
                covered[k : k + window] = [True] * window
        kept = b" ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out.append((r[0], len(w), sum(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "shard_words", "batch_bytes"), [(35, 50_000, 1 << 27), (12, 70, 3000)])
def test_spans_of_a_reference(spark, window, shard_words, batch_bytes):
    rows = corpus(n=60)
    words = [split_words(r[1]) for r in rows if r[1]]
    longest = max(words, key=len)
    # a slice of a text, whole texts, a long text of all passages, odd and short ones
    texts = [b" ".join(words[3][5:60]).decode(), rows[12][1], " ".join(b" ".join(w[-80:]).decode() for w in words[:30]), b" ".join(longest[:50]).decode(), None, "", "one two"]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    reference = spark.createDataFrame([(t, "x", k) for k, t in enumerate(texts)], REFERENCE).repartition(3)
    found = reference_spans.remove_reference_spans(docs, reference, window, shard_words, batch_bytes, reference_text="body").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == plain(rows, texts, window)
    assert any(r.n_removed for r in found) and all(sum(r.lengths) == r.n_removed and all(x >= window for x in r.lengths) for r in found)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_several_batches_are_made(spark):
    automata = spark.createDataFrame([(b"x" * 40,)] * 7, "automaton binary")
    assert [len(b) for b in reference_spans._batches(automata, 90)] == [2, 2, 2, 1]
    assert [len(b) for b in reference_spans._batches(automata, 10)] == [1] * 7


def test_no_reference_and_no_documents(spark):
    docs, none = spark.createDataFrame(corpus(n=5), DOCS), spark.createDataFrame([], DOCS)
    assert all(r.n_removed == 0 and not r.starts for r in reference_spans.remove_reference_spans(docs, none).collect())
    assert reference_spans.remove_reference_spans(none, docs).collect() == []
