"""Streams against batch results: links with state over restarts, rows of other weeks, and the ledger."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import lineage
from tracemill.sources import ledger
from tracemill.streaming import linking, windows

SIGNALS = "request_id string, user_id string, end_ms long, emitted_ids array<string>, replayed_ids array<string>, answer_shingles array<string>, replayed_shingles array<string>"


def signals(n, seed):
    """Accounts with hundreds of requests, links to and beyond 128 back of both kinds, ties of time, and a null account."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        emitted = [f"e{k % 300}"] if rng.random() < 0.5 else []
        replayed = [f"e{(k - rng.randrange(1, 260)) % 300}"] if rng.random() < 0.3 else []
        answer = [f"p{(k // 3) % 50}-{i}" for i in range(10)] if rng.random() < 0.5 else []
        text = [f"p{(k // 3) % 50}-{i}" for i in range(rng.choice([8, 9, 10, 12]))] if rng.random() < 0.6 else []
        rows.append((f"r{k:04d}", rng.choice(["a", "a", "a", "b", None]), (k // 2 + 1) * 1000, emitted, replayed, answer, text))
    return rows


def test_links_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = signals(700, 1)
    put = lambda part: spark.createDataFrame(part, SIGNALS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        q = linking.linked(stream, "2 minutes").writeStream.option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return spark.read.parquet(f"file://{tmp_path}/out")

    mixed = [r for k in range(0, 700, 100) for r in random.Random(k).sample(rows[k : k + 100], 100)]  # late by 50 seconds at most
    for k in range(0, 400, 80):
        put(mixed[k : k + 80])
    before = run().count()
    assert 0 < before < 400  # the rest waits in the state
    put(mixed[400:])
    for k in (1, 2):
        put([(f"past{k}", "past", 10**10 * k, [], [], [], [])])
    links = {r[0]: (r[1], r[2]) for r in run().collect()}
    links.pop("past1")
    want = {r[0]: (r[1], r[2]) for r in lineage.links(spark.createDataFrame(rows, SIGNALS)).collect()}
    assert links == want and {k for _, k in want.values()} == {"tool_id", "text", None}


def test_window_of_recent_requests():
    recent = linking.Recent({}, 3)
    for rn, row in enumerate([("a", ["x"], ["p", "q"]), ("b", ["x"], []), ("c", [], ["p"])], start=1):
        assert recent.add(rn, row) is None
    assert recent.parent({"x"}, {"p"}) == ("b", "tool_id") and recent.parent(set(), {"p", "q"}) == ("c", "text")
    assert recent.add(4, ("d", [], [])) == 1 and recent.add(5, ("e", [], [])) == 2
    assert recent.parent({"x"}, {"q"}) == (None, None) and recent.emitted == {} and set(recent.phrases) == {"p"}


def test_rows_of_other_weeks_by_listener_and_by_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-{1 + k % 20:02d} 10:00:00" if k % 9 else None) for k in range(90)], "id long, t string").select("id", F.to_timestamp("t").alias("t"))
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    week = "2024-01-07"
    want = rows.agg(F.count_if(F.col("t").isNull()).alias("undated"), F.count_if(F.to_date("t").between("2024-01-07", "2024-01-13")).alias("week"), F.count("*").alias("n")).first()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    listener = windows.WeekRows()
    spark.streams.addListener(listener)
    try:
        q = windows.observed(stream, "t", week).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
        q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    expected = {"week": want.week, "other": want.n - want.week - want.undated, "undated": want.undated}
    assert listener.total() == expected and len(listener.batches) >= 3
    for _ in range(2):  # the second run loses its last commit and does that batch again
        windows.route_late(stream, f"file://{tmp_path}/out", week, "t", f"file://{tmp_path}/c2").awaitTermination(120)
        commits = sorted((tmp_path / "c2" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        commits[-1].unlink()
        (tmp_path / "c2" / "commits" / f".{commits[-1].name}.crc").unlink()
    assert windows.late_counts(spark, f"file://{tmp_path}/out").first().asDict() == expected
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/out/rows").count() == 90


def test_work_list_and_commits(spark, tmp_path):
    outputs = [ledger.Output("c", ("a", "b"), "1"), ledger.Output("a", ("x",), "1"), ledger.Output("b", ("x", "y"), "1")]
    sources = lambda **changed: spark.createDataFrame([(w, s, changed.get(f"{w}{s}", "0")) for w in ("w1", "w2") for s in ("x", "y")], "week string, source string, sha256 string")
    path = f"file://{tmp_path}/ledger"
    todo = lambda s, o=outputs: {(r.week, r.output, r.status) for r in ledger.work_list(s, o, ledger.read_ledger(spark, path)).collect()}
    assert todo(sources()) == {(w, o, "new") for w in ("w1", "w2") for o in "abc"}
    first = ledger.work_list(sources(), outputs, ledger.read_ledger(spark, path))
    assert ledger.commit(first.filter("week = 'w1'"), path) == 1 and ledger.commit(first.filter("week = 'w2'"), path) == 2
    assert todo(sources()) == set()
    assert todo(sources(w1y="7")) == {("w1", "b", "stale"), ("w1", "c", "stale")}
    assert todo(sources().filter("week = 'w1' or source = 'y'")) == {("w2", "a", "blocked"), ("w2", "b", "blocked"), ("w2", "c", "blocked")}
    assert todo(sources(), [*outputs[:2], ledger.Output("b", ("x", "y"), "2")]) == {(w, o, "stale") for w in ("w1", "w2") for o in "bc"}
    # a run that wrote rows and died before its commit is not read; a later commit goes on from the last
    spark.createDataFrame([("w1", "a", "bad", 9)], ledger.ROWS).write.parquet(f"{path}/rows-9-dead")
    assert todo(sources()) == set()
    assert ledger.commit(ledger.work_list(sources(w1x="5"), outputs, ledger.read_ledger(spark, path)), path) == 3
    assert todo(sources(w1x="5")) == set() and {r.output for r in ledger.work_list(sources(), outputs, ledger.read_ledger(spark, path)).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="depend on each other"):
        ledger.in_order([ledger.Output("a", ("b",), "1"), ledger.Output("b", ("a",), "1")])
