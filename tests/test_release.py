"""The release job: what it writes, what stops it, and what a reader sees."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tracemill.operators import publish
from tracemill.sources import commits

KEYS = publish.Keys("salt", {"P": "A"})
REQUESTS = "request_id string, session_id string, step int, link string, end_ms long, latency_ms long, ttft_ms long, model_id string, provider string, stream boolean, turn string, prompt_tokens long, completion_tokens long, cache_read_tokens long, stated_reason string, transition string, cause string"
FACTS = "request_id string, n_messages long, role_tokens map<string,long>, tool_definition_names array<string>, unknown_role string, block_hashes array<long>"


def week(spark, blocks=((5, 6), (5, 7)), role=None, provider="P"):
    requests = spark.createDataFrame([("q0", "raw-session-one", 0, None, 100, 10, 3, "m", provider, True, "user", 1, 2, None, "stop", None, None), ("q1", "raw-session-one", 1, "text", 300, None, None, "m", None, False, "tool", 1, 2, 1, None, "append", None)], REQUESTS)
    facts = spark.createDataFrame([(f"q{k}", 2, {"user": 4}, ["Read", "X", None], role, list(b)) for k, b in enumerate(blocks)], FACTS)
    sessions = spark.createDataFrame([("raw-session-one", "u", "pi", None, None, None), ("raw-session-two", "u", "pi", "raw-session-one", "q1", 0)], "session_id string, user_id string, harness string, spawned_by_session_id string, spawned_by_request_id string, spawned_by_call_index int")
    calls = spark.createDataFrame([("raw-session-one", 0, 0, "Read", "Read", "ok", 5)], "session_id string, step int, call_index int, name string, category string, outcome string, result_tokens long")
    calls = calls.select("*", F.lit(None).cast("array<string>").alias("programs"), F.lit(None).cast("string").alias("parse_status"), F.lit("{}").alias("arguments_skeleton"))
    public = spark.createDataFrame([("read",)], "word string")
    rows = publish.request_rows(requests, facts, calls, public, KEYS)
    waited = rows.select(F.lit("raw-session-one").alias("session_id"), "step", "waited_for", "start_ms", "end_ms")
    hidden = publish.call_rows(calls, waited.withColumn("session_id", publish.session_id(F.col("session_id"), KEYS)), sessions, public, KEYS)
    parts = {"sessions": publish.session_rows(sessions, requests, KEYS), "requests": publish.with_block_ids(rows), "tool_calls": hidden}
    return parts, sessions.select(F.col("session_id").alias("id"))


def release(spark, folder, name="w1", allowed=None, **options):
    parts, ids = week(spark, **options)
    return publish.publish(spark, folder, name, parts, ids, allowed or {}, {"tokenizer": "t", "excluded_sessions": {}}, KEYS)


def test_a_week_is_released_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/release"
    manifest = release(spark, folder)
    assert manifest["distinct_block_ids"] == 3 and [sum(f["rows"] for f in manifest["files"][t]) for t in publish.TABLES] == [2, 2, 1]
    for t in publish.TABLES:
        for f in manifest["files"][t]:
            raw = (tmp_path / "release" / manifest["folder"] / t / f["path"]).read_bytes()
            assert (len(raw), hashlib.sha256(raw).hexdigest()) == (f["bytes"], f["sha256"])
    r = publish.read(spark, folder, "requests").orderBy("step").collect()
    assert [x.block_ids for x in r] == [[1, 2], [1, 3]] and [x.start_ms for x in r] == [90, 300] and [x.link_reason for x in r] == [None, "assistant_message"]
    assert r[0].provider == "A" and r[1].provider is None and r[1].waited_for == "tool" and r[0].tool_definition_names == ["read", "other", None] and r[0].role_tokens.user == 4 and r[0].role_tokens.tool is None
    s = {x.parent_session_id: x for x in publish.read(spark, folder, "sessions").collect()}
    top = s.pop(None)
    assert s[top.session_id].spawned_by_step == 1 and top.session_id != "raw-session-one" and len(top.session_id) == 32
    assert publish.read(spark, folder, "tool_calls").first().latency_ms == 200
    assert publish.damaged(spark, folder).count() == 0


def test_a_run_that_dies_or_fails_the_gate_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/release"
    with pytest.raises(publish.PrivacyError, match="harness"):
        release(spark, folder, allowed={"harness": F.col("value") == "other"})
    with pytest.raises(ValueError, match="not released"):
        publish.read(spark, folder, "requests")
    monkeypatch.setattr(publish.tables, "written_files", lambda *_: (_ for _ in ()).throw(OSError("dies")))
    with pytest.raises(OSError, match="dies"):
        release(spark, folder)
    monkeypatch.undo()
    assert publish.manifests(spark, folder) == {}
    for options in ({"role": "critic"}, {"provider": "unknown"}):
        with pytest.raises(Exception, match="critic|unknown provider"):
            release(spark, folder, **options)
    release(spark, folder, "w2")
    with pytest.raises(ValueError, match="w1"):
        publish.read(spark, folder, "requests", ["w1", "w2"])


def test_a_week_released_again_takes_the_place_of_the_old(spark, tmp_path):
    folder = f"file://{tmp_path}/release"
    release(spark, folder)
    release(spark, folder, "w2")
    release(spark, folder, blocks=((1, 2), (3, 4)))
    found = {x.week: x.n for x in publish.read(spark, folder, "requests").groupBy("week").agg(F.max(F.array_max("block_ids")).alias("n")).collect()}
    assert found == {"w1": 4, "w2": 3} and commits.numbers(spark, f"{folder}/_manifests") == [1, 2, 3]
    assert not commits.create(spark, f"{folder}/_manifests", 2, "late") and len(commits.read_all(spark, f"{folder}/_manifests")) == 3
    file = next((tmp_path / "release" / publish.manifests(spark, folder)["w1"]["folder"] / "sessions").glob("*.parquet"))
    file.write_bytes(file.read_bytes() + b"x")
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert [(r.week, r.table) for r in publish.damaged(spark, folder).collect()] == [("w1", "sessions")]
    file.unlink()
    assert [(r.week, r.table, r.path) for r in publish.damaged(spark, folder).collect()] == [("w1", "sessions", file.name)]
