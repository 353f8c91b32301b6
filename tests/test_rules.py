"""Hand-written rows for the sharp rules."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.functions import rendering, shell, strings
from tracemill.operators import gaps, lineage, mutations, privacy, reuse, tokens, toolcalls, turns, whatif
from tracemill.sources import ledger, logs, traces
from tracemill.streaming import windows


def one(spark, value, kind="string", of=None):
    return spark.createDataFrame([(value,)], f"v {kind}").select(of(F.col("v")).alias("r")).first().r


SIGNALS = "request_id string, user_id string, end_ms long, emitted_ids array<string>, replayed_ids array<string>, answer_shingles array<string>, replayed_shingles array<string>"


def signal(i, user="u", emitted=(), replayed=(), answer=(), text=()):
    return (f"r{i:04d}", user, i, list(emitted), list(replayed), list(answer), list(text))


def test_links(spark):
    ten = [f"p{k}" for k in range(10)]
    rows = [signal(0, emitted=["a"]), signal(1, emitted=["b"])] + [signal(k) for k in range(2, 128)]
    rows += [signal(128, replayed=["a"])]  # 128 back: found
    rows += [signal(130, replayed=["b"])]  # 129 requests back (129 was skipped as a number, so count rows)
    rows += [signal(200, answer=ten), signal(201, emitted=["z"]), signal(202, answer=ten), signal(203, replayed=["z"], text=ten), signal(204, text=ten[:9]), signal(205, text=ten[:8])]
    rows += [signal(300, None, emitted=["n"]), signal(301, None, replayed=["n"])]
    found = {r.request_id: (r.parent_request_id, r.link) for r in lineage.links(spark.createDataFrame(rows, SIGNALS)).collect()}
    assert found["r0128"] == ("r0000", "tool_id")
    assert found["r0130"] == ("r0001", "tool_id")  # row 129 of the account, 128 after the second row
    assert found["r0203"] == ("r0201", "tool_id")  # a tool link wins over a nearer text link
    assert found["r0204"] == ("r0202", "text") and found["r0205"] == (None, None)  # nine tenths exactly
    assert found["r0301"] == ("r0300", "tool_id")  # the null account is one account
    far = [signal(0, emitted=["a"])] + [signal(k) for k in range(1, 129)] + [signal(129, replayed=["a"])]
    assert {r.request_id: r.link for r in lineage.links(spark.createDataFrame(far, SIGNALS)).collect()}["r0129"] is None
    with pytest.raises(Exception, match="repeated request_id"):
        lineage.links(spark.createDataFrame([signal(1), signal(1)], SIGNALS)).collect()


def test_chains_and_roots(spark):
    rng = random.Random(1)
    parent = {0: None} | {k: (None if rng.random() < 0.1 else rng.randrange(max(0, k - 4), k)) for k in range(1, 120)}
    rows = [(f"r{k:03d}", None if p is None else f"r{p:03d}", None if p is None else "tool_id", k, "pi", None) for k, p in parent.items()]
    frame = spark.createDataFrame(rows, "request_id string, parent_request_id string, link string, end_ms long, harness string, new_content_kind string")

    def path(k):
        return [k] if parent[k] is None else [*path(parent[k]), k]

    found = {r.request_id: r for r in lineage.chains(frame).collect()}
    tips = {}
    for k in parent:
        key = (len(path(k)), k)
        tips[path(k)[0]] = max(tips.get(path(k)[0], (0, 0)), key)
    chain = {k for _, tip in tips.values() for k in path(tip)}
    for k in parent:
        r = found[f"r{k:03d}"]
        assert (r.session_id, r.step, r.on_main_chain) == (f"r{path(k)[0]:03d}", len(path(k)) - 1, k in chain)
        assert (r.turn is None) == (k not in chain)


def test_spawns_claim_once(spark):
    spawn = "user_id string, session_id string, request_id string, call_index int, end_ms long, opening string"
    root = "user_id string, session_id string, start_ms long, first_user_text string"
    s = spark.createDataFrame([("u", "p", "p1", 0, 1_000_000, "do it"), ("u", "p", "p2", 0, 1_000_100, "do it"), ("u", "p", "p3", 0, 1_000_050, None), (None, "q", "q1", 0, 1_000_000, "do it")], spawn)
    r = spark.createDataFrame([("u", "c1", 1_000_020, "please do it"), ("u", "c2", 999_980, "do it now"), ("u", "c3", 5_000_000, "do it"), ("u", "p", 1_000_000, "do it"), (None, "c4", 1_000_000, "do it")], root)
    got = {x.request_id: x for x in lineage.match_spawns(s, r).collect()}
    assert got["p1"].child_session_id == "c2"  # equal distance: the earlier start
    assert got["p2"].child_session_id == "c1" and got["p2"].n_candidates == 2
    assert got["p3"].child_session_id is None and not got["p3"].has_prompt and got["q1"].child_session_id is None


def test_spawns_of_a_busy_account(spark, monkeypatch):
    """Equal to the plain greedy rule, without a frame of a whole account."""
    rng = random.Random(3)
    spawns = [("busy" if k % 3 else f"u{k % 7}", f"p{k % 40}", f"r{k}", k % 2, rng.randrange(4_000_000), rng.choice(["do", "go", "do it"])) for k in range(400)]
    starts = [("busy" if k % 4 else f"u{k % 7}", f"c{k}", rng.randrange(4_000_000), rng.choice(["do it now", "go", "no"])) for k in range(300)]
    taken, wanted = set(), {}
    for user, session, request, call, end, opening in sorted(spawns, key=lambda x: (x[4], x[2], x[3])):
        near = [(abs(start - end), start, c) for u, c, start, text in starts if u == user and -30_000 <= start - end <= 600_000 and c != session and opening in text and c not in taken]
        wanted[request] = min(near)[2] if near else None
        taken.add(wanted[request])
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *x: pytest.fail("a frame of a whole account"))
    s = spark.createDataFrame(spawns, "user_id string, session_id string, request_id string, call_index int, end_ms long, opening string")
    r = spark.createDataFrame(starts, "user_id string, session_id string, start_ms long, first_user_text string")
    assert {x.request_id: x.child_session_id for x in lineage.match_spawns(s, r).collect()} == wanted


def test_transitions(spark):
    kind = "session_id string, step int, model string, provider string, roles array<string>, hashes array<string>, notes array<boolean>, texts array<string>"
    cases = {
        "append": (["user"], ["a"], ["user", "assistant"], ["a", "b"]), "compaction": (["user", "user"], ["a", "b"], ["user"], ["N"]), "tool_definitions": (["tool_definitions", "user"], ["a", "b"], ["tool_definitions", "user"], ["x", "b"]),
        "system_prompt": (["system", "user"], ["a", "b"], ["system", "user"], ["x", "b"]), "other": (["user", "user"], ["a", "b"], ["user"], ["a"]), "dropped_turns": (["user", "user", "user"], ["a", "b", "c"], ["user", "user"], ["a", "c"]),
        "injection": (["user", "user"], ["a", "b"], ["user", "user", "user"], ["a", "x", "b"]), "tool_result": (["user", "tool"], ["a", "b"], ["user", "tool"], ["a", "x"]),
    }
    rows = []
    for name, (r0, h0, r1, h1) in cases.items():
        rows += [(name, 0, "m", "p", r0, h0, [False] * len(h0), h0), (name, 1, "m", "p", r1, h1, [h == "N" for h in h1], h1)]
    rows += [("span", 0, "m", "p", ["user"], ["a"], [False], ["hello world"]), ("span", 1, "m", "p", ["user"], ["b"], [False], ["hello big world"]), ("switch", 0, "m", "p", ["user"], ["a"], [False], ["t"]), ("switch", 1, "m2", "p", ["user"], ["a"], [False], ["t"])]
    got = {r.session_id: (r.transition, r.cause) for r in mutations.classify(spark.createDataFrame(rows, kind)).collect()}
    assert got.pop("append") == ("append", None) and got.pop("switch") == ("switch", None) and got.pop("span") == ("mutation", "injection")
    assert all(v == ("mutation", k) for k, v in got.items())


def plain_tally(reads, ttl, week_end):
    hits = reusable = dead = 0
    by = {}
    for b, a, c in sorted(reads, key=lambda r: (r[0], r[1])):
        by.setdefault(b, []).append((a, c))
    for rows in by.values():
        for k, (_, c) in enumerate(rows):
            nxt = rows[k + 1] if k + 1 < len(rows) else None
            hit = nxt is not None and nxt[0] - c <= ttl
            hits += hit
            stay = max(0, nxt[1] - c if hit else min(ttl, week_end - c))
            reusable, dead = reusable + stay * (nxt is not None), dead + stay * (nxt is None)
    return 16 * hits, 16 * (len(reads) - hits), 16 * reusable, 16 * dead


def test_replay(spark):
    rng = random.Random(2)
    rows, flat = [], []
    for k in range(80):
        start = k * 20_000 + rng.randrange(1000)
        end = start + rng.randrange(1, 60_000)
        for pos in range(3):
            b = rng.randrange(8)
            rows.append((f"s{k}", "w", "pi", 0, start, end, pos, b))
            flat.append((b, start / 1000, end / 1000))
    frame = spark.createDataFrame(rows, "session_id string, week string, harness string, step int, start_ms long, end_ms long, pos int, block_id long")
    got = {r.ttl: r for r in reuse.tallies(reuse.judged_reads(frame)).filter("policy = 'ttl_only'").collect()}
    end = max(f[2] for f in flat)
    for name, ttl in reuse.TTLS:
        r = got[name]
        assert np.allclose((r.hit_tokens, r.miss_tokens, r.reusable_token_seconds, r.dead_token_seconds), plain_tally(flat, ttl, end))


def test_outcomes(spark):
    flag = lambda text, e: one(spark, text, of=lambda v: strings.outcome(v, F.lit(e).cast("boolean")))
    assert flag("fine", True) == "error" and flag("Exit code: 1", False) == "error" and flag("Error: x", False) == "ok" and flag("Error: x", None) == "error"
    assert flag('{"success": true, "exit_code": 0}', None) == "ok" and flag('{"success": false}', None) == "error" and flag('{"status": "Denied"}', None) == "denied"
    assert flag('{"error": "none"}', None) == "ok" and flag('{"error": {"a": 1}}', None) == "error" and flag('{"returncode": 3, "x": ', None) == "error" and flag("", None) == "ok"


def test_id_keys(spark):
    assert set(one(spark, "call_abcdefgh_12", of=strings.emitted_keys)) == {"callabcdefgh12", "callabcdefgh"}
    assert one(spark, "short_1", of=strings.emitted_keys) == ["short1"] and one(spark, "__--", of=strings.emitted_keys) == []
    assert set(one(spark, "toolu_x1", of=strings.replayed_keys)) == {"toolux1", "x1"} and one(spark, None, of=strings.emitted_keys) == []


def test_times(spark):
    at = lambda t: one(spark, t, of=strings.completion_ms)
    assert at("2024-01-01T00:00:00.123999Z") == 1704067200123 and at("2024-01-01 00:00:00") == 1704067200000 and at("2024-01-01T01:00:00+01:00") == 1704067200000
    assert at("1969-12-31T23:59:59.5Z") == -500 and at("2024-02-30T00:00:00Z") is None and at("2024-01-01T24:00:00Z") is None and at("2024-01-01") is None and at(None) is None
    assert at("2024-01-01T00:00:00+24:00") is None and at("2024-01-01T00:00:00.5Z") == 1704067200500


def test_addresses(spark):
    ip = lambda t: one(spark, t, of=strings.holds_ip)
    assert ip("at 10.0.0.1,") and ip("::1") and not ip("1.2.3.4.5") and not ip("12:30") and not ip("a::b") and not ip("")


def test_spans_and_prefixes(spark):
    f = spark.createDataFrame([("abc", "abxc", True), ("abc", "xaybzc", False), ("", "abc", True), ("abc", "abc", True), ("ab", "ba", False)], "a string, b string, w boolean")
    assert all(r.got == r.w for r in f.select("w", mutations.one_span_apart(F.col("a"), F.col("b")).alias("got")).collect())
    g = spark.createDataFrame([([1, 2, 3], [1, 2, 4], 2), ([], [1], 0), ([1], [1, 2], 1), ([None, 2], [None, 3], 1)], "a array<int>, b array<int>, w int")
    assert all(r.got == r.w for r in g.select("w", whatif.common_prefix(F.col("a"), F.col("b")).alias("got")).collect())


def test_rank_bins_are_uneven(spark):
    n = 2001
    f = spark.createDataFrame([(k, float(k), 1.0) for k in range(n)], "id long, a double, b double")
    got = tokens.rank_bins(f, ["a", "id"], ["a", "b"]).collect()
    sizes = np.bincount(np.arange(n) * 200 // n)
    assert len(got) == 200
    means = pd.Series(range(n), dtype=float).groupby(np.arange(n) * 200 // n).mean()
    assert all(np.isclose(r.a, means[r.bin] / (means[r.bin] + 1)) for r in got) and set(sizes) == {10, 11}
    assert len(tokens.rank_bins(f.limit(5), ["a", "id"], ["a", "b"]).collect()) == 1


def plain_points(values, least):
    edges = np.geomspace(10.0, 3600.0, 27)
    v = values[values.g <= edges[-1]].assign(g=lambda x: x.g.clip(lower=edges[0]))
    out, held = [], []
    for _, part in v.groupby(pd.cut(v.g, edges, include_lowest=True), observed=False):
        held.append(part)
        if sum(map(len, held)) >= least:
            out.append(pd.concat(held))
            held = []
    if held and out:
        out[-1] = pd.concat([out[-1], *held])
    return sorted((float(x.g.median()), float(x.h.median()), len(x)) for x in out)


def test_retention_points(spark):
    rng = np.random.default_rng(3)
    f = pd.DataFrame({"g": np.concatenate([np.exp(rng.uniform(0, 9, 400)), [10.0, 3600.0, 5.0]]), "h": rng.uniform(0, 1, 403)})
    rows = spark.createDataFrame(f.rename(columns={"g": "idle_gap_s", "h": "hit_ratio"}))
    got = sorted((r.gap_s, r.hit_ratio, r.rows) for r in gaps.retention_points(rows).collect())
    assert np.allclose(got, plain_points(f, 20))
    assert gaps.retention_points(rows.limit(3)).collect() == []


def test_size_bins(spark):
    rng = np.random.default_rng(4)
    f = pd.DataFrame({"x": rng.integers(1, 400, 3000), "v": rng.normal(size=3000)})
    edges = np.unique(np.round(np.geomspace(1, np.percentile(f.x, 99), 22)))
    cut = pd.cut(f.x, edges, include_lowest=True)
    wanted = sorted((g.quantile(0.5), len(g), i.mid) for i, g in f.v.groupby(cut, observed=True) if len(g) >= 50)
    got = sorted((r.p50, r.n, r.mid) for r in tokens.size_bins(spark.createDataFrame(f), "x", ["v"]).collect())
    assert np.allclose(got, wanted)


def test_missing_prefix_is_an_error(spark):
    r = spark.createDataFrame([("s", 0, 0, 1, 10, None, "w", None)], "session_id string, step int, start_ms long, end_ms long, prompt_tokens long, transition string, week string, completion_tokens long")
    p = spark.createDataFrame([], "session_id string, step int, blocks int, shared_blocks int")
    with pytest.raises(Exception, match="no blocks"):
        whatif.step_facts(r, p).collect()


def test_forced_compaction(spark):
    rows = [("s", 0, "w", 899_990, 0, None, 0.0, False, 0.0, 0.0, 900_000), ("s", 1, "w", 100, 0, 1.0, 50.0, True, 50.0, 899_890.0, 900_000), ("s", 2, "w", 10, 0, 1.0, 5.0, False, 0.0, 0.0, 900_000), ("s", 3, "w", 200, 0, 1.0, 5.0, False, 0.0, 0.0, 900_000)]
    f = spark.createDataFrame(rows, "session_id string, step int, week string, prompt_tokens long, completion_tokens long, gap_s double, cached_if_warm double, is_reduction boolean, penalty double, removed_tokens double, compaction_tokens long")
    r = whatif.skip_sweep(f).filter("ttl = '5m' and read_price_cut = 1").first()
    assert (r.prefilled_tokens, r.cached_tokens, r.forced_compactions, r.skipped_reductions) == (899_990 + 5 + 200, 899_990 + 5 + 899_890, 1, 1)


def test_nested_lines(spark):
    lines = spark.createDataFrame([('{"session_id": "a", "requests": [{"step": 0, "tool_calls": [{"call_index": 0, "subagent": {"session_id": "b", "requests": [{"step": 0, "tool_calls": [{"call_index": 1, "subagent": {"session_id": "c", "requests": []}}]}]}}]}]}',), ("[1]",), ('{"x": 1}',), ("nope",)], "value string")
    sessions, requests, calls, bad = traces.flatten(lines)
    assert {(r.session_id, r.parent_session_id, r.spawned_by_call_index) for r in sessions.collect()} == {("a", None, None), ("b", "a", 0), ("c", "b", 1)}
    assert requests.count() == 2 and calls.count() == 2 and bad.count() == 3


def test_log_lines(spark):
    ok = {"request_id": "r", "user_id": "u", "timestamp": "2024-01-09T00:00:00Z", "status_code": 200, "latency_ms": 2.9, "stream": True, "prompt": "", "metadata": json.dumps({"user_agent": "x/1"})}
    values = [json.dumps(ok), json.dumps(ok | {"status_code": True}), json.dumps(ok | {"timestamp": 5}), "[]", "{", '"s"', json.dumps(ok | {"request_id": 7}), json.dumps(ok | {"user_id": "bad"})]
    f = logs.with_fields(spark.createDataFrame([(v,) for v in values], "value string"))
    first = f.first()
    assert (first.latency_ms, first.stream, first.prompt, first.user_agent, first.end_ms - first.start_ms) == (2, True, None, "x/1", 2)
    got = [r.outcome for r in logs.outcomes(f, ["bad"], F.lit("pi"), ["pi"]).collect()]
    assert got == ["kept", "status_not_200", "unreadable_record", "unparsable", "unparsable", "unparsable", "unreadable_record", "excluded_user"]


def test_split_weeks_keeps_old(spark, tmp_path):
    rows = [json.dumps({"timestamp": t}) for t in ("2024-01-06T23:59:59Z", "2024-01-07T00:00:00Z", "2024-01-08T00:00:00Z", "x")]
    f = logs.with_fields(spark.createDataFrame([(v,) for v in rows], "value string"))
    got = {r.week: (r.lines, r.written) for r in logs.split_weeks(f, f"file://{tmp_path}/w", ["2023-12-31_2024-01-06"]).collect()}
    assert got["2024-01-07_2024-01-13"] == (2, True) and not got["2023-12-31_2024-01-06"][1] and got[None] == (1, False)
    assert spark.read.text(f"file://{tmp_path}/w").count() == 2


def test_checked_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    m = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", "no"), ("c", "gone")], "path string, sha256 string")
    assert {r.path for r in traces.checked_files(spark, f"file://{tmp_path}", m).collect()} == {"b", "c"}


def test_ledger(spark):
    s = spark.createDataFrame([("w1", "h"), ("w2", "h")], "week string, sha256 string")
    done = spark.createDataFrame([("w1", "t", "h"), ("w2", "t", "old")], "week string, file string, sha256 string")
    assert [tuple(r) for r in ledger.stale(s, done, ["t"]).collect()] == [("w2", "t")]
    assert traces.find_weeks(s, ["w1", "w9"]).first().week == "w9"


def test_gate_finds_each_kind(spark):
    v = spark.createDataFrame([("t", "c", "raw-id-of-12c"), ("t", "c", "raw-id-11ch"), ("t", "c", "1.2.3.4"), ("t", "d", "BAD")], "`table` string, `column` string, value string")
    ids = spark.createDataFrame([("raw-id-of-12c",), ("raw-id-11ch",)], "id string")
    got = {(r.value, r.violation) for r in privacy.gate(v, ids, {"d": F.col("value").rlike("^[a-z]+$")}).collect()}
    assert got == {("raw-id-of-12c", "raw_id"), ("1.2.3.4", "address"), ("BAD", "form")}


def test_scopes_and_waits(spark):
    assert [one(spark, h, of=turns.scope_of) for h in ("pi", "eval:swe-bench")] == ["Agentic", "SWE-Bench"]
    w = lambda c: spark.sql("select 1").select(turns.waited_for(F.lit(1), F.lit("tool"), F.lit(c).cast("array<string>"))).first()[0]
    assert w(["Ask User", "Subagent"]) == "subagent" and w(["Ask User"]) == "ask_user_tool" and w(["Read"]) == "tool" and w(None) == "tool"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-06 23:00:00", "u"), ("2024-01-07 01:00:00", "u"), ("2024-01-20 00:00:00", "u")], "t string, user_id string").withColumn("ts", F.to_timestamp("t"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = windows.weekly_counts(stream, "ts", ["user_id"]).writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(120)
    assert sorted((str(r.window.start), r.rows) for r in spark.table("weekly").collect()) == [("2023-12-31 00:00:00", 1), ("2024-01-07 00:00:00", 1), ("2024-01-14 00:00:00", 1)]
    windows.route_late(stream, f"file://{tmp_path}/out", "2024-01-07", "ts", f"{tmp_path}/c2").awaitTermination(120)
    assert {r.part: r["count"] for r in spark.read.parquet(f"file://{tmp_path}/out/rows").groupBy("part").count().collect()} == {"week": 1, "other": 2}


def test_global_rank_is_a_permutation(spark):
    """Large enough for bounds to be sampled, with a payload column that the sizes do not need."""
    n = 200_000
    rows = spark.range(n, numPartitions=8).select((F.hash("id") % 1000).alias("a"), "id", F.md5(F.col("id").cast("string")).alias("payload"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        ranked = tokens.global_rank(rows, ["a", "id"], "rank").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ranked = ranked.sort_values("rank")
    assert ranked["rank"].tolist() == list(range(n))
    assert list(zip(ranked["a"], ranked["id"], strict=True)) == sorted(zip(ranked["a"], ranked["id"], strict=True))


def test_cycles_of_parents_are_an_error(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "e"), ("d", "c"), ("e", "d"), ("f", "lost")], "request_id string, parent_request_id string")
    with pytest.raises(ValueError, match="cycle"):
        lineage.roots(rows)
    found = {r.request_id: (r.root, r.depth) for r in lineage.roots(rows.filter("request_id not in ('c', 'd', 'e')")).collect()}
    assert found["b"] == ("a", 1) and found["f"][1] == 1


def test_results_go_to_the_call_of_their_own_id(spark):
    stem = "call_" + "a" * 12
    calls = spark.createDataFrame([("s", 0, 0, stem + "_1"), ("s", 0, 1, stem + "_2"), ("s", 0, 2, "toolu_x"), ("s", 0, 3, None)], "session_id string, step int, call_index int, raw_id string")
    results = spark.createDataFrame([("s", 1, 0, "toolu" + stem + "_2"), ("s", 1, 1, stem + "_9"), ("s", 1, 2, "x"), ("s", 1, 3, "x")], "session_id string, step int, result_index int, raw_id string")
    found = sorted((r.call_index, r.result_index) for r in toolcalls.match_results(calls, results).collect())
    assert found == [(0, 1), (1, 0), (2, 2)]


COMMANDS = [
    ("make 2>&1 | tee log", ["make", "tee"], ["", "|"], False, "success"),
    ("import os", [], [], False, "success"),
    ("(cd x && make) &", ["cd", "make"], ["", "&&"], True, "success"),
    ("cat <<'EOF' > a.py\nrm -rf x; ls\nEOF\npython3.11 a.py |& less", ["cat", "python", "less"], ["", "", "|"], False, "success"),
    ("for f in *.py; do python -m black $f; done # ; rm", ["python -m black"], [""], False, "success"),
    ("make -j$(nproc; ls) &> out.txt || timeout 60 npm run test", ["make", "npm run"], ["", "||"], False, "success"),
    ("a\\\n b && 'c;d' x", ["a"], [""], False, "success"),
    ('echo "' + '\\"x; ' * 5000 + '" ; ls', ["echo", "ls"], ["", ";"], False, "success"),
    ("echo it's", ["echo"], [""], False, "partial"),
    ("", [], [], False, "success"),
]


def test_programs_of_commands(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(COMMANDS)], "k int, command string")
    found = toolcalls.with_programs(df, "command").orderBy("k").collect()
    assert [(r.programs, r.joined_by, r.background, r.parse_status) for r in found] == [(p, j, b, s) for _, p, j, b, s in COMMANDS]
    assert one(spark, None, of=shell.programs) is None


def test_rules_by_subject(tmp_path):
    path = tmp_path / "rules.toml"
    path.write_text('version = "1"\n[spawn]\ntools = ["task"]\n[shell_purposes]\ngit = ["git"]\n[shell_rules]\npurpose_order = ["git"]\nrun_subcommands = ["run"]\n[categories]\ngit = "*Git/VCS"\n')
    rules = toolcalls.load_rules(str(path))
    assert rules.spawn == ["task"] and rules.purposes == {"git": ["git"]} and rules.order == ["git"] and rules.setup == toolcalls.Rules().setup
    path.write_text('[shell_rules]\nunknown = ["x"]\n')
    with pytest.raises(ValueError, match="unknown"):
        toolcalls.load_rules(str(path))
    path.write_text('ask_user = ["ASK"]\n')
    with pytest.raises(ValueError, match="lower"):
        toolcalls.load_rules(str(path))


def test_ordered_pairs_keep_repeats(spark):
    from tracemill.functions import arguments

    got = one(spark, '{"b": 1, "a": [1, {"x": "y"}], "b": "2"}', of=arguments.ordered_pairs)
    assert [(p.key, p.value) for p in got] == [("b", "1"), ("a", '[1,{"x":"y"}]'), ("b", '"2"')]
    assert one(spark, "[1]", of=arguments.ordered_pairs) is None and one(spark, None, of=arguments.ordered_pairs) is None


def test_plain_text_of_messages(spark):
    m = {"content": [{"type": "thinking", "text": "no"}, {"type": "text", "id": "no", "text": "one"}, {"type": "tool_result", "content": [{"type": "text", "text": "two"}]}], "tool_calls": [{"function": {"name": "bash", "arguments": "{}"}}]}
    assert one(spark, json.dumps(m), of=rendering.plain_text) == "one\ntwo\nbash\n{}"
    assert one(spark, '{"content": "plain"}', of=rendering.plain_text) == "plain" and one(spark, "broken", of=rendering.plain_text) == ""


SKELETONS = [
    ("A=1 sudo -u bob git commit -m 'x y' && cd /tmp; ls -la > out.txt", "<assign> sudo -u <str> git commit -m <str> && cd <path> ; ls -la > <path>"),
    ("cat <<EOF > f.py\na | b\nEOF\npython3 -m pytest -q tests/", "cat > <path> <heredoc> ; python -m pytest -q <path>"),
    ("docker exec db mysql -proot -h127.0.0.1 x", "docker exec <str> <str> -p=<value> -h=<value> <str>"),
    ("uv run pytest -k foo\ngrep -A10 x", "uv run pytest -k <str> ; grep -A=<value> <str>"),
    ("(cd x && make) > log.txt 2>&1 &", "cd <str> && make > <path> 2>&1 &"),
    ("node server.js & echo hi", "node <path> & echo <str>"),
    ("if true; then make; fi", "true ; make"),
    ("", None),
]


def test_command_skeletons(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(SKELETONS)], "k int, command string")
    found = df.select("k", shell.programs(F.col("command"), skeleton=True)["skeleton"].alias("skeleton")).orderBy("k").collect()
    assert [r.skeleton for r in found] == [s for _, s in SKELETONS]


def test_call_facts_of_odd_arguments(spark):
    from tracemill.operators import calljob

    given = ['{"commands": ["ls", {"command": "cat f.txt"}, 3]}', '{"code": "a=1"}', "[1]", '{"a":', "{}", None, '{"x": 1, "x": "a/b", "n": null}', '{"q\\"": "é", "subagent_type": "explore"}']
    df = spark.createDataFrame([(k, "bash", a) for k, a in enumerate(given)], "k int, raw_name string, arguments string")
    found = calljob.facts(df, toolcalls.Rules()).orderBy("k").collect()
    assert [r.arguments_skeleton for r in found] == ['{"commands": "ls ; cat <path>"}', '{"code": "<code>"}', "<unparsed>", "<unparsed>", "{}", "<unparsed>", '{"x": "<path>", "n": "<null>"}', '{"q\\"": "<str>", "subagent_type": "<str>"}']
    assert [r.programs for r in found[:3]] == [["ls", "cat"], ["code (code)"], []] and [r.parse_status for r in found[:3]] == ["success", "success", "failed"]
    assert found[7].subagent_type == "explore" and {r.category for r in found[2:]} == {"Other"}


def test_calls_written_as_text_join_the_job(spark):
    from tracemill.operators import calljob

    first = json.dumps({"choices": [{"message": {"content": "I look: <read><path>a.txt</path></read>"}}]})
    prompt = json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "I look"}, {"role": "user", "content": "[read for 'a.txt'] Result:\nError: none"}]})
    rows = [("s", 0, '{"messages":[]}', first, "I look: <read><path>a.txt</path></read>"), ("s", 1, prompt, '{"choices":[]}', "")]
    requests = spark.createDataFrame(rows, "session_id string, step int, prompt string, response string, reply string")
    (found,) = calljob.tool_calls(requests, toolcalls.Rules(), F.length, reply="reply").collect()
    assert (found.step, found.raw_name, found.family, found.category, found.arguments_skeleton) == (0, "read", "read", "Read", '{"path": "<path>"}')
    assert found.outcome == "ok" and found.result_tokens == len("[read for 'a.txt'] Result:\nError: none")
    assert calljob.tool_calls(requests, toolcalls.Rules(), F.length).count() == 0
