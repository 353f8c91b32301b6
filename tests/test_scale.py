"""Queries at sizes and lengths that the given tables seldom have."""

import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tracemill.functions import rendering, shell
from tracemill.operators import privacy, toolcalls, whatif
from tracemill.plans import registry
from tracemill.sources import traces


def test_outcomes_at_the_length_that_is_read(spark, tmp_path):
    # results just under, at and over 4000 characters, of both kinds whose fields a longer text cuts off
    rows = [(10 * i + kind, "x" * (3968 + i)) for i in range(12) for kind in (0, 6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.outcome for r in registry.QUERIES["X27_outcomes"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == dict(con.sql(registry.ORACLES["X27_outcomes"]).fetchall())
    assert set(found.values()) == {"ok", "error"}


def test_patterns_of_a_command_are_tried_once_a_piece(spark):
    # a fold's step is pasted with all it is made of, so a pattern in it was tried some forty times a word
    df = spark.range(1).selectExpr("cast(id as string) as command").select(shell.commands(F.col("command")))
    assert df._jdf.queryExecution().analyzed().toString().count("RLIKE") <= 12


def test_sixes_carry_no_document(spark):
    # the rows of a long document took all its words with them, which grows with the square of its length
    plan = registry.jobs.sixes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    made = next(x for x in plan.splitlines() if "Generate explode" in x)
    assert re.search(r"\[1\], false, \[x#\d+\]$", made)  # the text is not among what goes on


def test_shared_prefixes_of_rows_by_session_are_not_shuffled_again(spark):
    # reads made by session are compared and counted where they lie; a join by position shuffled all of them three times
    df = registry.QUERIES["C7_shared_prefix"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_shared_prefixes_of_repeated_and_missing_reads(spark):
    rows = [("s", 0, 0, 1), ("s", 0, 1, 2), ("s", 1, 0, 1), ("s", 1, 1, 2), ("s", 1, 2, 3), ("s", 3, 0, 1), ("s", 3, 1, 2), ("s", 4, 0, 1), ("s", 4, 1, 9), ("t", 1, 0, 1)]
    found = whatif.shared_prefixes(spark.createDataFrame(rows, "session_id string, step int, pos int, block_id long"))
    assert {(r.session_id, r.step): (r.blocks, r.shared_blocks) for r in found.collect()} == {("s", 0): (2, 0), ("s", 1): (3, 2), ("s", 3): (2, 0), ("s", 4): (2, 1), ("t", 1): (1, 0)}


def test_a_word_of_every_skeleton_is_dealt_over_tasks(spark):
    # words met the lists by themselves, with the whole skeleton beside them, so one task read all rows of a common word or of no word
    skeletons = spark.createDataFrame([(k, f'{{"command": "ls --w{k} | grep <path>", "kind": "<str>"}}') for k in range(300)], "k long, skeleton string")
    lists = spark.createDataFrame([("ls",), ("command",), ("--w7",)], "word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (privacy.released_skeletons(skeletons, lists, lists, [], toolcalls.Rules()), privacy.allowed_skeletons(skeletons, lists, lists, [], lists)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning\(word#\d+, __salt#\d+", plan)) == 2
            assert not re.search(r"Exchange hashpartitioning\((__w|key)#\d+, \d+\)", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_odd_skeletons_against_the_lists(spark):
    given = ['{"command": "ls --a=<value> ; x <path>", "command": "ls", "subagent_type": "ls"}', "{}", "<unparsed>", None, '{"n": "<num>", "command": ""}', '{"subagent_type": "<str>"}']
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k long, skeleton string")
    lists = spark.createDataFrame([("ls",), ("command",), ("command",), (None,)], "word string")
    found = privacy.released_skeletons(rows, lists, lists, [], toolcalls.Rules()).orderBy("k").collect()
    assert [r.released_skeleton for r in found] == ['{"command": "ls --<flag>=<value> ; <program> <path>", "command": "ls", "<key>": "<word>"}', "{}", "<unparsed>", None, '{"<key>": "<num>", "command": "<program>"}', '{"<key>": "<str>"}']
    types = lists.union(spark.createDataFrame([("subagent_type",)], "word string"))
    allowed = {r.skeleton: r.allowed for r in privacy.allowed_skeletons(rows, types, lists, [], lists).collect()}
    assert allowed == {given[0]: False, "{}": True, "<unparsed>": True, None: False, given[4]: False, given[5]: True}
    assert [r.allowed for r in privacy.allowed_skeletons(rows.select(F.lit('{"command": "ls | ls", "subagent_type": "ls"}').alias("skeleton")), types, lists, [], lists).collect()] == [True]


def test_bodies_are_objects_some_rows_at_a_time(spark, monkeypatch):
    # a batch of long bodies was all Python objects at once
    monkeypatch.setattr(rendering, "SLICE_BYTES", 1)
    body = '{"messages": [{"role": "assistant"}, {"role": "tool", "tool_call_id": "a", "content": "x"}]}'
    found = rendering.fresh.func(pa.array([body, None, "[]", body])).to_pylist()
    assert found == [[{"raw_id": "a", "text": "x", "is_error": None}], None, None, [{"raw_id": "a", "text": "x", "is_error": None}]]
    assert rendering.fresh.func(pa.array([], pa.string())).to_pylist() == []


def test_results_meet_calls_in_one_join(spark):
    c = spark.createDataFrame([("s", 0, 0, "call_1")], "session_id string, step int, call_index int, raw_id string")
    r = spark.createDataFrame([("s", 1, 0, "call_1")], "session_id string, step int, result_index int, raw_id string")
    found = toolcalls.match_results(c, r)
    assert len(re.findall(r"\bJoin Inner", found._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert [tuple(x) for x in found.collect()] == [("s", 0, 0, 0)]


def test_nested_lines_are_parsed_once_a_level(spark):
    line = '{"session_id": "a", "requests": [{"step": 0, "tool_calls": [{"call_index": 0, "subagent": {"session_id": "b"}}]}]}'
    found = traces.flatten(spark.createDataFrame([(line,), ("[]",)], "value string"))
    assert all("parse_json" not in x._jdf.queryExecution().optimizedPlan().toString() for x in found[:3])
    assert sorted((r.session_id, r.parent_session_id, r.spawned_by_step, r.spawned_by_call_index) for r in found[0].collect()) == [("a", None, None, None), ("b", "a", 0, 0)]
    assert [r.session_id for r in found[1].collect()] == ["a"] and [(r.session_id, r.call_index) for r in found[2].collect()] == [("a", 0)]
    assert [r.line for r in found[3].collect()] == ["[]"]
