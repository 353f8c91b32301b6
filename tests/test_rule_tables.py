"""Rule tables from files: what they hold, what is wrong with them, and what they decide."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.functions import strings
from tracemill.operators import rules


@pytest.fixture
def files(tmp_path):
    texts = {
        "harnesses": 'version = "1"\n[a]\nphrases = ["you are a", "i am x"]\n[b]\nphrases = ["you are"]\nuser_agent = ["b/"]\n[c]\nphrases = []\nuser_agent = ["ab/", "c"]\n',
        "notes": '[[note]]\nphrase = "was compacted"\nharnesses = ["a", "b"]\n[[note]]\nphrase = "[SUMMARY"\n',
        "excluded": '[[harness]]\nname = "b"\nreason = "asked"\n[[session]]\nid = "r2"\nreason = "one"\n',
        "words": 'names = ["read", "bash"]\nprograms = ["read"]\n[added]\nnames = ["bash", "edit"]\n',
        "outcomes": 'head_characters = 50\nmarker_characters = 20\ndenial_markers = ["no way"]\ntimeout_markers = []\nfailure_markers = ["broke"]\nempty_error_values = ["-"]\nsuccess_statuses = ["fine"]\n',
        "wrong": '[a]\nphrases = ["Upper", "", "twice"]\n[b]\nphrases = ["twice"]\n',
        "unknown": 'names = []\nothers = ["x"]\n',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    return lambda name: f"file://{tmp_path}/{name}"


def test_harness_by_phrase_then_agent(spark, files):
    table = rules.checked(rules.harnesses(spark, files("harnesses")))
    cases = [("we: you are a bot, i am x", None, "a"), ("i am x. you are b", None, "a"), ("so you are b. i am x", None, "b"), ("none", "X/AB/1", "b"), ("none", "Cmd", "c"), (None, None, "other-agent"), ("", "zz", "other-agent")]
    df = spark.createDataFrame([(k, t, a) for k, (t, a, _) in enumerate(cases)], "k int, place string, agent string").withColumnRenamed("place", "name")
    got = rules.with_harness(df, F.col("name"), F.col("agent"), table).orderBy("k")
    assert [r.harness for r in got.collect()] == [w for *_, w in cases] and got.columns == ["k", "name", "agent", "harness"]
    empty = table.limit(0)
    assert {r.harness for r in rules.with_harness(df, F.col("name"), F.col("agent"), empty).collect()} == {"other-agent"}


def test_notes_exclusions_and_words(spark, files):
    notes = rules.checked(rules.compaction_notes(spark, files("notes")))
    df = spark.createDataFrame([(["it was compacted", "x", "[SUMMARY] y", None],), ([],)], "t array<string>")
    assert [r.notes for r in rules.with_note(df, F.col("t"), notes).collect()] == [[True, False, True, None], []]
    left_out = rules.checked(rules.exclusions(spark, files("excluded")))
    s = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", None)], "session_id string, harness string")
    assert {r.session_id: r.reason for r in rules.reasons_excluded(s, left_out, F.concat(F.lit("r"), "session_id")).collect()} == {"1": None, "2": "one", "3": "asked", "4": None}
    words = rules.checked(rules.public_words(spark, files("words")))
    assert [(r.name, r.text) for r in words.orderBy("place").collect()] == [("names", "read"), ("names", "bash"), ("names", "edit"), ("programs", "read")]
    with pytest.raises(rules.RuleError, match="others"):
        rules.public_words(spark, files("unknown"))


def test_outcomes_by_a_users_rules(spark, files):
    own = rules.outcome_rules(spark, files("outcomes"))
    texts = ['{"error": "-"}', '{"status": "Fine"}', '{"error": {"a": 1}}', "there is no way at all", "x" * 25 + "broke", "it broke", "user denied", '{"error": null}', '{"k": "' + "y" * 60 + '", "error": "cut"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.o for r in df.select(strings.outcome(F.col("t"), F.lit(None).cast("boolean"), own).alias("o")).collect()] == ["ok", "ok", "error", "denied", "ok", "error", "ok", "ok", "ok"]
    with pytest.raises(rules.RuleError, match="names"):
        rules.outcome_rules(spark, files("words"))


def test_faults_are_rows(spark, files):
    found = {(r.name, r.text, r.fault) for r in rules.faults(rules.harnesses(spark, files("wrong"))).collect()}
    assert found == {("a", "Upper", "not_lower_case"), ("a", "", "empty"), ("b", "twice", "repeated")}
    with pytest.raises(rules.RuleError, match="not_lower_case.*empty.*repeated"):
        rules.checked(rules.harnesses(spark, files("wrong")))
