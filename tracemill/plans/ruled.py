"""Queries of rule tables, which are written as a user's files from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage, rules, toolcalls
from .registry import query, table


def _file(s, lines):
    """Lines (line, place) as one file, read by its folder's part."""
    path = lineage.new_path(s, "rules")
    lines.orderBy("place").select("line").coalesce(1).write.text(path)
    return path


def _phrases(s, d):
    """An entry a nation, in order of keys: a phrase with its name, and one with its region's that the region's other nations have too; every third has a user agent."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit('["'), "n_name", F.lit('"]\nphrases = ["you are '), F.lower("n_name"), F.lit('", "live in '), F.lower("r_name"), F.lit('"]\n'), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('user_agent = ["'), F.lower("n_name"), F.lit('/"]\n'))).otherwise(""))
    return _file(s, j.select(line.alias("line"), F.col("n_nationkey").alias("place")))


_TEXTS = "x_n AS (SELECT n_nationkey AS k, n_name AS name, lower(n_name) AS low, lower(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("X3_harness_of_texts", "WITH " + _TEXTS + """, x_d AS (SELECT doc_id, doc_id % 5 AS kind, 'a ' || CASE doc_id % 5 WHEN 0 THEN 'you are ' || a.low || ' ' || lower(text) WHEN 1 THEN lower(text) || ' live in ' || a.region || ' you are ' || b.low WHEN 2 THEN lower(text) || ' live in ' || a.region ELSE lower(text) END AS t,
      CASE WHEN doc_id % 5 = 3 THEN 'Agent ' || a.name || '/1.0' END AS agent FROM documents JOIN x_n a ON a.k = doc_id % 25 JOIN x_n b ON b.k = (doc_id // 25) % 25 WHERE text IS NOT NULL),
    x_p AS (SELECT k * 2 AS place, name, 'you are ' || low AS p FROM x_n UNION ALL SELECT k * 2 + 1, name, 'live in ' || region FROM x_n), x_f AS (SELECT doc_id, arg_min(name, struct_pack(a := instr(t, p), b := place)) AS name FROM x_d JOIN x_p ON contains(t, p) GROUP BY 1),
    x_a AS (SELECT doc_id, arg_min(name, k) AS name FROM x_d JOIN x_n ON k % 3 = 0 AND contains(lower(agent), low || '/') GROUP BY 1) SELECT doc_id, coalesce(f.name, a.name, 'other-agent') AS harness FROM x_d LEFT JOIN x_f f USING (doc_id) LEFT JOIN x_a a USING (doc_id)""", fixture=False)  # fmt: skip
def _(s, d):
    """Whole texts with phrases before or behind them, by a table of fifty phrases from a file."""
    entries = rules.checked(_once(rules.harnesses(s, _phrases(s, d))))
    docs, n, r = table(s, d, "documents").filter("text is not null"), table(s, d, "nation"), table(s, d, "region")
    x = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lower("r_name").alias("region"))
    j = docs.withColumn("k", F.col("doc_id") % 25).join(x, "k").withColumn("k", F.floor(F.col("doc_id") / 25) % 25).join(x.select("k", F.lower("name").alias("other")), "k")
    kind, low = F.col("doc_id") % 5, F.lower("text")
    text = F.when(kind == 0, F.concat_ws(" ", F.lit("you are"), F.lower("name"), low)).when(kind == 1, F.concat_ws(" ", low, F.lit("live in"), "region", F.lit("you are"), "other")).when(kind == 2, F.concat_ws(" ", low, F.lit("live in"), "region")).otherwise(low)
    agent = F.when(kind == 3, F.concat(F.lit("Agent "), "name", F.lit("/1.0")))
    return rules.with_harness(j, F.concat(F.lit("a "), text), agent, entries).select("doc_id", "harness")


def _once(entries):
    """The first of repeated phrases."""
    return entries.join(rules.faults(entries).filter("fault = 'repeated'").select("place"), "place", "left_anti").select(*entries.columns)


@query("S11_rule_faults", "WITH " + _TEXTS + """, x_p AS (SELECT region, min(k) AS k FROM x_n GROUP BY region) SELECT 'harnesses' AS "table", n.name, 'live in ' || n.region AS text, 'repeated' AS fault FROM x_n n JOIN x_p p ON p.region = n.region AND n.k > p.k
    UNION ALL SELECT 'exclusions', CASE WHEN k % 4 = 0 THEN '' ELSE name END, CASE WHEN k % 4 = 0 THEN '' ELSE name END, f FROM (SELECT *, unnest(list_filter([CASE WHEN k % 4 = 0 THEN 'empty' END, CASE WHEN k % 5 = 0 THEN 'no_reason' END], lambda x: x IS NOT NULL)) AS f FROM x_n)""", fixture=False)  # fmt: skip
def _(s, d):
    """What is wrong with two files: phrases that several entries have, and exclusions without a name or a reason."""
    n = table(s, d, "nation")
    name = F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name"))
    line = F.concat(F.lit('[[harness]]\nname = "'), name, F.lit('"\n'), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise('reason = "asked"\n'))
    left_out = rules.exclusions(s, _file(s, n.select(line.alias("line"), F.col("n_nationkey").alias("place"))))
    return rules.faults(rules.harnesses(s, _phrases(s, d))).union(rules.faults(left_out)).select("table", "name", "text", "fault")


def _tool_rules(s, d):
    """Tool names from regions and nations: those of even regions are aliases of their region, those of odd ones its keywords; regions are families."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    names = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.lower("n_name"), F.lit('"')))), ", ").alias("names"))
    j = r.join(names, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.concat(F.lower("r_name")).alias("region"), "names")
    line = lambda: F.concat(F.lit('"'), "region", F.lit('" = ['), "names", F.lit("]"))
    head = lambda name, place: s.range(1).select(F.lit(f"[{name}]").alias("line"), F.lit(place).cast("long").alias("place"))
    some = lambda odd, at: j.filter(F.col("r_regionkey") % 2 == odd).select(line().alias("line"), (F.col("r_regionkey") + at).alias("place"))
    kinds = F.element_at(F.array(*map(F.lit, _FAMILIES)), (F.col("r_regionkey") + 1).cast("int"))
    families = j.select(F.concat(kinds, F.lit(' = ["'), "region", F.lit('"]')).alias("line"), (F.col("r_regionkey") + 100).alias("place"))
    lines = head("aliases", -1).union(some(0, 0)).union(head("keywords", 20)).union(some(1, 21)).union(head("tool_families", 99)).union(families)
    return toolcalls.load_rules(_file(s, lines), spark=s)


_FAMILIES = ("shell", "read", "edit", "write", "browser")


@query("X13_names_by_a_users_rules", """WITH x_m AS (SELECT n_nationkey AS n, lower(n_name) AS low, r_regionkey AS r, lower(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey), x_s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS kind, m.* FROM supplier JOIN x_m m ON s_nationkey = m.n),
    x_k AS (SELECT s.k, arg_min(m.region, m.r) AS region, min(m.r) AS r FROM x_s s JOIN x_m m ON m.r % 2 = 1 AND starts_with(s.low, m.low) GROUP BY 1), x_n AS (SELECT s.k, kind, CASE WHEN kind = 0 AND s.r % 2 = 0 THEN s.region WHEN kind <> 2 THEN coalesce(x.region, CASE kind WHEN 1 THEN 'my ' || low || ' tool' WHEN 3 THEN 'mcp__' || low END) ELSE 'x' || low END AS name FROM x_s s LEFT JOIN x_k x USING (k))
    SELECT k, name, CASE WHEN m.r IS NOT NULL THEN """ + f"{list(_FAMILIES)}[m.r + 1]" + """ WHEN kind = 3 THEN 'mcp' ELSE 'other' END AS family FROM x_n LEFT JOIN (SELECT DISTINCT region, r FROM x_m) m ON m.region = x_n.name""", fixture=False)  # fmt: skip
def _(s, d):
    """Names by aliases and by keywords that start a word, and their families, all from a file."""
    own = _tool_rules(s, d)
    n = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kind, low = F.col("s_suppkey") % 4, F.lower("n_name")
    raw = F.when(kind == 0, F.concat(F.lit(" "), "n_name")).when(kind == 1, F.concat(F.lit("My "), "n_name", F.lit(" Tool"))).when(kind == 2, F.concat(F.lit("x"), low)).otherwise(F.concat(F.lit("mcp__"), low))
    named = n.select(F.col("s_suppkey").alias("k"), raw.alias("raw")).withColumn("name", toolcalls.canonical_name(F.col("raw"), own))
    return named.select("k", "name", toolcalls.family(F.col("raw"), F.col("name"), own).alias("family"))
