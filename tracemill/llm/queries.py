"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, decontaminate, embeddings, lines, packing, prefix_trie, quality_rules, runs, simhash, sstable, substring, token_counts
from .common import new_folder, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed_lines(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its cache is new, so every distinct text is encoded here."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), new_folder(spark, "token-cache"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    return ruled.select("doc_id", *(F.col(f"__rules.{c}").alias(c) for c in (*quality_rules.COUNTS, "base_failed", "kept")))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), new_folder(spark, "shards"), public_tokenizers.path(BYTE_BPE), end_id=2)
    return sstable.read_shards(manifest)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


#: A conversation that looks like marks, added to the table.
TRICKY = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(tricky)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_quality_classifier, op3_line_dedup, op4_token_counts, op5_decontamination, op6_simhash_dedup, op7_quality_rules, op8_token_shards, op9_best_fit_packing, op10_chat_format, op11_prefix_trie, op12_embedding_dedup, op13_periodic_runs)
}

#: Unsigned CRC-32 of an integer's decimal digits, bit by bit (DuckDB has no function for it).
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
                lambda a, z: list_reduce(list_prepend(xor(a, z), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, y: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))))"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op1_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
        c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM m),
        x AS (SELECT r, list(k) AS ks FROM c GROUP BY r),
        p AS (SELECT d.r, doc_id, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word, generate_subscripts(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END, 1) AS k FROM d),
        k AS (SELECT p.r, p.doc_id, p.n, p.k, p.word, c.k IS NOT NULL AS gone FROM p LEFT JOIN c ON c.r = p.r AND c.k = p.k)
        SELECT doc_id, n AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM k GROUP BY r, doc_id, n""",
    "op7_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
        c AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1) GROUP BY r),
        l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
        b AS (SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
              FROM d JOIN l USING (r) LEFT JOIN c USING (r)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
        h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM f GROUP BY source),
        m AS (SELECT avg(failed / n) AS m, coalesce(var_samp(failed / n), 0) AS v, avg(1 / n) AS q FROM h),
        s AS (SELECT m, CASE WHEN v - m * (1 - m) * q > 0 THEN least(greatest(1.0, m * (1 - m) / (v - m * (1 - m) * q) - 1), 1e6) ELSE {quality_rules.PRIOR_DOCUMENTS} END AS s FROM m)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
               base_failed, NOT base_failed AND (failed + m * s) / (n + s) < {quality_rules.MAX_HOST_RATE} AS kept
        FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source CROSS JOIN s""",
    "op10_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length('<turn ></turn>') + 1 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op11_prefix_trie": f"""
        WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {_CRC32.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        b AS (SELECT c.conv_id, 0 AS side, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos < h
              UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= h),
        s AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY side, pos) AS turns FROM b GROUP BY conv_id),
        r AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN s USING (conv_id)),
        p AS (SELECT conv_id, d, turns[1:d] AS node, d = len(turns) AS is_end FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
        n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '') AS ends FROM p GROUP BY node, d),
        k AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
        f AS (SELECT n.node, n.d, n.conv_id, n.n, n.ends, coalesce(k.n, 0) AS kids, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * strlen(n.node[n.d].t) END AS saved FROM n LEFT JOIN k USING (node)),
        u AS (SELECT node[1:e] AS node, sum(saved) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
        SELECT f.conv_id, f.d AS depth, o.conv_id AS parent_conv_id, f.n AS n_convs, f.kids::BIGINT AS n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN u USING (node) LEFT JOIN n o ON f.d > 0 AND o.node = f.node[1:f.d - 1]""",
    "op12_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        g AS (SELECT r, vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
        l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
        c AS (SELECT r AS a, r AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
        m AS (SELECT c.a AS r, min(v.vec_id) AS component_id FROM c JOIN v ON c.b = v.r GROUP BY c.a),
        n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, v.vec_id IS NOT DISTINCT FROM m.component_id AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)""",
}
