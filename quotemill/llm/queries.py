"""Queries of the corpus operators, with the SQL that expresses them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import decontamination, language_id, line_dedup, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, sharding, substring_dedup, token_counts, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), short=True)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_gone").cast("long").alias("n_removed"), digest.alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), language_id.held_out("doc_id", 4, 2)
    net = language_id.train(docs, ~out, "doc_id", "text", "lang")
    return language_id.identify(docs, net, "doc_id", "text", out.alias("held_out"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), language_id.held_out("doc_id", 5, 0)
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"), ~out)
    return quality_classifier.score(docs, model, "doc_id", "text", out.alias("held_out"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), language_id.held_out("doc_id", 4, 2)
    lexicon = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, lexicon, "doc_id", "text", out.alias("held_out"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(_table(spark, sf_dir, "documents")).drop("clean_text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), rebuild=prefix_trie.branched)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = r"""
WITH RECURSIVE items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, least(len(w), 5) AS size, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p:p + least(len(w), 5) - 1], ' ')))) AS shingle
  FROM items WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
d AS (
  SELECT doc_id, size, unnest(list_distinct(list_transform(range(1, len(w) - size + 2), lambda p: array_to_string(w[p:p + size - 1], ' ')))) AS shingle
  FROM docs, (SELECT DISTINCT size FROM i) WHERE len(w) >= size),
hit AS (SELECT d.doc_id, i.item_id, count(*) AS n_shared FROM d JOIN i ON d.shingle = i.shingle AND d.size = i.size GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, n_shared, round(n_shared / n, 6) AS containment
FROM hit JOIN n USING (item_id) WHERE n_shared >= ceil(n * 0.8 - 1e-9)
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
low AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(low.low, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(low.low, s.doc_id)) AS kept
FROM s LEFT JOIN low USING (doc_id)
"""

OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
cut AS (SELECT DISTINCT doc_id, unnest(gone) AS p FROM gone),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM x ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM d),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM many, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT doc_id, t, w, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
lines AS (
  SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbols,
         len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT doc_id, unnest(l) AS x FROM f)),
bad AS (
  SELECT doc_id, count(*) AS n, sum(chars) AS lost FROM lines
  WHERE symbols * 10 >= chars OR len(regexp_extract_all(x, '{quality_rules.SHOUT}')) * 4 >= n OR (n >= {quality_rules.LONG_LINE} AND NOT regexp_matches(x, '{quality_rules.SENTENCE_MARK}'))
     OR len(regexp_extract_all(x, '{quality_rules.SEPARATOR_MARK}')) >= 3 OR regexp_matches(x, '{quality_rules.NAVIGATION}') OR regexp_matches(x, '{quality_rules.BOILERPLATE}')
  GROUP BY doc_id),
r AS (
  SELECT f.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(bad.n, 0)::BIGINT AS n_failed_lines, coalesce(bad.lost, 0)::BIGINT AS lost_chars
  FROM f LEFT JOIN rep USING (doc_id) LEFT JOIN bad USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars * 100 <= 40 * word_chars AS kept
FROM r
"""

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(coalesce(text, ''))) AS p,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM t),
h AS (
  SELECT conv_id, base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, x)), 4294967295), 4294967295) % 6 AS h FROM c),
rebuilt AS (
  SELECT h.conv_id, list(s.k ORDER BY s.o, s.p) AS k, list(s.chars ORDER BY s.o, s.p) AS chars
  FROM h JOIN (SELECT conv_id, 0 AS o, p, k, chars FROM t UNION ALL SELECT conv_id, 1, p, k, chars FROM t) s
    ON (s.o = 0 AND s.conv_id = h.base AND s.p <= h.h) OR (s.o = 1 AND s.conv_id = h.conv_id AND s.p > h.h) GROUP BY 1),
r AS (SELECT c.conv_id, coalesce(k, []) AS k, coalesce(chars, []) AS chars FROM c LEFT JOIN rebuilt USING (conv_id)),
path AS (SELECT conv_id, d, md5(array_to_string(k[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(k[1:d - 1], ',')) END AS up, chars[d] AS chars, d = len(k) AS ends
  FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM r)),
n AS (SELECT d, node, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM path GROUP BY d, node),
kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, node)),
below AS (SELECT p.d, p.node, sum((m.n_children = 0)::INT) AS n_leaves, sum((m.n - 1) * coalesce(m.chars, 0)) AS saved FROM m JOIN path p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY 1, 2)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN below USING (d, node) LEFT JOIN n u ON u.d = m.d - 1 AND u.node = m.up
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_near_dedup": op2_near_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_line_dedup": op4_line_dedup,
        "op5_language_id": op5_language_id,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_toxicity": op8_toxicity,
        "op9_packing": op9_packing,
        "op10_quality_rules": op10_quality_rules,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_whitening": op12_whitening,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_near_dedup": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op10_quality_rules": OP10_SQL, "op11_prefix_trie": OP11_SQL}
