"""Queries of this subpackage: one for each operator, with production parameters over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicate_classes

    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("spans")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(read_table(spark, sf_dir, "documents"), with_ids=False).drop("piece_ids")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages"), RULES)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(read_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import near_vector_classes

    return near_vector_classes(read_table(spark, sf_dir, "embeddings"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .drift_means import cluster_vectors

    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie, rebuild, slim_turns

    return prefix_trie(rebuild(slim_turns(read_table(spark, sf_dir, "conversations"))))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_template import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


W = r"[^\x20\x09-\x0D]+"

def _clusters_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS num, v FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY 1 NULLS LAST, 2 LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(dist := list_sum(list_transform(range(1, {dim + 1}), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i])))::BIGINT, num := c.num)) AS best FROM kept CROSS JOIN c{r} c GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT num, list(mid ORDER BY i) AS v FROM (SELECT best.num AS num, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS mid FROM kept JOIN a{r} USING (rid), (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY 1, 2) GROUP BY num),
c{r + 1} AS MATERIALIZED (SELECT c{r}.num, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (num))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.num::INTEGER AS cluster, best.dist AS distance, sum(best.dist) OVER (PARTITION BY best.num)::BIGINT AS cluster_inertia, sum(best.dist) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} ON c{rounds}.num = best.num"""


SQL = {
    "op11_centroid_clustering": _clusters_sql(),
    "op12_conversation_trie": r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) - 1 AS pos, mark, bytes
           FROM (SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda a, b:
        list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h
      FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM t)),
r AS (SELECT h.c, t.pos, t.mark, t.bytes FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.pos < h.h UNION ALL SELECT h.c, t.pos, t.mark, t.bytes FROM h JOIN t ON t.c = h.c AND t.pos >= h.h),
m AS MATERIALIZED (SELECT c, row_number() OVER w AS d, string_agg(mark, '') OVER w AS k, bytes FROM r WINDOW w AS (PARTITION BY c ORDER BY pos) UNION ALL SELECT c, 0, '', 0 FROM h),
n AS MATERIALIZED (SELECT k, any_value(d) AS d, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs FROM m GROUP BY k),
ch AS (SELECT substr(k, 1, len(k) - 32) AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
f AS MATERIALIZED (SELECT n.*, coalesce(ch.n, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
pairs AS (SELECT DISTINCT a.k, b.k AS low FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d),
sub AS (SELECT pairs.k, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved FROM pairs JOIN f ON f.k = pairs.low GROUP BY pairs.k),
ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM m GROUP BY c) GROUP BY k)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, sub.n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM f JOIN sub ON f.k = sub.k LEFT JOIN n p ON f.d > 0 AND p.k = substr(f.k, 1, len(f.k) - 32) LEFT JOIN ends ON ends.k = f.k
""",
    # holds where every page has one plain article of p and h1 with b and br, as the given ones do
    "op13_html_extraction": r"""
WITH a AS (SELECT row_number() OVER () AS k, page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (SELECT k, page_id, url, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '</?(?:p|h1)>'),
        lambda s: trim(regexp_replace(regexp_replace(regexp_replace(s, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda s: s <> '') AS blocks FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM b
""",
    "op6_url_filters": r"""
WITH r(host_rule, path_rule, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.k, r.host_rule || r.path_rule AS rule, r.verdict, row_number() OVER (PARTITION BY p.k ORDER BY length(r.host_rule || r.path_rule) DESC, length(r.host_rule) DESC) AS n
      FROM p JOIN r ON (p.host = r.host_rule OR ends_with(p.host, '.' || r.host_rule)) AND starts_with(p.path, r.path_rule))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.k = m.k AND m.n = 1
""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::BIGINT AS left_words, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS left_weight FROM s1
       WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2b AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn, left_words / left_weight AS own_level FROM s2),
s3 AS (SELECT *, coalesce((SELECT own_level FROM s2b WHERE cap / weight > own_level ORDER BY turn LIMIT 1), 0) AS level FROM s2b),
g AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM s3),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
t AS (SELECT d.*, h.source_size, h.target, h.whole, h.target - h.whole * h.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.draw, 1, 3)) - sum(d.size) OVER (PARTITION BY d.source, substr(d.draw, 1, 3)) AS before,
             sum(d.size) OVER (PARTITION BY d.source, substr(d.draw, 1, 3)) AS slot_size, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) AS upto
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
o AS (SELECT *, whole + CASE WHEN before >= rest THEN 0 WHEN before + slot_size <= rest THEN 1 WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END AS repeats FROM t)
SELECT doc_id, source, size, source_size, target, repeats::BIGINT AS repeats, (repeats * size)::BIGINT AS taken FROM o
""",
}
