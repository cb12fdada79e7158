"""The queries opN_* over the given tables, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.bpe import bpe_decode, bpe_encode
from tallyspark.llm.clusters import centroid_clusters, complete, quantised
from tallyspark.llm.common import read
from tallyspark.llm.counts import token_counts
from tallyspark.llm.hosts import judge
from tallyspark.llm.html import main_texts
from tallyspark.llm.jaccard import jaccard_classes
from tallyspark.llm.licences import NOTICES, licence_matches, licence_passages, notices, passage_templates
from tallyspark.llm.lines import drop_aligned_lines
from tallyspark.llm.packing import best_fit_pack, token_pieces
from tallyspark.llm.substrings import remove_repeats
from tallyspark.llm.topk import top_k
from tallyspark.llm.variants import spelling_variants, word_counts
from tallyspark.llm.warc import archive_round_trip


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    out = best_fit_pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_matches(read(spark, sf_dir, "documents"), notices(spark))


def op2_licence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_passages(read(spark, sf_dir, "documents"), passage_templates(spark))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs, F.col("source")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe_decode(bpe_encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), length=20, joined=True)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_aligned_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return top_k(x, F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(read(spark, sf_dir, "documents"), least=7, every=31, often=2), times=10)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = read(spark, sf_dir, "embeddings").where(complete(F.col("embedding"), 64))
    vectors = kept.select("vec_id", quantised(F.col("embedding"), 256).alias("vec"))
    return centroid_clusters(vectors, k=40, rounds=5, seed_order=F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_licence_scans": op2_licence_scans,
    "op2_licence_passages": op2_licence_passages,
    "op3_warc": op3_warc,
    "op4_host_rules": op4_host_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_html_extraction": op8_html_extraction,
    "op9_line_dedup": op9_line_dedup,
    "op10_pivot_top_k": op10_pivot_top_k,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_token_counts": op13_token_counts,
}

#: Words are runs of characters other than \x20 and \x09-\x0D.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TEMPLATES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(NOTICES))
TOKENS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"



def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """Centroids of each round as rows (c, v), the assignment to them, and the next ones."""
    assigned = """SELECT r, vec_id, x, s.c AS c, s.d AS d FROM (SELECT r, vec_id, x, (SELECT min({{'d': d, 'c': c}}) FROM (SELECT c, CAST(list_sum(list_transform(list_zip(x, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM {0})) AS s FROM vecs)"""
    steps = [f"""vecs AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c, x AS v FROM vecs QUALIFY row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) <= {k})"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({assigned.format(f'c{i}')})")
        if i < rounds:
            means = f"SELECT c, i, CAST(sum(e) // count(*) - CASE WHEN sum(e) < 0 AND sum(e) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS m FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY c, i"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(m ORDER BY i) AS v FROM ({means}) GROUP BY c) m USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLES: dict[str, str] = {
    "op12_centroid_clusters": _cluster_sql(),
    "op2_licence_scans": rf"""
WITH t AS (SELECT template, licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT template, licence, {TOKENS.format("text")} AS w FROM (VALUES {TEMPLATES}) v(template, licence, text))),
d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT r, doc_id, 0 AS segment, text AS part FROM d UNION ALL SELECT r, doc_id, unnest(generate_series(1, len(l))) AS segment, unnest(l) AS part FROM d WHERE len(l) > 1),
g AS (SELECT r, doc_id, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM (SELECT r, doc_id, segment, {TOKENS.format("part")} AS w FROM s) WHERE len(w) > 1),
m AS (SELECT r, doc_id, segment, licence, template, len(list_intersect(a, b)) AS n, len(a) AS na, len(b) AS nb FROM g JOIN t ON len(a) * 120 >= len(b) * 80 AND len(a) * 80 <= len(b) * 120),
k AS (SELECT *, row_number() OVER (PARTITION BY r, segment ORDER BY n / (na + nb) DESC, template) AS pos FROM m WHERE 200 * n >= 80 * (na + nb))
SELECT doc_id, CAST(segment AS INTEGER) AS segment, licence, CAST(template AS INTEGER) AS template, CAST(n AS BIGINT) AS n_common, CAST(na AS BIGINT) AS n_segment, CAST(nb AS BIGINT) AS n_template FROM k WHERE pos = 1""",
    "op10_pivot_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM q""",
    "op4_host_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
windows AS (SELECT r, s, array_to_string(w[s:s + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, k FROM windows GROUP BY r, k HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(s, s + 5)) AS i FROM windows JOIN twice USING (r, k)) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
w AS (SELECT count(*) AS h, sum(n) AS sn, sum(f) AS sf, sum(n * n) AS snn, sum(f * f / n) AS sff, sum(f) / sum(n) AS m FROM hosts),
p AS (SELECT m, CASE WHEN sn - snn / sn > 0 THEN (sff - sf * sf / sn - m * (1 - m) * (h - 1)) / (sn - snn / sn) ELSE 0 END AS v FROM w),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) END AS a FROM p),
bad AS (SELECT source FROM hosts, q WHERE coalesce((f + m * a) / (n + a), m) > 0.5)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.source IS NULL AS kept
FROM b LEFT JOIN bad ON b.source = bad.source""",
    "op6_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
firsts AS (SELECT k, min((doc_id, s)) AS f FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM windows JOIN firsts USING (k) WHERE (doc_id, s) <> f),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
