"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.llm import bestfit, decontam, licenses, neardup, packing, pii, quality, ranking, search, tokens, toxicity, trie, warc
from trajlens.llm.common import held_out, shared_folder, table
from trajlens.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A folder of its own for each run: its result and its cost do not depend on earlier runs.
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  shared_folder(spark, "token-counts"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return spans.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS)],
                        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(pii.all_spans(F.col("base"), F.col("added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


@query("op4_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("passages").cast("long").alias("n_passages"))


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["kind"] == "base")
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    words = F.transform(base, lambda h: h["word"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
                        F.array_max(words).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("hits")).alias("labels"), "score")


@query("op8_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM m""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archived = warc.archive_pages(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return archived.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_best_fit_packing")
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_prefix_trie", """
WITH t AS (SELECT conv_id AS c, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS BIGINT) AS s,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT c, max(s) AS size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h FROM t GROUP BY c),
y AS (SELECT z.*, least(z.h, coalesce(b.size, 0)) AS taken FROM z LEFT JOIN z b ON b.c = z.c - z.c % 5),
r AS (SELECT y.c, t.s AS d, role, text FROM y JOIN t ON t.c = y.c - y.c % 5 AND t.s <= y.h
  UNION ALL SELECT y.c, y.taken + t.s - y.h, role, text FROM y JOIN t ON t.c = y.c AND t.s > y.h
  UNION ALL SELECT c, 0, '', '' FROM y),
p AS (SELECT c, d, text, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM r),
m AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent, max(d) OVER (PARTITION BY c) AS last FROM p),
n AS (SELECT d, key, min(parent) AS parent, min(c) AS c, count(*) AS n, any_value(CASE WHEN d > 0 THEN strlen(text) ELSE 0 END) AS size,
    sha256(coalesce(string_agg(CASE WHEN d = last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends FROM m GROUP BY d, key),
k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.parent = n.key) AS children FROM n),
u AS (SELECT m.d, m.key, sum((k.n - 1) * k.size) AS saved, count(*) FILTER (k.children = 0) AS leaves FROM k JOIN m ON m.c = k.c AND m.d <= k.d GROUP BY m.d, m.key)
SELECT k.c AS conv_id, k.d AS depth, a.c AS parent_conv_id, k.n AS n_convs, k.children AS n_children, u.leaves AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN u ON u.d = k.d AND u.key = k.key LEFT JOIN k a ON a.d = k.d - 1 AND a.key = k.parent""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.with_shared_openings(trie.ordered_turns(table(spark, sf_dir, "conversations"))))


@query("op12_ranked_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
c AS (SELECT CAST(count(*) FILTER (len(words) > 0) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
