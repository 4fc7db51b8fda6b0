"""The registered queries of this folder: opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.decontaminate import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.phrases import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_suffix_lpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapline.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"pipeline": pipeline}


#: Of op4: words and shingles as gapline.llm.common has them, for all items and documents.
OP4_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, array_to_string(w[p : p + 4], ' ') AS shingle
  FROM (SELECT kind, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::BIGINT AS shared, any_value(n.n)::BIGINT AS item_shingles, count(*)::DOUBLE / any_value(n.n) AS containment
FROM s i JOIN s d ON i.shingle = d.shingle AND i.kind = 'i' AND d.kind = 'd' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9
"""

OP3_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)
"""

OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM w WHERE len(w) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS k FROM s),
late AS (SELECT doc_id, p FROM k JOIN (SELECT k, min(doc_id) AS first FROM k GROUP BY k) USING (k) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT q) AS g FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM late) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT r, p, md5(substring(h, 2 * p + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
again AS (SELECT r, p FROM k JOIN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) USING (k)),
spans AS (SELECT r, i, min(p) AS a, max(p) + 400 AS b FROM (
    SELECT r, p, sum(CASE WHEN p <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS i
    FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM again)) GROUP BY r, i),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_ FROM spans),
cut AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substring(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE head || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_round_trip": OP3_SQL, "op4_benchmark_containment": OP4_SQL, "op5_repeated_phrases": OP5_SQL, "op7_suffix_lpf": OP7_SQL, "op8_norm_bucket_topk": OP8_SQL}
