"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extract, language_id, near_dedup, nearest, packing, sharding, substring_dedup, token_counts, toxicity
from .common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):  # noqa: ANN001, ANN201
    QUERIES[f.__name__] = f
    return f


@query
def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_level_wise_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_equivalence_class_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op4_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), similarity=0.8)
    return out.select("doc_id", F.col("component").alias("class_id"), "kept", "n_links", "copies")


@query
def op5_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


@query
def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op9_rank_synchronous_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=4096)


@query
def op10_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.decompose(table(spark, sf_dir, "documents"), limit=4096)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.assign_sequences(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


ORACLE_SQL["op2_level_wise_doubling"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT *, CASE WHEN count(*) OVER f = 20 THEN string_agg(word, ' ') OVER f END AS win FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT *, CASE WHEN win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id, d.ws
"""

# n_links counts all links here; the query counts those of all pairs that share a bucket, which signatures may miss
ORACLE_SQL["op4_prob_min_hash"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh FROM d),
k AS (SELECT doc_id, md5(string_agg(sh, chr(10) ORDER BY sh)) AS own, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT own, min(doc_id) AS head, count(*) AS copies, any_value(n) AS n FROM k GROUP BY 1),
t AS (SELECT h.head, h.n, s.sh FROM h JOIN s ON s.doc_id = h.head),
p AS (SELECT a.head AS x, b.head AS y FROM t a JOIN t b ON a.sh = b.sh AND a.head < b.head GROUP BY a.head, b.head, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(x, y) AS (SELECT head, head FROM h UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS class_id FROM r GROUP BY 1),
l AS (SELECT x, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(c.class_id, d.doc_id) = d.doc_id AS kept, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(h.copies, 1) AS BIGINT) AS copies
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN h ON h.own = k.own LEFT JOIN c ON c.x = h.head LEFT JOIN l ON l.x = h.head
"""
