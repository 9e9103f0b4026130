"""The registered query of each operator, with the parameters of production, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licences, mixing, paragraphs, quality, secrets, sharding, simhash, substrings, topk
from .common import table

SHARDS = 16


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.balanced(SHARDS), sharding.balanced(SHARDS + 1))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.duplicate_paragraphs(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_topk_search": op2_topk_search,
    "op3_source_mixing": op3_source_mixing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_licence_scans": op7_licence_scans,
    "op8_secret_scans": op8_secret_scans,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}
OP2_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

#: md5_number names a string of 100 bytes here.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(0, length(x) // 2 - 99), lambda i: md5_number(substr(x, 2 * i + 1, 200)))) AS m, unnest(range(0, length(x) // 2 - 99)) AS pos FROM d WHERE length(x) >= 200),
s AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY m ORDER BY doc_id, pos) > 1 AS again FROM w),
r AS (SELECT doc_id, pos, pos + 100 AS upto, max(pos + 100) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s WHERE again),
i AS (SELECT doc_id, pos, upto, count(*) FILTER (before IS NULL OR pos > before) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM r),
runs AS (SELECT doc_id, min(pos) AS low, max(upto) AS high FROM i GROUP BY doc_id, span),
kept AS (SELECT doc_id, high AS low, lead(low) OVER (PARTITION BY doc_id ORDER BY low) AS high FROM (SELECT doc_id, low, high FROM runs UNION ALL SELECT doc_id, -1, 0 FROM d)),
texts AS (SELECT doc_id, string_agg(substr(x, 2 * low + 1, 2 * (coalesce(high, length(x) // 2) - low)), '' ORDER BY low) AS y FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce((SELECT sum(high - low) FROM runs WHERE runs.doc_id = d.doc_id), 0)::BIGINT AS n_removed,
 (SELECT count(*) FROM runs WHERE runs.doc_id = d.doc_id) AS n_spans, sha256(unhex(y)) AS kept_sha256 FROM d JOIN texts USING (doc_id)"""

#: Exact, where the operator finds its candidates by bands; 12 is paragraphs.REACH.
OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '([฀-႟ក-៿぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ\x{20000}-\x{3ffff}])', ' \1 ', 'g'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t WHERE len(w) > 0),
h AS (SELECT *, (md5_number_upper(x) >> 33)::BIGINT AS h FROM u),
a AS (SELECT doc_id, n, x, i, CASE WHEN i < n - 1 THEN (h * 1103515245 + lead(h) OVER d * 12345) % 2147483647 END AS a, coalesce((x = lag(x) OVER d)::INT, 0) AS same FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, i > 12 AND n - i > 12 AS room, min(a) OVER back AS al, min(a) OVER onward AS ar, sum(same) OVER back AS sl, sum(same) OVER onward AS sr FROM a
 WINDOW back AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), onward AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
o AS (SELECT *, room AND same = 0 AND sl = 12 AS stops FROM b),
y AS (SELECT *, stops OR (room AND same = 0 AND sr = 12 AND NOT bool_or(stops) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) AS forced FROM o),
z AS (SELECT *, i = 0 OR forced OR (room AND a < al AND a <= ar AND NOT bool_or(forced) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) AS begins FROM y),
p AS (SELECT doc_id, piece, min(i) AS start, list(x ORDER BY i) AS w FROM (SELECT doc_id, i, x, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS piece FROM z) GROUP BY ALL),
g AS (SELECT doc_id, piece, start, len(w) AS words, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM p),
v AS (SELECT s, row_number() OVER (ORDER BY s) AS id FROM (SELECT DISTINCT s FROM g)),
m AS (SELECT id, len(s) AS n, unnest(s) AS x FROM v),
e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
c(id, root) AS (SELECT id, id FROM v UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id),
k AS (SELECT id, min(root) AS root FROM c GROUP BY id),
f AS (SELECT doc_id, piece, start, words, root, first_value({'d': doc_id, 'p': piece}) OVER (PARTITION BY root ORDER BY doc_id, piece) AS f, count(*) OVER (PARTITION BY root) AS n FROM g JOIN v USING (s) JOIN k USING (id))
SELECT doc_id, piece::INT AS piece, start::INT AS start, words::INT AS words, f.d AS first_doc, f.p::INT AS first_piece, doc_id <> f.d OR piece <> f.p AS removed FROM f WHERE n > 1"""

#: The others can't be expressed in SQL (DuckDB has neither CRC-32 nor XXH64, no edit distance to a part of a text, no seeded draws); tests hold each
#: against a brute-force version.
ORACLES: dict[str, str] = {"op2_topk_search": OP2_SQL, "op6_suffix_array_dedup": OP6_SQL, "op7_licence_scans": licences.oracle_sql(), "op9_substring_dedup": OP9_SQL}
