"""Queries that rank and browse, over the posts of table documents."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import urls as U
from ..operators import index, rank, search
from ..sources.schemas import RESPONSE
from ..sources.store import Store, shared_root
from .registry import query, read, values

RARE, COMMON = ["esat", "the"], ["the", "and"]


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.posts(read(spark, sf_dir, "documents"))


def _ranked(spark: SparkSession, sf_dir: str, terms: list[str]) -> DataFrame:
    return rank.bm25_scan(_posts(spark, sf_dir), terms).select("id", F.round("score", 6).alias("score"))


def _bm25_sql(terms: list[str]) -> str:
    wanted = ", ".join(f"('{t}')" for t in terms)
    return rf"""
WITH posts AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text FROM documents WHERE trim(text) <> ''),
fields AS (SELECT id, 'title' AS field, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS w FROM posts UNION ALL SELECT id, 'text', regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') FROM posts),
means AS (SELECT field, avg(len(w)) AS mean, count(*) AS n_docs FROM fields GROUP BY field),
tf AS (SELECT id, field, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM fields, (VALUES {wanted}) q(term)),
df AS (SELECT term, max(n) AS df FROM (SELECT term, field, count(*) FILTER (tf > 0) AS n FROM tf GROUP BY ALL) GROUP BY term),
parts AS (SELECT id, term, max(CASE WHEN field = 'title' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS part
 FROM tf JOIN df USING (term) JOIN means USING (field) WHERE tf > 0 GROUP BY id, term),
hits AS (SELECT id, sum(part) AS score FROM parts GROUP BY id HAVING count(*) = {len(terms)})"""


@query("corpus_count", "SELECT count(*) AS n FROM documents")
def corpus_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))


@query("max_id", "SELECT max(doc_id) AS max_id FROM documents")
def max_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").agg(F.max("doc_id").alias("max_id"))


@query("term_stats", r"""WITH f AS (SELECT doc_id, 'title' AS field, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\p{L}\p{N}]+') AS w FROM documents WHERE trim(text) <> ''
 UNION ALL SELECT doc_id, 'text', regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM documents WHERE trim(text) <> '')
SELECT term, max(n) AS df FROM (SELECT field, term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, field, unnest(w) AS term FROM f) GROUP BY ALL) GROUP BY term""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_stats(_posts(spark, sf_dir))


@query("corpus_stats", r"""SELECT count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\p{L}\p{N}]+'))), 6) AS title_length,
 round(avg(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))), 6) AS text_length FROM documents WHERE trim(text) <> ''""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index.keyword_stats(_posts(spark, sf_dir))
    return s.select("n_docs", F.round("title_length", 6).alias("title_length"), F.round("text_length", 6).alias("text_length"))


@query("keyword_and_match", _bm25_sql(COMMON) + " SELECT id, round(score, 6) AS score FROM hits")
def keyword_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, COMMON)


@query("bm25_top6", _bm25_sql(COMMON) + " SELECT id, round(score, 6) AS score FROM hits ORDER BY round(score, 6) DESC, id LIMIT 6")
def bm25_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, COMMON).orderBy(F.desc("score"), "id").limit(6)


@query("bm25_page2", _bm25_sql(RARE) + " SELECT id, round(score, 6) AS score FROM hits ORDER BY round(score, 6) DESC, id LIMIT 6 OFFSET 6")
def bm25_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, RARE).orderBy(F.desc("score"), "id").offset(6).limit(6)


@query("bm25_min_score_total", _bm25_sql(COMMON) + " SELECT count(*) AS total, CAST((count(*) + 5) // 6 AS BIGINT) AS total_pages FROM hits WHERE round(score, 6) >= 1.0")
def bm25_min_score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.count("*")
    return _ranked(spark, sf_dir, COMMON).where(F.col("score") >= search.MIN_SCORE).agg(total.alias("total"), F.floor((total + 5) / 6).alias("total_pages"))


_SHAPED = r"""SELECT id, title, 'https://s' || (id % 5) || '.example.com/' || id AS url, CASE WHEN len(w) <= 300 THEN text ELSE array_to_string(w[1:300], ' ') || '...' END AS text
FROM (SELECT hits.id, score, title, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM hits JOIN posts ON hits.id = posts.id
WHERE score >= 1.0 AND contains('https://s' || (hits.id % 5) || '.example.com/' || hits.id || '/', 's1.example.com') ORDER BY score DESC, hits.id LIMIT 6)"""


class _Posts(Store):
    """A store whose pages are a table's posts; of the index, a query builds what it is the first to read."""

    def __init__(self, spark: SparkSession, root: str, posts: DataFrame):
        super().__init__(spark, root)
        self.posts = posts

    def read(self, name: str, schema=None) -> DataFrame:
        if name == "pages":
            return self.posts
        made = "lengths" if name == "keyword_stats" else name
        if made in index.MAKERS and not self.exists(name):
            index.build(self, self.posts, only=(made,))
        return super().read(name, schema)


@functools.cache
def _built(app: str, sf_dir: str, root: str) -> Store:
    """The store of posts of one folder of tables, made once a session."""
    spark = SparkSession.active()
    return _Posts(spark, Store(spark, root).scratch(), _pages(_posts(spark, sf_dir)))


def _pages(posts: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://s"), (F.col("id") % 5).cast("string"), F.lit(".example.com/"), F.col("id").cast("string"), F.lit("/"))
    none = F.lit(None).cast("string")
    return posts.select("id", "title", url.alias("url"), none.alias("fingerprint"), F.lit(None).cast("date").alias("date"), "text", F.lit(None).cast("timestamp").alias("scraped_on_date"))


def _engine(spark: SparkSession, sf_dir: str) -> search.Engine:
    return search.Engine(_built(spark.sparkContext.applicationId, sf_dir, shared_root(spark)))


@query("engine_keyword_page", _bm25_sql(["on", "thea"]) + " " + _SHAPED.replace("SELECT id, title,", "SELECT title,"))
def engine_keyword_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of results from index tables, with a site filter."""
    return _engine(spark, sf_dir).keyword("on thea site:s1.example.com").results.select("title", "url", "text")


@query("index_upsert", _bm25_sql(["on", "thea"]) + " " + _SHAPED.replace("SELECT id, title,", "SELECT title,"))
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page from an index that first held an older text of every post, and every second post alone; a batch brought it up to date."""
    store = Store(spark, Store(spark, shared_root(spark)).scratch())
    posts = _posts(spark, sf_dir)
    store.overwrite("pages", _pages(posts.where("id % 2 = 0").withColumn("text", F.concat(F.lit("on on thea "), F.reverse("text")))))
    engine = search.Engine(store)
    engine.reindex()
    store.overwrite("pages", _pages(posts))
    engine.index_pages(posts)
    return engine.keyword("on thea site:s1.example.com").results.select("title", "url", "text")


@query("empty_query", "SELECT '' AS title, '' AS url, DATE '2000-01-01' AS date, '' AS text WHERE false")
def empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).search(" \t ").results


@query("site_filter_and", "SELECT page_id, url FROM pages WHERE contains(url, 'example.com') AND contains(url, '/fr/')")
def site_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url").where(search.site_filter(["example.com", "/fr/"]))


@query("site_only_page", "SELECT split_part(text, chr(10), 1) AS title, 'https://s1.example.com/' || doc_id AS url FROM documents WHERE doc_id % 5 = 1 AND trim(text) <> '' ORDER BY doc_id LIMIT 6")
def site_only_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).keyword("site:s1.example.com").results.select("title", "url")


def _matched(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    posts = _posts(spark, sf_dir)
    branches = Q.web_query(text, index.analysed(stemmed=False))
    terms = sorted({w for b in branches for i in b for w in i.words})
    return rank.match(index.text_postings(posts, stemmed=False, terms=terms), branches, posts)


_STREAM = r"WITH p AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(lower(split_part(text, chr(10), 1) || ' ' || text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)"


@query("fts_and", _STREAM + " SELECT id FROM p WHERE contains(t, ' esat ') AND contains(t, ' ndon ')")
def fts_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, "esat ndon").select("id")


@query("fts_or", _STREAM + " SELECT id FROM p WHERE contains(t, ' esat ') OR contains(t, ' oure ')")
def fts_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, "esat or oure").select("id")


@query("fts_not", _STREAM + " SELECT id FROM p WHERE contains(t, ' esat ') AND NOT contains(t, ' ndon ')")
def fts_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, "esat -ndon").select("id")


@query("fts_only_not", _STREAM + " SELECT id FROM p WHERE NOT contains(t, ' the ')")
def fts_only_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, "-the").select("id")


@query("fts_phrase", _STREAM + " SELECT id FROM p WHERE contains(t, ' of the ')")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, '"of the"').select("id")


@query("fts_cover_rank_top24")
def fts_cover_rank_top24(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir)
    branches = Q.web_query('esat or "ndon reer" oure', index.analysed())
    terms = sorted({w for b in branches for i in b for w in i.words})
    found = rank.cover_density(rank.match(index.text_postings(posts, terms=terms), branches))
    best = found.orderBy(F.desc("score"), "id").limit(search.FULL_TEXT_CANDIDATES)
    return best.orderBy(F.desc("score"), "id").limit(search.FULL_TEXT_RESULTS).select("id", F.round("score", 6).alias("score"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the day of the event that bears their id, where there is one."""
    days = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("date"))
    posts = _posts(spark, sf_dir)
    return posts.join(days, "id", "left").withColumn("url", F.concat(F.lit("https://a.example.com/"), F.col("id").cast("string"), F.lit("/")))


def _latest_sql(offset: int) -> str:
    return f"""SELECT doc_id AS id, e.date, 'https://a.example.com/' || doc_id AS url FROM documents d JOIN (SELECT event_id, CAST(ts AS DATE) AS date FROM events) e ON d.doc_id = e.event_id
ORDER BY date DESC, id LIMIT 6 OFFSET {offset}"""


@query("latest_p1", _latest_sql(0))
def latest_p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest(_dated(spark, sf_dir), 1).select("id", "date", U.without_slash(F.col("url")).alias("url"))


@query("latest_p9_clamped", _latest_sql(24))
def latest_p9_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest(_dated(spark, sf_dir), 9).select("id", "date", U.without_slash(F.col("url")).alias("url"))


@query("random_seeded", "SELECT split_part(text, chr(10), 1) AS title, 'https://s' || (doc_id % 5) || '.example.com/' || doc_id AS url FROM documents WHERE doc_id >= 123 ORDER BY doc_id LIMIT 1")
def random_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).random(123).select("title", "url")


@query("cli_first5", _bm25_sql(["on", "thea"]) + " SELECT left(title, 60) AS title, 'https://s' || (hits.id % 5) || '.example.com/' || hits.id AS url FROM hits JOIN posts ON hits.id = posts.id WHERE score >= 1.0 ORDER BY score DESC, hits.id LIMIT 5")
def cli_first5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_rows(_engine(spark, sf_dir).keyword("on thea"))


@query("api_payload", _bm25_sql(["on", "thea"]) + " SELECT count(*) AS total, (count(*) + 5) // 6 AS total_pages, least(6, count(*)) AS rows FROM hits WHERE score >= 1.0")
def api_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response's JSON, read again."""
    back = _engine(spark, sf_dir).api(" on thea ").select(F.from_json("response", RESPONSE).alias("r"))
    return back.select("r.total", F.col("r.total_pages").cast("long").alias("total_pages"), F.size("r.results").cast("long").alias("rows"))


@query("scores_by_mode", _bm25_sql(["on", "thea"]) + " SELECT m, total FROM (VALUES ('keyword'), ('hybrid'), ('x')) t(m), (SELECT count(*) AS total FROM hits WHERE score >= 1.0)")
def scores_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    return values(spark, "m string, total long", *[(m, engine.search("on thea", m).total) for m in ("keyword", "hybrid", "x")])
