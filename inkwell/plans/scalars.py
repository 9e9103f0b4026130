"""Queries over addresses, texts, query strings and pages of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..functions import urls as U
from .registry import query, read, values

URLS = (
    "https://a.example.com/2024/post", "http://www.a.example.com/about/x", "https://a.example.com/ABOUT", "https://a.example.com/tag", "https://a.example.com/author",
    "https://a.example.com/author/ann", "https://a.example.com/category/c/d", "http://localhost:80/x", "http://0.0.0.0/x", "https://youtube.com/watch", "https://www.youtube.com/watch",
    "https://a.example.com/links/", "https://a.example.com/p//", "https://a.example.com/p?q=1#f", "HTTP://A.Example.com/P?utm_source=x&b=2#frag", "ftp://a.example.com/", "  https://b.example.org/x?fbclid=1  ", "no address",
)
QUERIES_TEXT = ("site:a.com x SITE:b.org -site:q website:z \"q r\"", "  plain   words ", "", "   ", "site:a.com", "site:a.com site:b/c", 'an "open phrase', '"one" and "two three"', "site:!!! x", "a or b", "-a")
_ALL_URLS = ", ".join(f"('{u}')" for u in URLS)
_ALL_QUERIES = ", ".join(f"('{q}')" for q in QUERIES_TEXT)


def _urls(spark: SparkSession) -> DataFrame:
    return values(spark, "url string", *[(u,) for u in URLS])


def _queries(spark: SparkSession) -> DataFrame:
    return values(spark, "q string", *[(q,) for q in QUERIES_TEXT])


_STRIP = r"regexp_replace(split_part(regexp_replace(url, '^(?:https?://)?(?:www[.])?', ''), '?', 1), '/+$', '')"


@query("strip_url", f"SELECT page_id, {_STRIP} AS stripped_url FROM pages")
def strip_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", U.stripped(F.col("url")).alias("stripped_url"))


@query("host", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '') AS host FROM pages")
def host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", U.domain(F.col("url")).alias("host"))


@query("display_domain", "SELECT page_id, split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) AS shown FROM pages")
def display_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", U.display_domain(F.col("url")).alias("shown"))


_WHOLE = r"^\s*([hH][tT][tT][pP][sS]?)://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?\s*$"
_KEPT = f"array_to_string(list_filter(string_split(regexp_extract(url, '{_WHOLE}', 4), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{U.TRACKING}')), '&')"
CLEAN = rf"""CASE WHEN regexp_matches(url, '{_WHOLE}') THEN lower(regexp_extract(url, '{_WHOLE}', 1)) || '://' || lower(regexp_extract(url, '{_WHOLE}', 2)) || regexp_extract(url, '{_WHOLE}', 3)
 || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END END"""


@query("clean_url", f"SELECT url, {CLEAN} AS clean FROM (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {_ALL_URLS}) t(url))")
def clean_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "pages").select("url").unionByName(_urls(spark))
    return both.select("url", U.clean(F.col("url")).alias("clean"))


@query(
    "blog_url_flag",
    rf"""SELECT url, NOT (regexp_matches(url, '{U.LOCAL}') OR regexp_matches(url, '{U.SECTION}') OR regexp_matches(url, '{U.LISTING}') OR regexp_matches(url, '{U.BARE}')) AS is_post
FROM (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {_ALL_URLS}) t(url))""",
)
def blog_url_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "pages").select("url").unionByName(_urls(spark))
    return both.select("url", U.is_post(F.col("url")).alias("is_post"))


_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def _excerpt(source: str, words: str) -> str:
    return f"CASE WHEN len({words}) <= 300 THEN {source} ELSE array_to_string({words}[1:300], ' ') || '...' END"


@query("snippet_300", f"SELECT doc_id, {_excerpt('text', _W)} AS snippet FROM documents")
def snippet_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("left_1500_snippet", f"SELECT doc_id, {_excerpt('text', _W)} AS snippet FROM (SELECT doc_id, left(text, 1500) AS text FROM documents)")
def left_1500_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.snippet(T.left(F.col("text"), 1500)).alias("snippet"))


@query("display_280", "SELECT doc_id, CASE WHEN text = '' THEN 'No description available' WHEN length(text) > 280 THEN left(text, 280) || '...' ELSE text END AS shown FROM documents")
def display_280(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.description(F.col("text")).alias("shown"))


@query("title_100", "SELECT doc_id, CASE WHEN t = '' THEN 'Untitled' ELSE left(t, 100) END AS shown FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents)")
def title_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.title(T.first_line(F.col("text"))).alias("shown"))


@query("normal_space", f"SELECT doc_id, array_to_string({_W}, ' ') AS plain FROM documents")
def normal_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.normal_space(F.col("text")).alias("plain"))


_PAIRS = [(p, t) for t in (0, 1, 2, 5, 9) for p in range(1, t + 1)]


@query(
    "page_window",
    f"""SELECT page, total, CASE WHEN total > 1 THEN array_to_string(list_concat(list_concat(
 CASE WHEN page - 2 > 2 THEN [1, 0] WHEN page - 2 > 1 THEN [1] ELSE [] END, range(greatest(1, page - 2), least(total, page + 2) + 1)),
 CASE WHEN page + 2 < total - 1 THEN [0, total] WHEN page + 2 < total THEN [total] ELSE [] END), ' ') ELSE '' END AS links
FROM (VALUES {', '.join(map(str, _PAIRS))}) t(page, total)""",
)
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "page int, total int", *_PAIRS)
    return rows.select("page", "total", F.array_join(T.page_window(F.col("page"), F.col("total")), " ").alias("links"))


@query("page_meta", "SELECT source, count(*) AS total, CAST((count(*) + 5) // 6 AS INT) AS total_pages, CAST((ceil(count(*) / 6.0) - 1) * 6 AS BIGINT) AS last_offset FROM documents GROUP BY source")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total"))
    pages = T.total_pages(F.col("total"), 6)
    return by.select("source", "total", pages.alias("total_pages"), ((pages - 1) * 6).cast("long").alias("last_offset"))


_SITES = r"""list_filter(list_transform(regexp_extract_all(q, '(?i)\bsite:([^\s"]+)', 1), lambda d: regexp_replace(d, '[^\w.-]+', '', 'g')), lambda d: d <> '')"""
_REST = r"""regexp_replace(q, '(?i)\bsite:([^\s"]+)', '', 'g')"""


@query("parse_site", f"SELECT q, array_to_string({_SITES}, ' ') AS sites FROM (VALUES {_ALL_QUERIES}) t(q)")
def parse_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark).select("q", F.array_join(Q.sites(F.col("q")), " ").alias("sites"))


@query("parse_phrases", f"""SELECT q, array_to_string(regexp_extract_all({_REST}, '"([^"]+)"', 1), '|') AS phrases FROM (VALUES {_ALL_QUERIES}) t(q)""")
def parse_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark).select("q", F.array_join(Q.phrases(F.col("q")), "|").alias("phrases"))


@query("parse_clean", rf"SELECT q, trim(regexp_replace({_REST}, '\s+', ' ', 'g')) AS clean FROM (VALUES {_ALL_QUERIES}) t(q)")
def parse_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark).select("q", Q.clean(F.col("q")).alias("clean"))


@query("flags", "SELECT f, lower(f) = 'true' AS postgres, CASE WHEN lower(f) = 'keyword' THEN 'keyword' ELSE 'hybrid' END AS mode FROM (VALUES ('TRUE'), ('true'), ('no'), ('Keyword'), ('hybrid'), ('')) t(f)")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "f string", *[(x,) for x in ("TRUE", "true", "no", "Keyword", "hybrid", "")])
    return rows.select("f", (F.lower("f") == "true").alias("postgres"), F.when(F.lower("f") == "keyword", "keyword").otherwise("hybrid").alias("mode"))


@query(
    "search_seconds",
    "SELECT event_id, floor(abs(value) / 10 + 0.5) / 100 AS seconds FROM events",
)
def search_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", T.seconds(F.abs("value")).alias("seconds"))


@query("url_encoded_query", f"SELECT q, replace(url_encode(q), '%20', '+') AS encoded FROM (VALUES {_ALL_QUERIES}) t(q)")
def url_encoded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark).select("q", F.url_encode("q").alias("encoded"))


_CHUNKS = r"""
WITH parts AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n{2,}', chr(1), 'g'), '([!.?])\s+', '\1' || chr(1), 'g'), chr(1)),
 lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS sentences FROM documents),
done AS (SELECT doc_id, text, list_reduce(list_prepend({'chunks': []::VARCHAR[], 'open': []::VARCHAR[], 'size': 0, 's': ''},
 list_transform(sentences, lambda s: {'chunks': []::VARCHAR[], 'open': []::VARCHAR[], 'size': 0, 's': s})), lambda a, x:
 CASE WHEN length(x.s) > 1200 THEN list_reduce(list_prepend({'chunks': CASE WHEN len(a.open) > 0 THEN list_append(a.chunks, array_to_string(a.open, ' ')) ELSE a.chunks END, 'open': []::VARCHAR[], 'size': 0, 's': ''},
  list_transform(list_filter(regexp_split_to_array(x.s, '\s+'), lambda w: w <> ''), lambda w: {'chunks': []::VARCHAR[], 'open': []::VARCHAR[], 'size': 0, 's': w})), lambda b, y:
   CASE WHEN b.size + length(y.s) + 1 > 1200 THEN {'chunks': CASE WHEN len(b.open) > 0 THEN list_append(b.chunks, array_to_string(b.open, ' ')) ELSE b.chunks END, 'open': [y.s], 'size': length(y.s), 's': ''}
   ELSE {'chunks': b.chunks, 'open': list_append(b.open, y.s), 'size': b.size + length(y.s) + 1, 's': ''} END)
 WHEN a.size + length(x.s) + 1 > 800 AND len(a.open) > 0 THEN {'chunks': list_append(a.chunks, array_to_string(a.open, ' ')), 'open': [x.s], 'size': length(x.s) + 1, 's': ''}
 ELSE {'chunks': a.chunks, 'open': list_append(a.open, x.s), 'size': a.size + length(x.s) + 1, 's': ''} END) AS r FROM parts),
lists AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] WHEN length(text) <= 800 THEN [text]
 WHEN len(r.open) > 0 THEN list_append(r.chunks, array_to_string(r.open, ' ')) ELSE r.chunks END AS c FROM done)
SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS n, unnest(c) AS chunk FROM lists"""


@query("chunk_text", _CHUNKS)
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("n", "chunk"))
